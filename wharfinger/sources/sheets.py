"""Workbooks (.xlsx) as a source of their own: a partition for each range of rows of a sheet.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").option("sheet", "Figure 3").load(path)

gives (sheet, row, column, text, number, year): a cell a row, without empty ones. row and column count
from 1; text holds what a cell says, number its value if it is one; year is that of a number
which the cell's format shows as a date. as_series() makes (series, year, value) of a
sheet with a column for each year.

A workbook is an archive of XML parts. The driver reads the list of sheets and their extent alone; a
task reads its sheet's part as a stream, keeps the rows of its range, and looks up the shared texts that these
need. Paths are opened by Arrow's file systems, so a store that they know will do.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "sheet string, row int, column int, text string, number double, year int"
RANGE_ROWS = 100_000
#: The built-in number formats that show dates, and the first day of both calendars (as the days
#: before 1970-01-01).
DATE_FORMATS = (14, 15, 16, 17, 22)
EPOCHS = {False: 25569, True: 24107}


def opened(path: str) -> zipfile.ZipFile:
    if re.match(r"\w+://|file:", path):
        fs, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        fs, inner = pyarrow.fs.LocalFileSystem(), path
    return zipfile.ZipFile(fs.open_input_file(inner))


def plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def elements(book: zipfile.ZipFile, part: str, *tags: str) -> Iterator[ElementTree.Element]:
    """Elements of these tags as they end, freed after use."""
    if part not in book.namelist():
        return
    with book.open(part) as f:
        path = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if plain(e.tag) in tags:
                yield e
                e.clear()
                if path:
                    path[-1].remove(e)


def attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if plain(k) == name), None)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in order."""
    targets = {attribute(e, "Id"): attribute(e, "Target") for e in elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    found = [(attribute(e, "name"), targets[attribute(e, "id")]) for e in elements(book, "xl/workbook.xml", "sheet")]
    return [(name, part.lstrip("/") if part.startswith("/") else f"xl/{part}") for name, part in found]


def place(ref: str) -> tuple[int, int]:
    """(row, column) of a reference like BC12."""
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits), column


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show dates."""
    own, out = set(), set()
    for e in elements(book, "xl/styles.xml", "numFmt", "cellXfs"):
        if plain(e.tag) == "numFmt":
            if re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", attribute(e, "formatCode") or ""), re.I):
                own.add(int(attribute(e, "numFmtId")))
        else:
            out |= {i for i, x in enumerate(e) if int(x.attrib.get("numFmtId", 0)) in own | set(DATE_FORMATS)}
    return out


class Range(InputPartition):
    def __init__(self, path: str, sheet: str, part: str, first: int, last: int) -> None:
        self.path, self.sheet, self.part, self.first, self.last = path, sheet, part, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.sheet, self.rows = options["path"], options.get("sheet"), int(options.get("rows", RANGE_ROWS))

    def partitions(self) -> list[Range]:
        out = []
        with opened(self.path) as book:
            for name, part in sheets(book):
                if self.sheet not in (None, name):
                    continue
                extent = re.search(rb'<(?:\w+:)?dimension[^>]*ref="[A-Z]+\d+(?::[A-Z]+(\d+))?"', book.open(part).read(4096))
                last = int(extent[1] or 1) if extent else 0
                firsts = list(range(1, last + 1, self.rows)) or [1]
                out += [Range(self.path, name, part, a, b - 1) for a, b in zip(firsts, [*firsts[1:], 1 << 31])]
        return out

    def read(self, p: Range) -> Iterator[tuple]:
        with opened(p.path) as book:
            dates, cells, shared = date_styles(book), [], set()
            base = next((EPOCHS[attribute(e, "date1904") in ("1", "true")] for e in elements(book, "xl/workbook.xml", "workbookPr")), EPOCHS[False])
            for e in elements(book, p.part, "c"):
                row, column = place(e.attrib["r"])
                if row > p.last:
                    break
                kind, value = e.attrib.get("t", "n"), next((x.text for x in e if plain(x.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(x.text or "" for x in e.iter() if plain(x.tag) == "t")
                if row >= p.first and value not in (None, ""):
                    cells.append((row, column, kind, value, int(e.attrib.get("s", 0)) in dates))
                    if kind == "s":
                        shared.add(int(value))
            said = {}
            if shared:
                for i, e in enumerate(elements(book, "xl/sharedStrings.xml", "si")):
                    if i in shared:
                        said[i] = "".join(x.text or "" for x in e.iter() if plain(x.tag) == "t")
        for row, column, kind, value, dated in cells:
            if kind == "n":
                number = float(value)
                yield p.sheet, row, column, value, number, year_of(number - base) if dated else None
            elif kind == "s":
                if text := said.get(int(value)):
                    yield p.sheet, row, column, text, None, None
            elif kind != "e":  # an error has no value
                yield p.sheet, row, column, value, None, None


def year_of(days: float) -> int:
    return (datetime.date(1970, 1, 1) + datetime.timedelta(days=int(days // 1))).year


class Workbook(DataSource):
    """Options: path, sheet (all without it), rows (of a range)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def cells(spark: SparkSession, path: str, sheet: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook").option("rows", str(rows))
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def as_series(found: DataFrame, header: int = 1, first: int = 1800, last: int = 1999) -> DataFrame:
    """(series, year, value) of one sheet: the header row has the years, as numbers or dates, the first
    column the names; cells without a number are left out."""
    year = F.coalesce("year", F.when((F.col("number") == F.floor("number")) & F.col("number").between(first, last), F.col("number").cast("int")), F.when(F.col("text").rlike(r"^\d{4}$"), F.col("text").cast("int")))
    years = found.where(F.col("row") == header).select("column", year.alias("_year")).where(F.col("_year").between(first, last))
    names = found.where((F.col("row") > header) & (F.col("column") == 1)).select("row", F.col("text").alias("series"))
    values = found.where((F.col("row") > header) & F.col("number").isNotNull()).select("row", "column", "number")
    return values.join(years, "column").join(names, "row").select("series", F.col("_year").alias("year"), F.col("number").alias("value"))
