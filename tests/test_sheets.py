"""A workbook written here comes back: shared and inline texts, empty cells, dates, several sheets."""

import zipfile

from wharfinger.sources import sheets

XML = '<?xml version="1.0" encoding="UTF-8"?>'
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def column(k):
    return (column((k - 1) // 26) if k > 26 else "") + chr(65 + (k - 1) % 26)


def workbook(path, grids, shared, rich=None):
    """grids: {sheet: rows of cells}; a cell is None, a number, (number, style), a place in shared, as "#k", or an inline text."""
    def cell(r, c, v):
        ref = f'r="{column(c)}{r}"'
        if v is None:
            return f"<c {ref} s=\"1\"/>" if c % 2 else ""
        if isinstance(v, tuple):
            return f'<c {ref} s="{v[1]}"><v>{v[0]}</v></c>'
        if isinstance(v, str):
            return f'<c {ref} t="s"><v>{v[1:]}</v></c>' if v[0] == "#" else f'<c {ref} t="e"><v>#N/A</v></c>' if v == "!" else f'<c {ref} t="inlineStr"><is><t>{v}</t></is></c>'
        return f"<c {ref}><v>{v}</v></c>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(grids)
        z.writestr("xl/workbook.xml", f"{XML}<workbook {MAIN}><workbookPr/><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{XML}<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"{XML}<sst {MAIN}>" + "".join(f"<si><t>{t}</t></si>" if isinstance(t, str) else "<si>" + "".join(f"<r><t>{x}</t></r>" for x in t) + "</si>" for t in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'{XML}<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/><xf numFmtId="170"/><xf numFmtId="14"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, rows in enumerate(grids.values(), 1):
            wide = max(map(len, rows), default=1)
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{XML}<worksheet {MAIN}><dimension ref="A1:{column(wide)}{len(rows)}"/><sheetData>{body}</sheetData></worksheet>')


def test_series_of_a_sheet(spark, tmp_path):
    grid = [
        ["#0", 1809, (10228, 2), (700, 4), "1812", *[None] * 22, 1836],  # 10228 is 1928-01-01 by its format; 700 days are no year
        ["#1", 10.5, 11, 99, None, *[None] * 22, 7],
        ["#2", None, 20, "!", 21.25],
        ["Gaps & more".replace("&", "&amp;"), 1, None, None, "n/a"],
        [],
    ]
    path = str(tmp_path / "book.xlsx")
    workbook(path, {"Figure 3": grid, "Other": [["#1", 5]], "Empty": []}, ["Series", "Square timber", ("Sawn ", "lumber")])
    want = {("Square timber", 1809, 10.5), ("Square timber", 1928, 11.0), ("Square timber", 1836, 7.0), ("Sawn lumber", 1928, 20.0), ("Sawn lumber", 1812, 21.25), ("Gaps & more", 1809, 1.0)}
    for rows in (1, 2, 100):
        found = sheets.cells(spark, path, "Figure 3", rows)
        assert found.rdd.getNumPartitions() >= (5 if rows == 1 else 1)
        assert {tuple(r) for r in sheets.as_series(found).collect()} == want
    every = sheets.cells(spark, f"file://{path}").collect()
    assert {r["sheet"] for r in every} == {"Figure 3", "Other"} and ("Other", 1, 1, "Square timber", None, None) in {tuple(r) for r in every}
    assert {(r["row"], r["column"], r["year"]) for r in every if r["year"]} == {(1, 3, 1928)}


def test_places():
    assert [sheets.place(r) for r in ("A1", "Z9", "AA10", "BC123")] == [(1, 1), (9, 26), (10, 27), (123, 55)]
