"""Readers and writers of the file kinds that the arrivals work uses."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, line_no and text of text files, without the "NNN→" that heads a line."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.posexplode(F.split("value", "\n")).alias("p", "text"))
    return raw.select("source_file", (F.col("p") + 1).alias("line_no"), F.regexp_replace("text", r"^\s*\d+→", "").alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, broken) JSON documents, one a file; broken ones keep their file's name and text."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("source_file"))
    bad = F.col("_corrupt_record").isNotNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad).withColumnRenamed("_corrupt_record", "error")  # all columns: Spark reads no file for the broken text alone


def succeeded(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status") == "success")


def only(df: DataFrame, part: str, column: str = "source_file") -> DataFrame:
    """Rows whose file name contains a text."""
    return df.where(F.contains(F.col(column), F.lit(part)))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def geo_points(spark: SparkSession, path: str) -> DataFrame:
    """name, lat and lon of a GeoJSON file's features; of equal names the last counts."""
    schema = "features array<struct<properties:struct<Name:string>,geometry:struct<coordinates:array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("k", "f"))
    rows = f.select(F.col("f.properties.Name").alias("name"), F.element_at("f.geometry.coordinates", 2).alias("lat"), F.element_at("f.geometry.coordinates", 1).alias("lon"), "k")
    last = rows.groupBy("name").agg(F.max(F.struct("k", "lat", "lon")).alias("m"))
    return last.select("name", "m.lat", "m.lon")


def long_series(wide: DataFrame, name: str, years: list[str]) -> DataFrame:
    """(series, year, value) from a sheet with a column for each year."""
    return wide.unpivot([name], years, "year", "value").select(F.col(name).alias("series"), F.col("year").cast("int").alias("year"), "value")


def companions(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Lines with the labels of their file; files without labels, and labels without, go."""
    return lines.join(labels, ["source_file", "line_no"])


def not_done(todo: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    """What has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_dataset(df: DataFrame, path: str, *by: str) -> None:
    """A new Parquet dataset in folders by column; a stage never writes what it reads."""
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)


def write_ordered_csv(df: DataFrame, path: str, by: str, *keys: str) -> None:
    """One CSV file by falling `by`, then keys as text. For the few rows of a report."""
    df.orderBy(F.desc(by), *[F.col(k).cast("string") for k in keys]).coalesce(1).write.option("header", True).csv(path)


def graph_json(nodes: DataFrame, edges: DataFrame, path: str, meta: dict[str, object] | None = None) -> None:
    """A graph below path, one JSON object a line: nodes, edges, and one line of meta with what is given, node_count
    and edge_count, counted in what was written. meta is written last: a folder without it is not whole."""
    spark = nodes.sparkSession
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.json(f"{path}/{name}")
    n = {f"{name[:-1]}_count": spark.read.text(f"{path}/{name}").count() for name in ("nodes", "edges")}
    given = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    spark.range(1).select(*([F.struct(*given).alias("meta")] if given else []), *[F.lit(v).alias(k) for k, v in n.items()]).coalesce(1).write.json(f"{path}/meta")


def compact_json(ports: DataFrame, forms: DataFrame, cells: DataFrame, path: str) -> None:
    """counts.compact as JSON below path: the names in order of their places, and for each level arrays of
    numbers [o, d, f, year, n], without those that the level does not have, one a line and in order."""
    for name, rows, column in (("ports", ports, "port"), ("forms", forms, "form")):
        rows.orderBy("place").select(column).write.json(f"{path}/{name}")
    whole = lambda c: F.col(c).cast("long")
    cell = F.array_compact(F.array(*map(whole, ("o", "d", "f", "year", "n"))))
    cells.orderBy("level", "o", "d", "f", "year").select("level", F.to_json(cell).alias("value")).write.partitionBy("level").text(f"{path}/cells")


def indexed(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column replaced by its value's place in order, from 0 on. Values are a dimension."""
    dim = df.select(column).distinct().withColumn(name, F.row_number().over(W.orderBy(column)) - 1)
    return df.join(dim, df[column].eqNullSafe(dim[column])).drop(column)


def saved(df: DataFrame) -> DataFrame:
    """df computed and kept in the checkpoint folder, which all machines must share. Local sessions
    without one get a folder of their own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wharfinger"))
    return df.checkpoint()
