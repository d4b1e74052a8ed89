"""Arrivals as a property graph: a frame for each kind of node and edge, patterns as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(df: DataFrame, parts: int = 0) -> DataFrame:
    """kind, name and counts (n_out and n_in for ports, n for the others): rows, and for goods the
    distinct records. parts: partitions over which records are dealt before those are counted."""
    none = F.lit(None).cast("long")
    out = df.groupBy(F.col("origin").alias("name")).agg(F.count(F.lit(1)).alias("n_out"))
    into = df.groupBy(F.col("dest").alias("name")).agg(F.count(F.lit(1)).alias("n_in"))
    ports = out.join(into, "name", "full").select(F.lit("Port").alias("kind"), "name", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), none.alias("n"))

    def plain(kind: str, rows: DataFrame, name: str, n: Column) -> DataFrame:
        n = rows.groupBy(F.col(name).alias("name")).agg(n.alias("n"))
        return n.select(F.lit(kind).alias("kind"), "name", none.alias("n_out"), none.alias("n_in"), "n")

    records, rows = df.select("record_id", "forms"), F.count(F.lit(1))
    forms = (records.repartition(parts, "record_id") if parts else records).select("record_id", F.explode("forms").alias("form"))
    return ports.union(plain("Ship", df, "ship", rows)).union(plain("Merchant", df, "merchant", rows)).union(plain("Commodity", forms, "form", F.countDistinct("record_id"))).union(plain("Species", df, "species", rows))


def edges(df: DataFrame) -> DataFrame:
    """kind, source, target, year and shipments: routes, imports, exports and receipts."""
    kinds = {"ROUTE": ("origin", "dest"), "IMPORTED": ("dest", "form"), "EXPORTED": ("origin", "form"), "RECEIVED_AT": ("merchant", "dest")}
    forms, out = df.withColumn("form", F.explode("forms")), None
    for kind, (a, b) in kinds.items():
        rows = forms if "form" in (a, b) else df
        e = rows.groupBy(F.col(a).alias("source"), F.col(b).alias("target"), "year").agg(F.count(F.lit(1)).alias("shipments")).select(F.lit(kind).alias("kind"), "source", "target", "year", "shipments")
        out = e if out is None else out.union(e)
    return out


#: The kinds of node at an edge's ends.
ENDS = {"ROUTE": ("port", "port"), "IMPORTED": ("port", "commodity"), "EXPORTED": ("port", "commodity"), "RECEIVED_AT": ("merchant", "port")}


def with_ids(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes() and edges() as a graph file names them: id is the kind in small letters, a colon and the name, type
    the kind, label the name; an edge's source and target are such ids."""
    ids = node.select(F.concat_ws(":", F.lower("kind"), "name").alias("id"), F.col("kind").alias("type"), F.col("name").alias("label"), F.col("n_out").alias("shipments_out"), F.col("n_in").alias("shipments_in"), F.col("n").alias("shipments"))

    def end(column: str, i: int):
        kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(e[i])) for k, e in ENDS.items()])
        return F.concat_ws(":", kind, column).alias(column)

    return ids, edge.select(end("source", 0), end("target", 1), F.col("kind").alias("type"), "year", "shipments")


def links(df: DataFrame, target: str) -> DataFrame:
    """Edges of each record to one of its values: (record_id, target)."""
    return df.select("record_id", F.col(target).alias("target"))


def carried(df: DataFrame) -> DataFrame:
    return df.select("record_id", F.explode("forms").alias("target"))


def suppliers(df: DataFrame, dest: str, form: str, k: int = 10) -> DataFrame:
    """Where a port's goods of a form came from: three edge tables met on the record."""
    at, what, whence = links(df, "dest").where(F.col("target") == dest), carried(df).where(F.col("target") == form), links(df, "origin").withColumnRenamed("target", "origin")
    n = at.select("record_id").join(what.select("record_id"), "record_id").join(whence, "record_id").groupBy("origin").agg(F.countDistinct("record_id").alias("n"))
    return n.orderBy(F.desc("n"), "origin").limit(k)


def firms_between(df: DataFrame, origin: str, dest: str) -> DataFrame:
    a, b, m = links(df, "origin").where(F.col("target") == origin), links(df, "dest").where(F.col("target") == dest), links(df, "merchant").withColumnRenamed("target", "merchant")
    return a.select("record_id").join(b.select("record_id"), "record_id").join(m, "record_id").groupBy("merchant").agg(F.count("record_id").alias("n"))


def busiest(edge: DataFrame, year: int, k: int) -> DataFrame:
    return edge.where((F.col("kind") == "ROUTE") & (F.col("year") == year)).orderBy(F.desc("shipments"), "source", "target").limit(k).select("source", "target", "shipments")


def career(df: DataFrame, ships: DataFrame) -> DataFrame:
    """The arrivals of the ships named in a frame with a column ship."""
    return df.join(ships, "ship", "left_semi").select("record_id", F.date_format("arrived", "yyyy-MM-dd").alias("iso"), "origin", "dest")


def tables(df: DataFrame, coords: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph as 13 tables by name: five kinds of node, records, seven kinds of edge. coords has a
    row (name, lat, lon) for each placed port. Edges to a value that is null or empty are left out."""
    every, n = F.count(F.lit(1)), lambda name: F.count(F.lit(1)).alias(name)
    out, into = df.groupBy(F.col("origin").alias("name")).agg(n("shipments_out")), df.groupBy(F.col("dest").alias("name")).agg(n("shipments_in"))
    port = out.join(into, "name", "full").where("name <> ''").fillna(0, ["shipments_out", "shipments_in"])
    port = port.join(coords, "name", "left").select("name", "lat", "lon", "shipments_out", "shipments_in") if coords is not None else port
    goods = df.select("record_id", F.explode(F.array_distinct("forms")).alias("form"), *[c for c in ("quantity", "unit", "item_raw") if c in df.columns])
    kept = [c for c in df.columns if c not in ("origin", "dest", "ship", "merchant", "species", "forms", "quantity", "unit", "item_raw")]

    def node(rows: DataFrame, column: str, name: str = "name") -> DataFrame:
        return rows.where(F.col(column) != "").groupBy(F.col(column).alias(name)).agg(every.alias("shipments"))

    def edge(column: str) -> DataFrame:
        return links(df, column).where("target <> ''")

    routes = df.where("origin <> '' and dest <> ''").groupBy("origin", F.col("dest").alias("destination"), "year").agg(every.alias("shipments"))
    return {
        "Port": port, "Ship": node(df, "ship"), "Merchant": node(df, "merchant"), "Commodity": node(goods, "form", "form"), "Species": node(df, "species"), "Shipment": df.select(*kept),
        "ARRIVED_FROM": edge("origin"), "ARRIVED_AT": edge("dest"), "BY_SHIP": edge("ship"), "CONSIGNED_TO": edge("merchant"), "CARRIED": goods, "CARRIED_SPECIES": edge("species"), "ROUTE": routes,
    }


def load(graph: dict[str, DataFrame], path: str, prefix: str = "graph_") -> None:
    """Writes each table as a dataset of its own below path, then shows it as a temporary view."""
    for name, rows in graph.items():
        rows.write.parquet(f"{path}/{name}")
        rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}").createOrReplaceTempView(prefix + name.lower())
