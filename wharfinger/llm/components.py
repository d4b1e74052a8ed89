"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfinger.llm.scratch import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node with the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours with the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): for each id of a component but the least, the least id. Only (id, id) rows move;
    the least neighbour is an aggregate, so a hub needs no list of its neighbours anywhere."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before, k = scratch.save(edges, f"{name}0"), None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return edges
        before, k = now, k + 1
        edges = scratch.save(small_star(large_star(edges).where("u <> v").distinct()).where("u <> v").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")


def absorb(roots: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """roots after further links (u, v): only the links between components are worked on, as
    links of their least ids, so the work follows what is new."""
    to = roots.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    met = links.join(to, F.col("u") == F.col("_u"), "left").select(F.coalesce("_v", "u").alias("u"), "v")
    met = met.join(to, F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v"))
    up = components(met, scratch, name)
    above = up.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    moved = roots.join(above, F.col("v") == F.col("_u"), "left").select("u", F.coalesce("_v", "v").alias("v"))
    return scratch.save(moved.union(up), f"{name}all")
