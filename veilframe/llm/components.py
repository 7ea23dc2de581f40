"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least of it and its neighbours, which is among its edges as the upper end."""
    low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, component): every node of a link with the smallest node of its component. edges are read more than once,
    so they should be stored.

    Edges (u, v) have u > v throughout. Rounds end when they are stars: each upper end has one edge and is no lower end.
    Each round's edges are written to the shared folder, as is the result."""
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    now, before = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        now = cut(_small_star(_large_star(now)).distinct(), "edges")
        if before is not None:
            drop_cut(before)
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("below")).union(now.select("v", F.lit(None)))
        found = ends.groupBy("node").agg(F.min("below").alias("m"), F.count("below").alias("n"), F.count(F.lit(1)).alias("ends"))
        found = cut(found.select("node", F.coalesce("m", "node").alias("component"), ((F.col("n") > 1) | (F.col("n").between(1, F.col("ends") - 1))).alias("open")), "components")
        if not found.where("open").count():
            drop_cut(now)
            return found.select("node", "component")
        drop_cut(found)
        before = now
