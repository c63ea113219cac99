"""Connected components of a graph of long ids by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collegium.llm.common import materialise


def _lowest(edges: DataFrame) -> DataFrame:
    """Per node `u`, the least of it and its neighbours `v`; combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v): root is the least node that can be reached.

    A large-star round joins each node's larger neighbours to its least one, a small-star round joins the smaller
    ones; the number of edges doesn't grow and the rounds are logarithmic in the nodes. Each round is written to
    the shared folder. Loops and repeated edges are harmless; nodes without an edge do not appear.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before, now = None, _state(edges)
    while before != now and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = large.join(_lowest(large), "u")
        small = small.select("u", F.col("low").alias("v")).unionByName(small.where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")))
        edges = materialise(small.distinct(), "edges")
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
