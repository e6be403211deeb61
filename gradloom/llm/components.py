"""Connected components by alternating large-star and small-star contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradloom.plans.lineage import cut


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """The smallest of each node and its neighbours."""
    return edges.groupBy(node).agg(F.least(F.min(other), F.first(node)).alias("least"))


def label(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each end of an edge (u, v); both ends may be given either way.

    A star's centre may have any number of edges: every step is an aggregate and a join on
    it, which split it, and the edges are written after each round.  No edges give no rows.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct()) if state["n"] else _none(now)
        before = state
        # Large star: larger neighbours go to the smallest neighbour.
        ways = now.union(now.select("v", "u")).toDF("u", "v")
        large = ways.join(_least(ways, "u", "v"), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest one.
        low = _least(large, "u", "v")
        small = large.join(low, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = cut(small.union(low.where("u <> least").select("u", "least")).distinct())


def _none(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
