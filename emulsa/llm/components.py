"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): the least node of its component, for nodes that have an edge.

    With ``rounds`` the steps may end early; then equal labels still mean one component.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    done, before = 0, None
    while True:
        edges = cut(_step(_step(edges, True), False))
        done += 1
        seen = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if seen == before or (rounds and done >= rounds):
            break
        before = seen
    # one label a node: its least neighbour, and for the roots themselves
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    roots = labels.select(F.col("label").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return labels.union(roots.select("node", F.col("node").alias("label")))
