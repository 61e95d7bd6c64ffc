"""Connected components as joins and aggregates (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def star_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the component's smallest node.

    Each round hooks neighbours to the smallest node in reach, which at least halves the paths; it ends
    when a round changes nothing. Every step is an aggregate with map-side partial sums and an equi-join
    against it, so a node with very many neighbours is split by the join and never gathered. Rounds are
    written to the shared folder, and so are the sums that the edges are joined with, so that a
    hub's edges can be split. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
