"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  All
state stays in DataFrames; each round ends in a reliable checkpoint.  Neighbours
of a node of high degree are not brought into one task: its minimum goes to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    moved = common.join_by_size(both.filter("v > u"), least, "u", "n", 2 * total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = common.join_by_size(down, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root: the smallest node reachable, for every node with an edge.

    `edges` has two long columns; self loops, repetitions and both directions
    are allowed, rows with a null end are ignored.  No edge: an empty result.
    """
    common.shared_dir(edges.sparkSession)
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").checkpoint()
    seen, total = None, now.count()
    for _ in range(max_rounds):
        now = _small_star(_large_star(now, total), 2 * total).checkpoint()
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, total = sums, sums[0]
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
