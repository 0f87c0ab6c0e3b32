"""Counters of the ingest: as tables, and observed while a batch is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from promolith.functions.text import gtin_status

# Upper bounds of the buckets of match scores.
SCORE_BUCKETS = (0.0, 0.5, 0.68, 0.8, 0.88, 0.95, 1.0)
METHODS = ("gtin", "source_id", "confirmed_alias", "attribute_match", "new_gtin", "review", "provisional", "quarantine")


def match_counts(resolved: DataFrame) -> DataFrame:
    """method, status, n of a batch's decisions."""
    return resolved.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


def score_buckets(resolved: DataFrame) -> DataFrame:
    """method, and how many scores reach at most each bound."""
    return resolved.groupBy("method").agg(*(F.count_if(F.col("score") <= b).alias(f"le_{b:g}") for b in SCORE_BUCKETS))


def conflict_counts(resolved: DataFrame) -> DataFrame:
    """field, n: decisions that a conflict of the field stopped."""
    return resolved.select(F.explode(F.array_distinct("conflicts")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def gtin_counts(products: DataFrame) -> DataFrame:
    """status (valid, invalid, missing), n."""
    return products.groupBy(gtin_status(F.col("gtin_raw")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def observed(resolved: DataFrame, name: str = "matches") -> tuple[DataFrame, Observation]:
    """`resolved`, and what is counted while it is written: no pass of its own."""
    watch = Observation(name)
    counts = [F.count_if(F.col("method") == m).alias(m) for m in METHODS]
    return resolved.observe(watch, F.count(F.lit(1)).alias("normalized"), *counts, F.count_if(F.size("conflicts") > 0).alias("conflicting")), watch
