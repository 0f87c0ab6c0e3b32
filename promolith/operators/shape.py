"""Tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolith.numeric import grouped_quantiles, hours_between, rounded
from promolith.operators.prep import SERIES
from promolith.operators.scoring import LEVELS


def discount_distribution(states: DataFrame, by: str = "group", top_n: int = 12) -> DataFrame:
    """Five-number summary of discounts for the `top_n` highest medians."""
    got = states.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(grouped_quantiles(states, [by], {"q": ("discount_pct", (0.0, 0.25, 0.5, 0.75, 1.0))}), by)
    return got.select(by, "n", *(F.col("q")[k].alias(name) for k, name in enumerate(("low", "p25", "median", "p75", "high")))).orderBy(F.desc("median"), by).limit(top_n)


def changing_products(states: DataFrame, top_n: int = 6) -> DataFrame:
    """Series with several states, most states first; if there is none, those
    observed most."""
    counted = states.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_states"), F.sum("n_obs").alias("n_obs"))
    several = counted.agg(F.max("n_states").alias("most"))
    chosen = counted.crossJoin(F.broadcast(several)).filter("n_states > 1 or most <= 1")
    return chosen.orderBy(F.desc(F.when(F.col("most") > 1, F.col("n_states")).otherwise(F.col("n_obs"))), *SERIES).limit(top_n).drop("most")


def level_counts(fake: DataFrame) -> DataFrame:
    """Series of each level in each shop, a column a level."""
    table = fake.groupBy("shop").pivot("level", list(LEVELS)).count().fillna(0, list(LEVELS))
    return table.withColumn("total", sum((F.col(c) for c in LEVELS), F.lit(0))).orderBy(F.desc("total"), "shop")


def flag_counts(fake: DataFrame) -> DataFrame:
    """How often each rule fired."""
    return fake.select(F.explode(F.split("flags", "\\|")).alias("flag")).filter("flag != ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flag")


def flagged_total(fake: DataFrame) -> DataFrame:
    """How many series have a flag, of all."""
    return fake.agg(F.count_if(F.col("flags") != "").alias("flagged"), F.count(F.lit(1)).alias("total"))


def group_shop_heatmap(groups: DataFrame, shops: list[str], top_n: int = 14) -> DataFrame:
    """Mean of median discounts, groups by shops, for the largest groups.

    `groups` is the result of group_price_comparison.
    """
    top = groups.groupBy("group").agg(F.sum("products").alias("p")).orderBy(F.desc("p"), "group").limit(top_n)
    table = groups.join(top, "group", "left_semi").groupBy("group").pivot("shop", shops).agg(F.avg("median_discount"))
    cells = [F.col(f"`{s}`") for s in shops]
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0)) / F.nullif(sum((c.isNotNull().cast("int") for c in cells), F.lit(0)), F.lit(0))
    return table.withColumn("row_mean", mean).orderBy(F.desc("row_mean"), "group")


def weekday_slice(lift: DataFrame, shop: str = "ALL") -> DataFrame:
    """One shop's weekdays in short: reliable days, most dates of any other."""
    return lift.filter(F.col("shop") == shop).agg(
        F.count(F.lit(1)).alias("weekdays"), F.count_if("reliable").alias("reliable_days"), F.coalesce(F.max(F.when(~F.col("reliable"), F.col("days_observed"))), F.lit(0)).alias("most_unreliable_days")
    )


def top_dispersion(comparison: DataFrame, top_n: int = 10) -> DataFrame:
    return comparison.orderBy(F.desc("dispersion_pct"), "canonical_product_id").limit(top_n)


def any_ready(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.coalesce(F.bool_or("weekday_analysis_ready"), F.lit(False)).alias("any_ready"))


def dashboard_meta(features: DataFrame) -> DataFrame:
    """Observations, products, shops and hours of the whole window."""
    return features.agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("canonical_product_id").alias("products"), F.count_distinct("shop").alias("shops"),
        rounded(hours_between(F.min("date"), F.max("date")), 2).alias("window_hours"),
    )
