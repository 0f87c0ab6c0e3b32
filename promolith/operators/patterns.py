"""Promotion activity: favourite products, groups, weekdays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolith import config
from promolith.numeric import grouped_quantiles, rounded
from promolith.operators.history import product_promo_summary

# What a favourite's score is made of.
WEIGHTS = {"promo_hours": 0.35, "n_episodes": 0.25, "n_price_states": 0.20, "median_discount": 0.20}


def favorite_products(states: DataFrame, top_n: int = 20, within_shop: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """The `top_n` highest scores, normalised and ranked in the shop or overall.

    A part of the score is the value's place between its extremes, 0.5 where
    they are equal.  Extremes are one row a scope; ranks come from a scope's
    distinct scores, of which there are 1001 at most.
    """
    rows = product_promo_summary(states) if summary is None else summary
    rows = rows.withColumn("__scope", F.col("shop") if within_shop else F.lit(""))
    ends = rows.groupBy("__scope").agg(*(f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))))

    def part(c: str) -> Column:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.when((hi == lo) | hi.isNull(), F.lit(0.5)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)))

    scored = rows.join(ends, "__scope").withColumn("score", rounded(sum((F.lit(k) * part(c) for c, k in WEIGHTS.items()), F.lit(0.0)), 3))
    above = F.sum("count").over(Window.partitionBy("__scope").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = scored.groupBy("__scope", "score").count().select("__scope", "score", (F.coalesce(above, F.lit(0)) + 1).cast("double").alias("rank_in_shop"))
    scored = scored.join(ranks, ["__scope", "score"])
    share = F.coalesce(F.col("promo_hours") / F.nullif(F.col("observed_hours"), F.lit(0.0)), F.lit(1.0))
    r3 = lambda c: rounded(F.col(c), 3).alias(c)
    return scored.select(
        "canonical_product_id", "shop", "name", "category", "group", "score", "rank_in_shop", "n_episodes", "n_price_states", "promo_days", rounded(share, 3).alias("promo_time_share"),
        r3("median_discount"), r3("max_discount"), r3("min_price"), r3("max_price"), r3("price_spread_pct"),
    ).orderBy(F.desc("score"), "shop", "canonical_product_id").limit(top_n)


def group_promo_activity(states: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Which groups a shop keeps in promotion."""
    rows = product_promo_summary(states) if summary is None else summary
    table = rows.groupBy("shop", "category", "group").agg(
        F.count_distinct("canonical_product_id").alias("products"), F.sum("n_episodes").alias("episodes"), rounded(F.sum("promo_days"), 3).alias("promo_days")
    )
    keys = ["shop", "category", "group"]
    medians = grouped_quantiles(rows, keys, {"q": ("median_discount", (0.5,))}).select(*keys, rounded(F.col("q")[0], 3).alias("median_discount"))
    table = table.join(medians, keys, "left").select(*keys, "products", "episodes", "promo_days", "median_discount")
    share = F.col("products") / F.sum("products").over(Window.partitionBy("shop"))
    return table.withColumn("share_of_shop_products", rounded(share, 3)).orderBy("shop", F.desc("products"), "group")


def observed_weekdays(features: DataFrame, by_shop: bool = True) -> DataFrame:
    """How many dates of each weekday were observed."""
    return features.groupBy(*(["shop"] if by_shop else []), "weekday").agg(F.count_distinct("day").alias("days_observed"))


def active_per_day(features: DataFrame, by_shop: bool = True) -> DataFrame:
    """Mean number of products in promotion on a date of each weekday."""
    keys = ["shop", "weekday"] if by_shop else ["weekday"]
    return features.groupBy(*keys, "day").agg(F.count_distinct("canonical_product_id").alias("products")).groupBy(*keys).agg(F.avg("products").alias("active_per_day"))


def weekday_lift(features: DataFrame, episodes: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """Starts of promotions by weekday, for each shop and for ALL.

    Shares are smoothed by `alpha`; weekdays never observed are zero rows.
    """
    days = F.explode(F.sequence(F.lit(0), F.lit(6)))

    def level(by_shop: bool) -> DataFrame:
        keys = ["shop", "weekday"] if by_shop else ["weekday"]
        table = observed_weekdays(features, by_shop).join(active_per_day(features, by_shop), keys, "left")
        if episodes is not None:
            table = table.join(episodes.groupBy(*(["shop"] if by_shop else []), F.weekday("started_at").alias("weekday")).agg(F.count(F.lit(1)).alias("promo_starts")), keys, "left")
        else:
            table = table.withColumn("promo_starts", F.lit(0).cast("long"))
        if not by_shop:
            table = table.withColumn("shop", F.lit("ALL"))
        grid = table.select("shop").distinct().select("shop", days.alias("weekday"))
        return grid.join(table, ["shop", "weekday"], "left").select("shop", "weekday", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("days_observed", "active_per_day", "promo_starts")))

    both = level(True).unionByName(level(False))
    starts = F.sum("promo_starts").over(Window.partitionBy("shop"))
    share = (F.col("promo_starts") + alpha) / (starts + 7 * alpha)
    return both.select(
        "shop", "weekday", F.element_at(F.array(*map(F.lit, config.WEEKDAYS)), F.col("weekday") + 1).alias("weekday_name"), "days_observed", "promo_starts",
        rounded(F.col("promo_starts") / F.nullif(F.col("days_observed"), F.lit(0)), 4).alias("starts_per_day"), rounded(F.col("active_per_day"), 4).alias("active_per_day"),
        rounded(share, 4).alias("starts_share"), rounded(share / F.lit(1 / 7), 4).alias("lift"), (F.col("days_observed") >= 2).alias("reliable"),
    ).orderBy("shop", "weekday")
