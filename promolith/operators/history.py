"""Price history, discount statistics, episodes and product summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolith.numeric import grouped_quantiles, hours_between, rounded, weighted_mean, weighted_medians
from promolith.operators.prep import SERIES


def price_history(features: DataFrame, product_id: str | None = None, shop: str | None = None, category: str | None = None, group: str | None = None) -> DataFrame:
    """The observations that pass all given filters, by product and time."""
    wanted = {"canonical_product_id": product_id, "shop": shop, "category": category, "group": group}
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    kept = features.filter(reduce(lambda a, b: a & b, tests)) if tests else features
    return kept.select("canonical_product_id", "name", "shop", "category", "group", "date", "original_price", "promotion_price", "discount_pct", "match_status").orderBy("canonical_product_id", "date", "shop", "original_price", "promotion_price", "match_status", "name")


def price_timeline(states: DataFrame) -> DataFrame:
    """One row for each interval of constant price, with what it saves."""
    return states.select(
        "state_id", "canonical_product_id", "name", "shop", "category", "group", "episode_id", "first_seen", "last_seen", rounded(F.col("duration_hours"), 2).alias("duration_hours"), "n_obs",
        "original_price", "promotion_price", rounded(F.col("discount_pct"), 2).alias("discount_pct"), rounded(F.col("original_price") - F.col("promotion_price"), 2).alias("saving"),
    ).orderBy("shop", "canonical_product_id", "first_seen", "state_id").drop("state_id")


def discount_stats(states: DataFrame, by: str = "shop") -> DataFrame:
    """Spread of discounts by shop, category or group.

    A product counts once in a shop, with its median weighted by time; the
    statistics are over these.  `by` holds the key of the group.
    """
    if by not in ("shop", "category", "group"):
        raise ValueError("by must be shop, category or group")
    keys = [by, *(k for k in SERIES if k != by)]
    medians = weighted_medians(states, keys, {"discount": "discount_pct", "price": "promotion_price"}, "weight_hours")
    sizes = states.groupBy(*keys).agg(F.sum("weight_hours").alias("hours"), F.count(F.lit(1)).alias("n"), F.sum("n_obs").alias("obs"))
    each = sizes.join(medians, keys)
    got = each.groupBy(by).agg(
        F.count_distinct("canonical_product_id").alias("products"), F.sum("n").alias("price_states"), F.sum("obs").alias("observations"),
        weighted_mean("discount", "hours").alias("mean"), F.max("discount").alias("max"),
    )
    got = got.join(grouped_quantiles(each, [by], {"q": ("discount", (0.25, 0.5, 0.75, 0.95)), "p": ("price", (0.5,))}), by)
    return got.select(
        by, "products", "price_states", "observations", rounded(F.col("mean"), 2).alias("discount_mean"), rounded(F.col("q")[1], 2).alias("discount_median"), rounded(F.col("q")[0], 2).alias("discount_p25"),
        rounded(F.col("q")[2], 2).alias("discount_p75"), rounded(F.col("q")[3], 2).alias("discount_p95"), rounded(F.col("max"), 2).alias("discount_max"), rounded(F.col("p")[0], 2).alias("price_median"),
    ).orderBy(F.desc("discount_median"), by)


def promo_episodes(states: DataFrame) -> DataFrame:
    """One row for each unbroken presence of a product in a shop."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("state_id"))).alias(c)
    return (
        states.groupBy(*SERIES, "episode_id").agg(
            first("name"), first("category"), first("group"), F.count(F.lit(1)).alias("n_price_states"), F.min("first_seen").alias("started_at"), F.max("last_seen").alias("ended_at"),
            F.median("discount_pct").alias("median_discount"), F.max("discount_pct").alias("max_discount"), F.min("promotion_price").alias("min_price"), F.max("promotion_price").alias("max_price"),
        )
        .withColumn("duration_hours", rounded(hours_between(F.col("started_at"), F.col("ended_at")), 2))
        .withColumn("duration_days", rounded(F.col("duration_hours") / 24, 2))
        .withColumn("price_changed", F.col("n_price_states") > 1)
        .orderBy("shop", "started_at", "canonical_product_id")
    )


def product_promo_summary(states: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """One row for each series over the whole window."""
    episodes = promo_episodes(states) if episodes is None else episodes
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("episode_id"))).alias(c)
    got = episodes.groupBy(*SERIES).agg(
        first("name"), first("category"), first("group"), F.count_distinct("episode_id").alias("n_episodes"), F.sum("n_price_states").alias("n_price_states"),
        F.min("started_at").alias("first_seen"), F.max("ended_at").alias("last_seen"), rounded(F.sum("duration_hours"), 2).alias("promo_hours"),
        rounded(F.median("median_discount"), 2).alias("median_discount"), rounded(F.max("max_discount"), 2).alias("max_discount"),
        F.min("min_price").alias("lo"), F.max("max_price").alias("hi"),
    )
    return got.select(
        *SERIES, "name", "category", "group", "n_episodes", "n_price_states", "first_seen", "last_seen", "promo_hours", "median_discount", "max_discount",
        rounded(F.col("lo"), 2).alias("min_price"), rounded(F.col("hi"), 2).alias("max_price"), rounded(hours_between(F.col("first_seen"), F.col("last_seen")), 2).alias("observed_hours"),
        rounded(F.col("promo_hours") / 24, 2).alias("promo_days"), rounded((F.try_divide(F.col("hi"), F.col("lo")) - 1) * 100, 2).alias("price_spread_pct"),
    )
