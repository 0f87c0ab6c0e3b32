"""Prices of the same product, or the same group, in several shops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolith.config import TRUSTED_MATCH
from promolith.numeric import grouped_quantiles, rounded, weighted_medians
from promolith.operators.prep import SERIES


def per_shop_prices(states: DataFrame) -> DataFrame:
    """One row for each series: medians weighted by time, most frequent status."""
    told = states.groupBy(*SERIES).agg(*(F.min_by(c, "state_id").alias(c) for c in ("name", "category", "group")), F.mode("match_status", True).alias("match_status"))
    return told.join(weighted_medians(states, SERIES, {"promo_price": "promotion_price", "discount_pct": "discount_pct"}, "weight_hours"), SERIES)


def competitor_comparison(states: DataFrame, trusted_only: bool = False, prices: DataFrame | None = None) -> DataFrame:
    """Products in two shops or more: spread of prices, best and worst shop."""
    rows = per_shop_prices(states) if prices is None else prices
    if trusted_only:
        rows = rows.filter(F.col("match_status").isin(*TRUSTED_MATCH))
    known = F.when(F.col("match_status") == "provisional", 1.0).otherwise(0.0)
    got = rows.groupBy("canonical_product_id").agg(
        *(F.min_by(c, "shop").alias(c) for c in ("name", "category", "group")), F.count(F.lit(1)).alias("n_shops"), F.min("promo_price").alias("min_price"), F.median("promo_price").alias("median_price"),
        F.max("promo_price").alias("max_price"), F.min_by("shop", F.struct("promo_price", "shop")).alias("best_shop"), F.min_by("shop", F.struct(-F.col("promo_price"), F.col("shop"))).alias("worst_shop"),
        rounded(F.avg(known), 2).alias("provisional_share"), F.bool_and(F.col("match_status") != "provisional").alias("reliable"),
    ).filter("n_shops >= 2")
    spread = F.col("max_price") - F.col("min_price")
    return got.select(
        "canonical_product_id", "name", "category", "group", "n_shops", "min_price", "median_price", "max_price", rounded(F.try_divide(spread, F.col("min_price")) * 100, 2).alias("dispersion_pct"),
        rounded(F.try_divide(spread, F.col("max_price")) * 100, 2).alias("savings_pct"), "best_shop", "worst_shop", "provisional_share", "reliable",
    ).orderBy(F.desc("dispersion_pct"), "canonical_product_id")


def shop_price_index(states: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Mean price against the cheapest shop, over comparable products."""
    rows = per_shop_prices(states) if prices is None else prices
    w = Window.partitionBy("canonical_product_id")
    index = rows.withColumns({"n": F.count(F.lit(1)).over(w), "index": F.col("promo_price") / F.min("promo_price").over(w)}).filter("n >= 2")
    return index.groupBy("shop").agg(
        rounded(F.avg("index"), 3).alias("avg_price_index"), F.count_distinct("canonical_product_id").alias("n_comparable_products"), rounded(F.avg(F.when(F.col("index") <= 1, 1.0).otherwise(0.0)), 3).alias("cheapest_share")
    ).orderBy("avg_price_index", "shop")


def group_price_comparison(states: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Shops against each other inside a product group."""
    rows = per_shop_prices(states) if prices is None else prices
    keys = ["category", "group", "shop"]
    table = rows.groupBy(*keys).agg(F.count_distinct("canonical_product_id").alias("products"), F.max("discount_pct").alias("xd"))
    medians = grouped_quantiles(rows, keys, {"d": ("discount_pct", (0.5,)), "p": ("promo_price", (0.5,))})
    table = table.join(medians.select(*keys, F.col("d")[0].alias("md"), F.col("p")[0].alias("mp")), keys, "left")
    w = Window.partitionBy("group")
    return table.select(
        "category", "group", "shop", "products", rounded(F.col("md"), 2).alias("median_discount"), rounded(F.col("xd"), 2).alias("max_discount"), rounded(F.col("mp"), 2).alias("median_price"),
        (F.size(F.collect_set("shop").over(w)) >= 2).alias("comparable"), F.rank().over(w.orderBy(F.desc("md"))).cast("double").alias("discount_rank_in_group"),
    ).orderBy(F.desc("comparable"), "group", F.desc("median_discount"), "shop")
