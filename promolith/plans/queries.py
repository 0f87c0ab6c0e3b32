"""The registered promotion queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolith.functions import text
from promolith.operators import competitors, history, identity, pages, patterns, prep, report, scoring, shape
from promolith.plans import adapter
from promolith.sources import catalog, sink, tables

TIMES = ("date", "first_seen", "last_seen", "started_at", "ended_at")


def _out(df: DataFrame, digits: int = 6, rounded: tuple[str, ...] = ()) -> DataFrame:
    """Times without a zone, and the named doubles rounded."""
    changed = {c: F.col(c).cast("timestamp_ntz") for c in TIMES if c in df.columns}
    return df.withColumns(changed | {c: F.round(c, digits) for c in rounded})


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.add_features(prep.usable(adapter.observations(spark, sf_dir)))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted, as most tables read them more than once."""
    return prep.build_states(_features(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)


def features(spark, sf_dir):
    cols = ["canonical_product_id", "shop", "name", "group", "category", "day", "weekday", "sequence"]
    return _features(spark, sf_dir).select(*cols, prep.rounded(F.col("discount_pct"), 6).alias("discount_pct"))


def poll_interval(spark, sf_dir):
    interval = prep.median_interval_hours(_features(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(interval), 6).alias("interval_hours"), F.round(F.lit(prep.gap_hours_for(interval)), 6).alias("gap_hours"))


def price_history_filter(spark, sf_dir):
    got = history.price_history(_features(spark, sf_dir), shop="lenta", category="продукты")
    return _out(got.withColumn("discount_pct", prep.rounded(F.col("discount_pct"), 6)))


def fake_promos(spark, sf_dir):
    got = scoring.detect_fake_promos(_states(spark, sf_dir))
    told = {
        "jump_growth_pct": "old_price_jump.growth_pct", "rise_growth_pct": "promo_price_rise.growth_pct", "both_growth_pct": "both_prices_rise.promo_growth_pct", "swing_pp": "depth_swing.swing_pp",
        "discount_low": "depth_swing.discount_min", "best_price": "worse_than_best.best_price", "overpay_pct": "worse_than_best.overpay_pct",
    }
    return got.withColumns({name: F.get_json_object("evidence", f"$.{path}").cast("double") for name, path in told.items()}).drop("evidence")


def _heatmap(spark, sf_dir):
    shops = list(adapter.SHOPS.values())
    got = shape.group_shop_heatmap(competitors.group_price_comparison(_states(spark, sf_dir)), shops)
    return _out(got, rounded=(*shops, "row_mean"))


def _api(f):
    def run(spark, sf_dir):
        rows = adapter.promotions(spark, sf_dir)
        end = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
        return f(rows, "sequence", end, 30)

    return run


def _lift(spark, sf_dir):
    features_ = _features(spark, sf_dir)
    return patterns.weekday_lift(features_, history.promo_episodes(prep.build_states(features_)))


def _gtins(spark, sf_dir):
    """Every third code has its check digit replaced by 0."""
    rows = adapter.raw_products(spark, sf_dir).withColumn("k", F.col("source_product_id").cast("long"))
    return rows.withColumn("gtin_raw", F.when(F.col("k") % 3 == 0, F.concat(F.substring("gtin_raw", 1, 12), F.lit("0"))).otherwise(F.col("gtin_raw")))


def gtin_check(spark, sf_dir):
    return _gtins(spark, sf_dir).select("k", text.gtin14(F.col("gtin_raw")).alias("gtin"), text.gtin_status(F.col("gtin_raw")).alias("status"))


def make_ids(spark, sf_dir):
    rows = adapter.raw_products(spark, sf_dir)
    return rows.select("source_product_id", text.make_id(F.concat(F.lit("source:"), "shop", F.lit(":"), "source_product_id")).alias("product_id"))


def price_parse(spark, sf_dir):
    rows = adapter.raw_products(spark, sf_dir)
    return rows.select("source_product_id", text.price_kopecks(F.col("current_price_text")).alias("current_kopecks"), text.price_kopecks(F.col("old_price_text")).alias("old_kopecks"))


def csv_escape(spark, sf_dir):
    rows = adapter.observations(spark, sf_dir)
    sign = F.element_at(F.array(*map(F.lit, ("=", " +", "-", "@", "", "x="))), (F.col("sequence") % 6 + 1).cast("int"))
    return rows.select("sequence", tables.csv_value(F.concat(sign, F.col("shop"))).alias("value"))


def sink_valid(spark, sf_dir):
    rows = sink.check_events(adapter.events(spark, sf_dir)).filter(F.size("errors") == 0)
    return _out(rows.select("sequence", "row.canonical_product_id", "row.name", "row.date", F.col("row.original_price").cast("double").alias("original_price"), F.col("row.promotion_price").cast("double").alias("promotion_price")))


def sink_rejects(spark, sf_dir):
    return sink.rejected_rows(adapter.events(spark, sf_dir)).select("sequence", F.array_join(F.array_sort("errors"), ",").alias("errors"))


def identity_resolution(spark, sf_dir):
    got = identity.resolve(adapter.raw_products(spark, sf_dir), adapter.catalog(spark, sf_dir))
    return got.select("source_key", "canonical_product_id", "canonical_name", "method", F.round("score", 4).alias("score"), "status", F.array_join("conflicts", ",").alias("conflicts"))


def identity_gtin(spark, sf_dir):
    """The rows that a GTIN of the whole catalog settles."""
    got = identity.resolve(adapter.raw_products(spark, sf_dir), adapter.catalog(spark, sf_dir), gtin_only=True)
    return got.select("source_key", "canonical_product_id", "status")


def identity_events(spark, sf_dir):
    return identity.normalized_events(adapter.raw_products(spark, sf_dir), adapter.catalog(spark, sf_dir))


def block_keys(spark, sf_dir):
    rows = identity.prepare(adapter.raw_products(spark, sf_dir)).withColumn("sizes", identity.size_keys("attributes.measurements"))
    return rows.select("source_key", F.array_join(identity.block_keys(F.col("attributes"), F.col("sizes")), ",").alias("keys"))


def blocked_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", pages.is_blocked(F.col("html")).alias("blocked"))


def linked_products(spark, sf_dir):
    return pages.linked_products(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def page_products(spark, sf_dir):
    got = pages.unique_products(pages.shop_products(adapter.shop_pages(spark, sf_dir), "holodilnik", "2026-09-16T10:00:00+00:00"))
    return got.select("shop", "source_url", "source_product_id", "source_id_is_stable", "name_raw", "brand_raw", "current_price_text", "old_price_text")


def blocked_titles(spark, sf_dir):
    """Every page under one of six titles by its number."""
    titles = ("403 Forbidden", "Just a moment...", "  Access   Denied ", "Error 429", "Tea 503", "Доступ ограничен")
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("page_id") % 6 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", pages.is_blocked(F.concat(F.lit("<HTML><TITLE lang='x'>"), title, F.lit("</TITLE><p>text</p>"))).alias("blocked"))


def _trusted_states(spark, sf_dir):
    """Products of even number are confirmed in all shops but one."""
    rows = adapter.observations(spark, sf_dir)
    sure = (F.substring("canonical_product_id", 6, 2).cast("int") % 2 == 0) & (F.col("shop") != "magnit")
    return prep.build_states(prep.add_features(prep.usable(rows.withColumn("match_status", F.when(sure, "confirmed").otherwise(F.col("match_status"))))))


def load_promotions(spark, sf_dir):
    end = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
    return _out(tables.load_promotions(adapter.promotions(spark, sf_dir), "sequence", end, 30))


def raw_checks(spark, sf_dir):
    checked = sink.check_raw(adapter.broken_products(spark, sf_dir))
    return checked.select("k", F.array_join(F.array_sort("errors"), ",").alias("errors"))


def identity_match(spark, sf_dir):
    """Every part finds the catalog's product of its words, brand, size and type."""
    rows = adapter.raw_products(spark, sf_dir).withColumn("gtin_raw", F.lit(None).cast("string"))
    got = identity.resolve(rows, adapter.unlike_catalog(spark, sf_dir))
    return got.select("source_key", "canonical_product_id", "method", F.round("score", 4).alias("score"), "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "features": features,
    "keyword_group": lambda s, d: _features(s, d).select("name", "shop", "group", "category").distinct(),
    "poll_interval": poll_interval,
    "coverage": lambda s, d: _out(prep.coverage(_features(s, d))),
    "any_ready": lambda s, d: shape.any_ready(prep.coverage(_features(s, d))),
    "price_history_filter": price_history_filter,
    "price_states": lambda s, d: _out(_states(s, d), rounded=("duration_hours", "weight_hours", "discount_pct")),
    "price_timeline": lambda s, d: _out(history.price_timeline(_states(s, d))),
    "promo_episodes": lambda s, d: _out(history.promo_episodes(_states(s, d)), rounded=("median_discount", "max_discount")),
    "product_summary": lambda s, d: _out(history.product_promo_summary(_states(s, d))),
    "discount_by_shop": lambda s, d: history.discount_stats(_states(s, d), "shop"),
    "discount_by_category": lambda s, d: history.discount_stats(_states(s, d), "category"),
    "discount_by_group": lambda s, d: history.discount_stats(_states(s, d), "group"),
    "fake_promos": fake_promos,
    "level_pivot": lambda s, d: shape.level_counts(scoring.detect_fake_promos(_states(s, d))),
    "flag_counts": lambda s, d: shape.flag_counts(scoring.detect_fake_promos(_states(s, d))),
    "flagged_total": lambda s, d: shape.flagged_total(scoring.detect_fake_promos(_states(s, d))),
    "favorites": lambda s, d: patterns.favorite_products(_states(s, d)),
    "group_promo_activity": lambda s, d: patterns.group_promo_activity(_states(s, d)),
    "observed_weekdays": lambda s, d: patterns.observed_weekdays(_features(s, d)),
    "active_per_day": lambda s, d: _out(patterns.active_per_day(_features(s, d)), rounded=("active_per_day",)),
    "weekday_lift": _lift,
    "weekday_slice": lambda s, d: shape.weekday_slice(_lift(s, d)),
    "competitors": lambda s, d: competitors.competitor_comparison(_states(s, d)),
    "competitors_trusted": lambda s, d: competitors.competitor_comparison(_states(s, d), trusted_only=True),
    "top_dispersion": lambda s, d: shape.top_dispersion(competitors.competitor_comparison(_states(s, d))),
    "shop_price_index": lambda s, d: competitors.shop_price_index(_states(s, d)),
    "group_price_comparison": lambda s, d: competitors.group_price_comparison(_states(s, d)),
    "group_shop_heatmap": _heatmap,
    "discount_distribution": lambda s, d: _out(shape.discount_distribution(_states(s, d)), rounded=("low", "p25", "median", "p75", "high")),
    "changing_products": lambda s, d: shape.changing_products(_states(s, d)),
    "dashboard_meta": lambda s, d: shape.dashboard_meta(_features(s, d)),
    "run_summary": lambda s, d: report.run_summary(adapter.observations(s, d)),
    "dedup_final": lambda s, d: _out(tables.latest_rows(adapter.promotions(s, d), "sequence")),
    "latest_products": lambda s, d: _out(tables.products_csv(adapter.promotions(s, d), "sequence")),
    "gtin_check": gtin_check,
    "make_id": make_ids,
    "price_parse": price_parse,
    "csv_escape": csv_escape,
    "sink_valid": sink_valid,
    "sink_rejects": sink_rejects,
    "identity_resolution": identity_resolution,
    "identity_gtin": identity_gtin,
    "identity_events": identity_events,
    "block_keys": block_keys,
    "blocked_pages": blocked_pages,
    "linked_products": linked_products,
    "page_products": page_products,
    "linked_parts": lambda s, d: pages.linked_products(adapter.linked_pages(s, d)),
    "blocked_titles": blocked_titles,
    "trusted_shops": lambda s, d: competitors.competitor_comparison(_trusted_states(s, d), trusted_only=True),
    "favorites_overall": lambda s, d: patterns.favorite_products(_states(s, d), within_shop=False),
    "load_promotions": load_promotions,
    "raw_checks": raw_checks,
    "gtin_counts": lambda s, d: _gtins(s, d).groupBy(text.gtin_status(F.col("gtin_raw")).alias("status")).agg(F.count(F.lit(1)).alias("n")),
    "price_formats": lambda s, d: adapter.price_texts(s, d).select("k", text.price_kopecks(F.col("text")).alias("kopecks")),
    "normalized_names": lambda s, d: adapter.name_texts(s, d).select("k", identity.normalized("name").alias("name")),
    "source_keys": lambda s, d: adapter.broken_products(s, d).select("k", identity.source_key(F.col("shop"), F.col("source_product_id"), F.col("k") % 4 > 0, F.col("name_raw")).alias("source_key")),
    "catalog_issues": lambda s, d: catalog.catalog_problems(catalog.parse_catalog(adapter.catalog_lines(s, d))),
    "identity_match": identity_match,
    "api_summary": _api(tables.analytics_summary),
    "api_by_shop": _api(tables.analytics_by_shop),
}
