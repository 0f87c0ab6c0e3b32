"""The report: fourteen tables from one lineage of states and episodes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolith.config import FakePromoConfig
from promolith.operators import competitors, history, patterns, prep, scoring


def build_report(products: DataFrame, top_n_favorites: int = 20, fake_config: FakePromoConfig | None = None) -> dict[str, DataFrame]:
    """Named tables over observations; what they share is persisted once."""
    features = prep.add_features(prep.usable(products))
    states = prep.build_states(features).persist(StorageLevel.MEMORY_AND_DISK)
    episodes = history.promo_episodes(states).persist(StorageLevel.MEMORY_AND_DISK)
    summary = history.product_promo_summary(states, episodes)
    prices = competitors.per_shop_prices(states)
    return {
        "coverage": prep.coverage(features),
        "price_timeline": history.price_timeline(states),
        "product_summary": summary,
        "promo_episodes": episodes,
        "discount_by_shop": history.discount_stats(states, "shop"),
        "discount_by_category": history.discount_stats(states, "category"),
        "discount_by_group": history.discount_stats(states, "group"),
        "fake_promos": scoring.detect_fake_promos(states, fake_config),
        "promo_favorites": patterns.favorite_products(states, top_n_favorites, summary=summary),
        "group_promo_activity": patterns.group_promo_activity(states, summary),
        "weekday_lift": patterns.weekday_lift(features, episodes),
        "competitors": competitors.competitor_comparison(states, prices=prices),
        "shop_price_index": competitors.shop_price_index(states, prices),
        "group_price_comparison": competitors.group_price_comparison(states, prices),
    }


def run_summary(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("canonical_product_id").alias("products"), F.count_distinct("shop").alias("shops"))
