"""Validation of events at the boundaries; valid rows and rejects apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolith.config import MATCH_STATUSES

# Fields, their longest lengths, the largest price in kopecks.
MAX_KOPECKS = 999_999_999_999
EVENT_LENGTHS = {"canonical_product_id": 100, "name": 1000, "shop": 50, "date": 100, "match_status": 20}
RAW_LENGTHS = {
    "shop": 50, "source_url": 2000, "source_product_id": 500, "name_raw": 1000, "gtin_raw": 100, "model_raw": 500, "variant_raw": 500, "brand_raw": 500,
    "category_raw": 500, "package_raw": 500, "current_price_text": 200, "old_price_text": 200, "collected_at": 100,
}

EVENT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("canonical_product_id", "name", "shop", "date")),
    T.StructField("original_price_kopecks", T.LongType()), T.StructField("promotion_price_kopecks", T.LongType()), T.StructField("match_status", T.StringType()),
])
RAW = T.StructType([
    T.StructField("shop", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("source_product_id", T.StringType()), T.StructField("source_id_is_stable", T.BooleanType()),
    *(T.StructField(n, T.StringType()) for n in ("name_raw", "gtin_raw", "model_raw", "variant_raw", "brand_raw", "category_raw", "package_raw", "current_price_text", "old_price_text", "collected_at")),
])

_ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def rubles(kopecks: Column) -> Column:
    """decimal(12,2) of a positive, not too large number of kopecks, else null."""
    return F.when((kopecks > 0) & (kopecks <= MAX_KOPECKS), (kopecks.cast("decimal(14,0)") / F.lit(100)).cast("decimal(12,2)"))


def zoned_time(text: Column) -> Column:
    """The instant of ISO text with a time zone, else null."""
    return F.when(F.regexp_like(text, F.lit(_ISO_ZONED)), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def _failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold; null counts as not."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def check_events(events: DataFrame) -> DataFrame:
    """`events` with `errors` and the columns of the promotions table in `row`."""
    checks = {f"{c}_text": (F.trim(c) != "") & (F.length(c) <= n) for c, n in EVENT_LENGTHS.items()}
    checks |= {
        "match_status": F.col("match_status").isin(*MATCH_STATUSES), "date_zone": zoned_time(F.col("date")).isNotNull(),
        "original_price": rubles(F.col("original_price_kopecks")).isNotNull(), "promotion_price": rubles(F.col("promotion_price_kopecks")).isNotNull(),
        "discount": F.col("original_price_kopecks") > F.col("promotion_price_kopecks"),
    }
    row = F.struct(
        "canonical_product_id", "name", "shop", F.date_trunc("millisecond", zoned_time(F.col("date"))).alias("date"),
        rubles(F.col("original_price_kopecks")).alias("original_price"), rubles(F.col("promotion_price_kopecks")).alias("promotion_price"), "match_status",
    )
    return events.withColumn("errors", _failed(checks)).withColumn("row", row)


def valid_rows(events: DataFrame) -> DataFrame:
    return check_events(events).filter(F.size("errors") == 0).select("row.*")


def rejected_rows(events: DataFrame) -> DataFrame:
    return check_events(events).filter(F.size("errors") > 0).drop("row")


def check_raw(products: DataFrame) -> DataFrame:
    """Raw products with `errors`: texts, lengths, shop, URL, identifier, time."""
    text = {f"{c}_text": F.coalesce(F.length(c) <= n, F.lit(c == "gtin_raw")) for c, n in RAW_LENGTHS.items()}
    checks = text | {
        "shop": F.regexp_like("shop", F.lit("^[a-z0-9_-]+$")), "source_id_is_stable": F.col("source_id_is_stable").isNotNull(), "source_product_id": F.trim("source_product_id") != "",
        "name_raw": F.trim("name_raw") != "", "source_url": F.regexp_like("source_url", F.lit(r"^https?://[^/?#\s]+")), "collected_at": zoned_time(F.col("collected_at")).isNotNull(),
    }
    return products.withColumn("errors", _failed(checks))
