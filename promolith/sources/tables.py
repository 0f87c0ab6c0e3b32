"""Reading observations, the deduplicated view, and writing reports."""

from __future__ import annotations

import os
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolith.operators.prep import REQUIRED, discount_pct, usable
from promolith.numeric import grouped_quantiles, rounded

KEY = ["canonical_product_id", "shop", "date", "original_price", "promotion_price"]
PRODUCT_TYPES = {"date": "timestamp", "original_price": "double", "promotion_price": "double"}
PROMOTIONS = T.StructType([
    T.StructField("canonical_product_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("shop", T.StringType()), T.StructField("date", T.TimestampType()),
    T.StructField("original_price", T.DecimalType(12, 2)), T.StructField("promotion_price", T.DecimalType(12, 2)), T.StructField("match_status", T.StringType()),
])


def load_products(spark: SparkSession, path: str) -> DataFrame:
    """Observations from CSV with a header; ValueError names missing columns."""
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(PRODUCT_TYPES.get(n, "string"))) for n in names])
    return usable(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path))


def latest_rows(promotions: DataFrame, sequence: str) -> DataFrame:
    """One row for each key: the one with the largest `sequence`.

    An aggregate with map-side combine, not a window: a key's repetitions are
    folded before the shuffle.
    """
    rest = [c for c in promotions.columns if c not in (*KEY, sequence)]
    got = promotions.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(F.col(sequence), *rest)).alias("__r"))
    return got.select(*KEY, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*[c for c in promotions.columns if c != sequence])


def since(df: DataFrame, days: int, as_of: Column | datetime) -> DataFrame:
    """Rows of the last `days` days before `as_of`; 1 to 3650 are allowed."""
    if not 1 <= days <= 3650:
        raise ValueError("days must be from 1 to 3650")
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.filter(F.col("date") >= end - F.make_dt_interval(F.lit(days)))


def load_promotions(promotions: DataFrame, sequence: str, as_of: Column | datetime, days: int = 3650) -> DataFrame:
    """The analyzers' input from the promotions table."""
    return usable(since(latest_rows(promotions, sequence), days, as_of).select(*REQUIRED))


def products_csv(promotions: DataFrame, sequence: str, limit: int = 100) -> DataFrame:
    """The newest rows, with texts safe to open in a spreadsheet."""
    top = latest_rows(promotions, sequence).select(*REQUIRED).orderBy(F.desc("date"), *[c for c in REQUIRED if c != "date"]).limit(limit)
    return top.withColumns({f.name: csv_value(F.col(f.name)) for f in top.schema if isinstance(f.dataType, T.StringType)})


def csv_value(text: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote before it."""
    return F.when(F.regexp_like(text, F.lit(r"^\s*[=+\-@]")), F.concat(F.lit("'"), text)).otherwise(text)


def _analytics(promotions: DataFrame, sequence: str, as_of: Column | datetime, days: int, by: list[str]) -> DataFrame:
    discount = discount_pct(F.col("original_price").cast("double"), F.col("promotion_price").cast("double"))
    rows = since(latest_rows(promotions, sequence), days, as_of).withColumn("__d", discount)
    counts = [F.count(F.lit(1)).alias("observations"), F.count_distinct("canonical_product_id").alias("products"), *([] if by else [F.count_distinct("shop").alias("shops")])]
    got = rows.groupBy(*by).agg(*counts, rounded(F.avg("__d"), 2).alias("avg_discount_pct"))
    medians = grouped_quantiles(rows, by, {"__q": ("__d", (0.5,))})
    joined = got.join(medians, by, "left") if by else got.join(medians, F.lit(True), "left")  # one row each
    return joined.withColumn("median_discount_pct", rounded(F.col("__q")[0], 2)).drop("__q")


def analytics_summary(promotions: DataFrame, sequence: str, as_of: Column | datetime, days: int = 30) -> DataFrame:
    """Counts, mean and median discount of the last days."""
    return _analytics(promotions, sequence, as_of, days, [])


def analytics_by_shop(promotions: DataFrame, sequence: str, as_of: Column | datetime, days: int = 30) -> DataFrame:
    """The same for each shop, most observations first."""
    return _analytics(promotions, sequence, as_of, days, ["shop"]).orderBy(F.desc("observations"), "shop")


def export_report(report: dict[str, DataFrame], out_dir: str) -> list[str]:
    """One CSV file for each table, UTF-8 with a byte order mark.

    Rows are streamed to the file, a partition at a time.
    """
    os.makedirs(out_dir, exist_ok=True)
    paths = []
    for name, table in report.items():
        path = os.path.join(out_dir, f"{name}.csv")
        pd.DataFrame(columns=table.columns).to_csv(path, index=False, encoding="utf-8-sig")
        block: list = []
        for row in table.toLocalIterator():
            block.append(tuple(row))
            if len(block) == 10_000:
                pd.DataFrame(block, columns=table.columns).to_csv(path, index=False, header=False, mode="a", encoding="utf-8")
                block = []
        if block:
            pd.DataFrame(block, columns=table.columns).to_csv(path, index=False, header=False, mode="a", encoding="utf-8")
        paths.append(path)
    return paths
