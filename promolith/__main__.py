"""spark-submit entry: read observations from CSV, write the report's tables.

python -m promolith --input products.csv --out report [--top-favorites 20]
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from promolith.operators.report import build_report, run_summary
from promolith.sources.tables import export_report, load_products


def run_once(spark: SparkSession, source: str, out: str, top_favorites: int = 20) -> dict[str, int]:
    """Rows of each table written; nothing is written for an empty input."""
    products = load_products(spark, source)
    if products.isEmpty():
        return {}
    report = build_report(products, top_favorites)
    export_report(report, out)
    counts = {"observations": run_summary(products).first()["rows"]} | {name: table.count() for name, table in report.items()}
    spark.catalog.clearCache()  # after the counts, which use what is cached
    return counts


def run_service(spark: SparkSession, source: str, out: str, every: float = 3600.0, rounds: int | None = None, top_favorites: int = 20) -> int:
    """Run again and again, `every` seconds after the last run; a failed run is logged and the next one tried.

    Returns the number of failed runs after `rounds` of them (without: never).
    """
    failed = done = 0
    while rounds is None or done < rounds:
        try:
            logging.info("report: %s", run_once(spark, source, out, top_favorites))
        except Exception:
            failed += 1
            logging.exception("the report failed")
        done += 1
        if rounds is None or done < rounds:
            time.sleep(every)
    return failed


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--out", default="report")
    p.add_argument("--top-favorites", type=int, default=20)
    p.add_argument("--every", type=float, default=0.0, help="seconds between runs; 0: one run")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("promolith").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.every:
        run_service(spark, a.input, a.out, a.every, top_favorites=a.top_favorites)
    for name, n in run_once(spark, a.input, a.out, a.top_favorites).items():
        print(f"{name}: {n}")


if __name__ == "__main__":
    main()
