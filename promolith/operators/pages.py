"""Raw products out of a DataFrame of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolith.functions import extract
from promolith.sources.sink import RAW


def is_blocked(html: Column) -> Column:
    """Whether a page is a challenge or an error instead of content; a null page is not."""
    low = F.lower(F.coalesce(html, F.lit("")))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", " "), r"\s+", " "))
    status = F.regexp_like(title, F.lit(r"^(error\s*)?(403|429|503)(\s+[^<]*)?$"))
    starts = F.startswith(title, F.lit(extract.BLOCK_STARTS[0])) | F.startswith(title, F.lit(extract.BLOCK_STARTS[1]))
    text = F.lit(False)
    for t in extract.BLOCK_TEXTS:
        text = text | F.contains(low, F.lit(t))
    return title.isin(*extract.BLOCK_TITLES) | starts | status | text


def shop_products(pages: DataFrame, shop: str, collected_at: str) -> DataFrame:
    """`extract_products` with the host and the card selectors of a known shop."""
    host, cards = extract.SHOPS[shop]
    return extract_products(pages, shop, host, collected_at, cards)


def extract_products(pages: DataFrame, shop: str, host: str, collected_at: str, cards: extract.Cards | dict | None = None) -> DataFrame:
    """Raw products (RAW) of pages (url, html); blocked pages give none.

    An address counts once in a page; `unique_products` makes it count once in all.
    """
    names = [f.name for f in RAW]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [p for url, html in zip(pdf["url"], pdf["html"]) for p in extract.products_from_html(html, shop, host, url or "", collected_at, cards)]
            yield pd.DataFrame(rows, columns=names)

    return pages.filter(~is_blocked(F.col("html"))).select("url", "html").mapInPandas(run, RAW)


LINKED = T.StructType([T.StructField("url", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("name", "gtin", "sku", "model", "variant", "brand", "category", "package", "price"))])


def linked_products(pages: DataFrame) -> DataFrame:
    """The JSON-LD product of each page that has one."""
    names = [f.name for f in LINKED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"url": u, **p} for u, h in zip(pdf["url"], pdf["html"]) if (p := extract.linked_product(h))], columns=names)

    return pages.select("url", "html").mapInPandas(run, LINKED)


def unique_products(products: DataFrame) -> DataFrame:
    """One product for each address, the one collected first."""
    rest = [c for c in products.columns if c != "source_url"]
    return products.groupBy("source_url").agg(F.min_by(F.struct(*rest), F.struct("collected_at", "source_product_id")).alias("p")).select("source_url", "p.*").select(*products.columns)
