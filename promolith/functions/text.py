"""Native column functions of the ingest: GTIN, ids, price texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(value: Column) -> Column:
    """The same value, which Spark takes for one that may change from call to call.

    A filter on a row that has it is not pushed below it, so what it is made of
    runs once, and after a shuffle that deals rows over tasks, not before.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def gtin14(raw: Column) -> Column:
    """A valid GTIN-8, -12, -13 or -14 as 14 digits, else null.

    Digits, white space and hyphens only; not all zeros; right check digit.
    """
    digits = F.translate(F.trim(raw), " \t\n\x0b\f\r-", "")
    padded = F.lpad(digits, 14, "0")
    value = lambda i: F.ascii(F.substring(padded, i, 1)) - ord("0")
    total = sum((value(i) * (3 if i % 2 == 1 else 1) for i in range(1, 14)), F.lit(0))  # written out, as a lambda is not compiled
    shaped = F.regexp_like(F.trim(raw), F.lit(r"^[0-9\s-]+$")) & F.length(digits).isin(8, 12, 13, 14) & ~F.regexp_like(digits, F.lit("^0+$"))
    return F.when(shaped & ((10 - total % 10) % 10 == value(14)), padded)


def gtin_status(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "missing").when(gtin14(raw).isNotNull(), "valid").otherwise("invalid")


def make_id(seed: Column) -> Column:
    return F.concat(F.lit("prod_"), F.substring(F.sha2(seed, 256), 1, 16))


def _digits(text: Column) -> Column:
    """Digits only, as kopecks-safe text; null if none."""
    return F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit(""))


def _money(text: Column) -> Column:
    """Kopecks of a bare number: a decimal tail, or a last group of two digits."""
    tail = F.nullif(F.regexp_extract(text, r"[,.]([0-9]{1,2})$", 1), F.lit(""))
    with_tail = F.coalesce(_digits(F.regexp_replace(text, r"[,.][0-9]{1,2}$", "")), F.lit("0")).cast("long") * 100 + F.rpad(tail, 2, "0").cast("long")
    groups = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    last = F.element_at(groups, -1)
    split = (F.size(groups) > 1) & (F.length(last) <= 2)
    head = F.array_join(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), "")
    in_groups = F.when(split, head.cast("long") * 100 + F.rpad(last, 2, "0").cast("long")).when(F.size(groups) > 0, F.array_join(groups, "").cast("long") * 100)
    return F.when(tail.isNotNull(), with_tail).otherwise(in_groups)


def price_kopecks(value: Column) -> Column:
    """Kopecks in a price text, null if there is no number.

    Percents are dropped; an amount with a currency sign wins over a bare
    number; "N коп" gives the kopecks.
    """
    text = F.trim(F.regexp_replace(F.translate(F.lower(value), "\u00a0", " "), r"[-+]?\d+(?:[,.]\d+)?\s*%", ""))
    small = F.nullif(F.regexp_extract(text, r"(?U)(\d{1,2})\s*коп", 1), F.lit(""))
    amount = F.nullif(F.trim(F.regexp_extract(text, r"(?U)([0-9][0-9\s.,]*?)\s*(?:₽|руб(?:\.|ль|ля|лей)?|р\.)(?=\s|$|/)", 1)), F.lit(""))
    number = F.nullif(F.trim(F.regexp_extract(text, r"(?U)([0-9][0-9\s.,]*)", 1)), F.lit(""))
    with_small = F.coalesce(_digits(amount), F.lit("0")).cast("long") * 100 + small.cast("long")
    return F.when(amount.isNotNull() & small.isNotNull(), with_small).when(amount.isNotNull(), _money(amount)).when(small.isNotNull(), small.cast("long")).otherwise(_money(number))
