"""Rounding, exact quantiles and weighted statistics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half-even on the scaled binary value (null stays null)."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


SMALL = 200_000  # distinct values that one task may sort


def exact_quantile(df: DataFrame, column: str, q: float, buckets: int = 4096, small: int = SMALL) -> float | None:
    """The linearly interpolated quantile of a long column, None if empty.

    The table is reduced to value counts.  Up to `small` distinct values one
    aggregate takes the quantile; beyond, each round counts at most `buckets`
    ranges and goes on inside the one that holds the rank, so neither the driver
    nor one task ever has more rows than these bounds.
    """
    counts = df.select(F.col(column).cast("long").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        told = counts.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d")).first()
        if not told.n:
            return None
        if told.d <= small:
            return counts.agg(F.percentile("v", q, F.col("n"))).first()[0]
        rank = q * (told.n - 1)
        below = int(rank)
        low, high = _neighbours(counts, below, told.lo, told.hi, buckets)
        return float(low) if rank == below else low + (high - low) * (rank - below)
    finally:
        counts.unpersist()


def _neighbours(counts: DataFrame, rank: int, lo: int, hi: int, buckets: int) -> tuple[int, int]:
    """The values with `rank` and `rank` + 1 smaller ones before them in sorted order."""
    after = None  # the least value past the range, as far as it is known
    while lo < hi:
        width = -(-(hi - lo + 1) // buckets)
        part = F.floor((F.col("v") - lo) / width).cast("long") if width > 1 else F.col("v") - lo
        rows = counts.filter(F.col("v").between(lo, hi)).groupBy(part.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        rows.sort()
        for k, r in enumerate(rows):
            if rank < r.n:
                after = rows[k + 1].least if k + 1 < len(rows) else after
                lo, hi, left = r.least, r.most, r.n
                break
            rank -= r.n
        if rank == left - 1:  # the next value lies past this range
            return hi, hi if after is None else after
    return lo, lo


def grouped_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, tuple[float, ...]]], cells: int = 1 << 16) -> DataFrame:
    """keys, and for each name of `wanted` (column, quantiles) an array of exact, linear quantiles by key.

    Neither a key's rows nor its distinct values meet in one task.  Values are
    counted (with map-side combine) and placed in `cells` even cells of their
    key's range; a rank is looked for among the cells, then among the values of
    one cell.  The counts are persisted, so `df` is computed once; clearing the
    cache frees them.  Null keys, and keys without any value, are left out.
    """
    names, on = list(wanted), ["__c", *keys]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(wanted[n][0]).cast("double").alias("v")) for k, n in enumerate(names))))
    values = df.select(*keys, each.alias("__e")).select(F.col("__e.c").alias("__c"), *keys, F.col("__e.v").alias("__v")).filter("__v is not null")
    counts = values.groupBy(*on, "__v").agg(F.count(F.lit(1)).alias("__n")).persist(StorageLevel.MEMORY_AND_DISK)
    ends = counts.groupBy(*on).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    rank = lambda q: F.lit(q) * (F.col("__all") - 1)
    targets = [
        F.when(F.col("__c") == c, F.struct(F.lit(2 * k + up).alias("t"), F.least(F.floor(rank(q)) + up, F.col("__all") - 1).alias("left")))
        for c, n in enumerate(names) for k, q in enumerate(wanted[n][1]) for up in (0, 1)
    ]
    sought = ends.select(*on, "__lo", "__hi", F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull())).alias("w")).select(*on, "__lo", "__hi", F.col("w.t").alias("__t"), F.col("w.left").alias("__left"))
    spread = F.col("__hi") - F.col("__lo")
    cell = F.when(spread > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / spread * cells), F.lit(cells - 1))).otherwise(0).cast("long")
    placed = counts.join(ends.select(*on, "__lo", "__hi"), on).select(*on, "__v", "__n", cell.alias("__cell"))

    def found(totals: DataFrame, by: list[str], unit: str, sought: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = totals.withColumn("__before", before).join(sought, by).filter("__left >= __before and __left < __before + __n")
        return met.select(*by, unit, "__t", (F.col("__left") - F.col("__before")).alias("__left"))

    in_cell = found(placed.groupBy(*on, "__cell").agg(F.sum("__n").alias("__n")), on, "__cell", sought.drop("__lo", "__hi"))
    at = [*on, "__cell"]
    in_value = found(placed.join(in_cell.select(*at).distinct(), at, "left_semi"), at, "__v", in_cell)
    most = max(len(qs) for _, qs in wanted.values())
    met = in_value.groupBy(*on).agg(*(F.max(F.when(F.col("__t") == t, F.col("__v"))).alias(f"__v{t}") for t in range(2 * most))).join(ends.select(*on, "__all"), on)
    between = lambda k, q: F.col(f"__v{2 * k}") + (F.col(f"__v{2 * k + 1}") - F.col(f"__v{2 * k}")) * (rank(q) - F.floor(rank(q)))
    arrays = {n: F.max(F.when(F.col("__c") == c, F.array(*(between(k, q) for k, q in enumerate(wanted[n][1]))))).alias(n) for c, n in enumerate(names)}
    return met.groupBy(*keys).agg(*arrays.values())


def weighted_medians(df: DataFrame, keys: list[str], values: dict[str, str], weight: str) -> DataFrame:
    """keys, and for each name of `values` the column's first value whose running weight reaches half the total.

    One pass for all columns; equal values are added up before the shuffle, so
    a group is as large as its number of distinct values.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(values.values()))))
    per_value = df.select(*keys, weight, each.alias("__e")).groupBy(*keys, F.col("__e.c").alias("__c"), F.col("__e.v").alias("__v")).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys, "__c")
    run = F.sum("__w").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = per_value.select(*keys, "__c", "__v", run.alias("__run"), F.sum("__w").over(w).alias("__all")).filter(F.col("__run") >= F.col("__all") / 2)
    return marked.groupBy(*keys).agg(*(F.min(F.when(F.col("__c") == k, F.col("__v"))).alias(n) for k, n in enumerate(values)))


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: the plain mean where the weights' sum is not positive."""
    return F.when(F.sum(weight) > 0, F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).otherwise(F.avg(value))
