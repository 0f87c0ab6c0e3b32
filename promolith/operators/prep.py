"""Features, poll interval, price states and coverage.

Inputs are observations: canonical_product_id, name, shop, date, original_price,
promotion_price, match_status.  A series is the rows of one product in one shop.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolith import config
from promolith.numeric import exact_quantile, hours_between, rounded

SERIES = ["canonical_product_id", "shop"]
ORDER = ["date", "original_price", "promotion_price", "match_status", "name"]  # ties in time are settled
REQUIRED = ("canonical_product_id", "name", "shop", "date", "original_price", "promotion_price", "match_status")
SPAN_DAYS = 7  # a series is cut into such spans, so that a long one is no single task


def usable(df: DataFrame) -> DataFrame:
    """Rows with both prices positive and a whole key; prices as double."""
    prices = {c: F.col(c).cast("double") for c in ("original_price", "promotion_price")}
    return df.filter("original_price > 0 and promotion_price > 0 and canonical_product_id is not null and shop is not null and date is not null").withColumns(prices)


def searchable(name: Column) -> Column:
    """The form of a name that keywords are looked for in."""
    return F.replace(F.lower(name), F.lit("`"), F.lit(" "))


def product_group(name: Column) -> Column:
    """First group with a keyword in the name."""
    return group_of(searchable(name))


def group_of(text: Column) -> Column:
    """The same for a `searchable` name.

    `text` should be a column of its own: there are over a hundred keywords, and
    an expression in its place is computed for each of them.
    """
    found = [F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in words)), F.lit(group)) for group, _, words in config.GROUPS]
    return F.coalesce(*found, F.lit(config.NO_GROUP))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def product_category(shop: Column, group: Column) -> Column:
    """The group's category, else the shop's, else the rest."""
    return F.coalesce(_lookup(group, {g: c for g, c, _ in config.GROUPS}), _lookup(shop, config.SHOP_CATEGORY), F.lit(config.NO_CATEGORY))


def discount_pct(original: Column, promotion: Column) -> Column:
    return (1 - promotion / original) * 100


def add_features(observations: DataFrame) -> DataFrame:
    """group, category, discount_pct, day and weekday (Monday 0) for each row."""
    return (
        observations.withColumn("__searched", searchable(F.col("name"))).withColumn("group", group_of(F.col("__searched"))).drop("__searched")
        .withColumn("category", product_category(F.col("shop"), F.col("group")))
        .withColumns({"discount_pct": discount_pct(F.col("original_price"), F.col("promotion_price")), "day": F.to_date("date"), "weekday": F.weekday("date")})
    )


TOLD = ["date", "original_price", "promotion_price"]
SPAN = [*SERIES, "__span"]


def _spans(features: DataFrame, *more: str) -> DataFrame:
    """Each row with the one before it in its series and span of days, persisted as all that follows reads it.

    A span's first row has no predecessor here; `_seams` knows it.
    """
    cut = features.select(*SERIES, *ORDER, *more).withColumn("__span", F.floor(F.unix_date(F.to_date("date")) / SPAN_DAYS))
    w = Window.partitionBy(*SPAN).orderBy(*ORDER)
    return cut.withColumns({"__prev": F.lag(F.struct(*TOLD)).over(w), "__last": F.lead(F.lit(1)).over(w).isNull()}).persist(StorageLevel.MEMORY_AND_DISK)


def _seams(rows: DataFrame) -> DataFrame:
    """One row for each span: its first row, and the last one of the span before it in the series."""
    told = F.struct(*TOLD)
    ends = rows.filter("__prev is null or __last").groupBy(*SPAN).agg(F.max(F.when(F.col("__prev").isNull(), told)).alias("__first"), F.max(F.when(F.col("__last"), told)).alias("__end"))
    return ends.select(*SPAN, "__first", F.lag("__end").over(Window.partitionBy(*SERIES).orderBy("__span")).alias("__before"))


def _lower_quartile(rows: DataFrame, seams: DataFrame) -> float:
    gap = lambda now, before: (F.unix_micros(now) - F.unix_micros(before)).alias("gap")
    gaps = rows.select(gap("date", "__prev.date")).unionByName(seams.select(gap("__first.date", "__before.date"))).filter("gap > 0")
    quartile = exact_quantile(gaps, "gap", 0.25)
    return 0.0 if quartile is None else quartile / 3.6e9


def median_interval_hours(features: DataFrame) -> float:
    """The lower quartile of positive gaps within the series, in hours; 0 without any."""
    rows = _spans(features)
    try:
        return _lower_quartile(rows, _seams(rows))
    finally:
        rows.unpersist()


def gap_hours_for(interval_hours: float) -> float:
    """After so many hours without a sight a product has left its promotion."""
    return min(config.MAX_GAP_HOURS, max(config.MIN_GAP_HOURS, interval_hours * config.GAP_FACTOR))


def resolve_gap_hours(features: DataFrame) -> float:
    return gap_hours_for(median_interval_hours(features))


def build_states(features: DataFrame, gap_hours: float | None = None, interval_hours: float | None = None) -> DataFrame:
    """One row for each run of constant prices in a series.

    A gap of more than `gap_hours` starts a new episode and a new state; a
    changed price starts a new state.  Prices that return make a new state.
    episode_id and state_id count within the series, from 1.
    """
    rows = _spans(features, "category", "group")  # clearing the cache frees it
    seams = _seams(rows)
    if interval_hours is None:
        interval_hours = _lower_quartile(rows, seams)
    if gap_hours is None:
        gap_hours = gap_hours_for(interval_hours)

    def flags(before: str, now: str) -> dict[str, Column]:
        """Whether an episode, and whether a state starts; no row before tells nothing."""
        episode = F.coalesce(hours_between(F.col(f"{before}.date"), F.col(f"{now}date")) > gap_hours, F.lit(False))
        changed = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"{before}.{c}") != F.col(f"{now}{c}"), F.lit(False)) for c in TOLD[1:]))
        return {"__e": episode.cast("int"), "__s": (episode | changed).cast("int")}

    flagged = rows.withColumns(flags("__prev", ""))
    first = F.col("__before").isNull().cast("int")
    starts = seams.withColumns(flags("__before", "__first.")).select(*SPAN, F.greatest("__e", first).alias("__e1"), F.greatest("__s", first).alias("__s1"))
    totals = flagged.groupBy(*SPAN).agg(F.sum("__e").alias("__es"), F.sum("__s").alias("__ss")).join(starts, SPAN)
    ahead = Window.partitionBy(*SERIES).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sum_ahead = lambda c: F.coalesce(F.sum(F.col(f"__{c}s") + F.col(f"__{c}1")).over(ahead), F.lit(0)) + F.col(f"__{c}1")
    offsets = totals.select(*SPAN, sum_ahead("e").alias("__e0"), sum_ahead("s").alias("__s0"))
    run = Window.partitionBy(*SPAN).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        flagged.drop("__prev", "__last").join(offsets, SPAN).withColumns({"__er": F.sum("__e").over(run), "__sr": F.sum("__s").over(run)})
        .withColumns({"episode_id": F.col("__er") + F.col("__e0"), "state_id": F.col("__sr") + F.col("__s0")})
    )
    order = F.struct(*ORDER)
    told = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("name", "category", "group", "episode_id", "original_price", "promotion_price")]
    states = numbered.groupBy(*SERIES, "state_id").agg(
        *told, F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count(F.lit(1)).alias("n_obs"), F.mode("match_status", True).alias("match_status")
    )
    hours = hours_between(F.col("first_seen"), F.col("last_seen"))
    return states.withColumn("duration_hours", hours).withColumns({
        "weight_hours": F.greatest("duration_hours", F.lit(max(interval_hours, config.MIN_WEIGHT_HOURS))),
        "discount_pct": discount_pct(F.col("original_price"), F.col("promotion_price")),
    })


def coverage(features: DataFrame) -> DataFrame:
    """What was observed of each shop; ready for weekdays from two weeks on."""
    return (
        features.groupBy("shop").agg(
            F.count_distinct("canonical_product_id").alias("products"), F.count(F.lit(1)).alias("observations"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"),
            F.count_distinct("day").alias("days_covered"), F.count_distinct("weekday").alias("weekdays_covered"),
        )
        .withColumn("window_hours", rounded(hours_between(F.col("first_seen"), F.col("last_seen")), 2))
        .withColumn("weeks_covered", rounded(F.col("window_hours") / 168, 3))
        .withColumn("weekday_analysis_ready", F.col("weeks_covered") >= 2)
        .orderBy(F.desc("observations"), "shop")
    )
