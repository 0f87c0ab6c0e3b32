"""Suspicious promotions: rules on consecutive price states, with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolith.config import FakePromoConfig
from promolith.numeric import grouped_quantiles, rounded
from promolith.operators.prep import SERIES, discount_pct

LEVELS = ("likely_fake", "suspicious", "ok")


def is_psychological(price: Column) -> Column:
    """Prices such as 999, 249.99 or 1990 less one: ...99, ...9, .99, .90."""
    rubles = F.floor(price)
    kopecks = F.rint(price * 100) % 100
    return kopecks.isin(99.0, 90.0) | (rubles % 100 == 99) | (rubles % 10 == 9)


def detect_fake_promos(states: DataFrame, config: FakePromoConfig | None = None, within_episode: bool = False) -> DataFrame:
    """One row for each series: score in [0, 1], level, flags, notes, evidence.

    A state is compared with the one before it in its series, across episodes
    unless `within_episode`.  Evidence is of the strongest case, the first on
    ties; `evidence` is JSON with a key for each rule that fired.
    """
    cfg = config or FakePromoConfig()
    # the state before has the number before: a join on both spreads a long series, which a window would sort in one task
    on = [*SERIES, *(["episode_id"] if within_episode else []), "state_id"]
    before = states.select(*on[:-1], (F.col("state_id") + 1).alias("state_id"), F.col("original_price").alias("po"), F.col("promotion_price").alias("pp"))
    growth = lambda now, before: (F.col(now) / F.col(before) - 1) * 100
    rows = (
        states.join(before, on, "left")
        .withColumns({"pd": discount_pct(F.col("po"), F.col("pp")), "og": growth("original_price", "po"), "pg": growth("promotion_price", "pp")})
        .withColumn("at", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    jump = (F.col("og") >= cfg.old_price_jump_pct) & (F.abs("pg") <= cfg.promo_flat_pct)
    rise = F.col("pg") >= cfg.promo_rise_pct
    both = (F.col("og") >= cfg.both_rise_pct) & (F.col("pg") >= cfg.both_rise_pct) & (F.abs(F.col("discount_pct") - F.col("pd")) <= cfg.both_rise_discount_tol)
    r2 = lambda c: rounded(F.col(c) if isinstance(c, str) else c, 2)

    def strongest(test: Column, by: str, **told: Column) -> Column:
        return F.min_by(F.struct(*(v.alias(k) for k, v in told.items())), F.when(test, F.struct(-F.col(by), F.col("state_id"))))

    before_after = {"discount_before": r2("pd"), "discount_after": r2("discount_pct")}
    seen = rows.groupBy(*SERIES).agg(
        *(F.min_by(c, "state_id").alias(c) for c in ("name", "category", "group")), F.count(F.lit(1)).alias("n_price_states"), F.count_distinct("episode_id").alias("n_episodes"),
        F.min_by("promotion_price", "state_id").alias("price_first"), F.max_by("promotion_price", "state_id").alias("price_last"), F.max_by("discount_pct", "state_id").alias("d_last"),
        F.max("discount_pct").alias("d_max"), F.min("discount_pct").alias("d_min"), F.bool_or(is_psychological(F.col("promotion_price"))).alias("psych"),
        F.min_by(F.struct("promotion_price", "discount_pct", "at"), F.struct("promotion_price", "state_id")).alias("best"),
        strongest(jump, "og", at=F.col("at"), old_before=F.col("po"), old_after=F.col("original_price"), growth_pct=r2("og"), promo_price=F.col("promotion_price"), **before_after).alias("old_price_jump"),
        strongest(rise, "pg", at=F.col("at"), promo_before=F.col("pp"), promo_after=F.col("promotion_price"), growth_pct=r2("pg")).alias("promo_price_rise"),
        strongest(both, "pg", at=F.col("at"), old_growth_pct=r2("og"), promo_growth_pct=r2("pg"), **before_after, extra_payment=r2(F.col("promotion_price") - F.col("pp"))).alias("both_prices_rise"),
    )
    swing = F.col("d_max") - F.col("d_min")
    overpay = (F.col("price_last") / F.col("best.promotion_price") - 1) * 100
    worse = (overpay >= cfg.worse_than_best_pct) & (F.col("d_last") >= F.col("best.discount_pct"))
    limits = grouped_quantiles(states, ["group"], {"q": ("discount_pct", (cfg.outlier_quantile,))}).select("group", F.col("q")[0].alias("deep"))
    marked = seen.withColumns({
        "depth_swing": F.when(swing >= cfg.depth_swing_pp, F.struct(r2("d_min").alias("discount_min"), r2("d_max").alias("discount_max"), r2(swing).alias("swing_pp"), F.col("n_price_states").alias("n_states"))),
        "worse_than_best": F.when(worse, F.struct(F.col("best.promotion_price").alias("best_price"), F.col("best.at").alias("best_seen_at"), r2("best.discount_pct").alias("best_discount"), F.col("price_last").alias("last_price"), r2("d_last").alias("last_discount"), r2(overpay).alias("overpay_pct"))),
    }).join(limits, "group", "left")
    rules = {"old_price_jump": cfg.w_old_jump, "promo_price_rise": cfg.w_promo_rise, "both_prices_rise": cfg.w_both_rise, "depth_swing": cfg.w_depth_swing, "worse_than_best": cfg.w_worse_than_best}
    total = sum((F.when(F.col(k).isNotNull(), F.lit(v)).otherwise(0.0) for k, v in rules.items()), F.lit(0.0))
    score = rounded(total / cfg.total_weight, 3)
    notes = [F.when(F.col("d_max") >= F.col("deep"), "deep_discount_for_group"), F.when(F.col("psych"), "psych_price"), F.when(F.col("n_price_states") == 1, "single_state")]
    return marked.select(
        *SERIES, "name", "category", "group", "n_price_states", "n_episodes", "price_first", "price_last", r2("d_last").alias("discount_now"), r2("d_max").alias("discount_max"),
        score.alias("suspicion_score"), F.when(score >= cfg.likely_fake, LEVELS[0]).when(score >= cfg.suspicious, LEVELS[1]).otherwise(LEVELS[2]).alias("level"),
        F.concat_ws("|", *(F.when(F.col(k).isNotNull(), k) for k in rules)).alias("flags"), F.concat_ws("|", *notes).alias("notes"), F.to_json(F.struct(*rules)).alias("evidence"),
    ).orderBy(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.desc("suspicion_score"), *SERIES)
