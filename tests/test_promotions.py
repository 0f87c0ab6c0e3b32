"""Promotion operators on small frames with known results."""

import json
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promolith.numeric import exact_quantile, grouped_quantiles, weighted_medians
from promolith.operators import competitors, history, patterns, prep, report, scoring, shape
from promolith.sources import tables

T0 = datetime(2026, 9, 16, 10)
SCHEMA = "canonical_product_id string, name string, shop string, date timestamp, original_price double, promotion_price double, match_status string"


def frame(spark, rows):
    """rows: (product, shop, hours, original, promotion[, status])."""
    return spark.createDataFrame([(p, "товар", s, T0 + timedelta(hours=h), float(o), float(x), *(r or ["confirmed"])) for p, s, h, o, x, *r in rows], SCHEMA)


def states_of(spark, rows, **kw):
    return prep.build_states(prep.add_features(frame(spark, rows)), **kw)


def prices(spark, *steps, product="p1", shop="shopA", gap=1):
    return [(product, shop, k * gap, o, x) for k, (o, x) in enumerate(steps)]


def test_equal_snapshots_are_one_state(spark):
    got = states_of(spark, [("p1", "a", k / 6, 100, 80) for k in range(4)]).collect()
    assert [(r.n_obs, r.episode_id) for r in got] == [(4, 1)]


def test_prices_that_return_make_three_states(spark):
    got = states_of(spark, [("p1", "a", k / 6, 100, x) for k, x in enumerate((80, 60, 80))]).orderBy("state_id").collect()
    assert [r.promotion_price for r in got] == [80, 60, 80] and {r.episode_id for r in got} == {1}


@pytest.mark.parametrize("hours,n", [([0, 1 / 6, 48], 2), ([0, 1 / 6, 1.5], 1)])
def test_gaps(spark, hours, n):
    states = states_of(spark, [("p1", "a", h, 100, 80) for h in hours])
    assert history.promo_episodes(states).count() == n


def test_a_gap_of_just_the_threshold_is_no_break(spark):
    assert states_of(spark, [("p1", "a", 0, 100, 80), ("p1", "a", 5, 100, 80)], gap_hours=5.0, interval_hours=1.0).count() == 1


def test_states_across_spans_of_days(spark):
    """A long series is windowed in spans; the seams must not show."""
    rows = [("p1", "a", 8 * k, 100, 80 if k % 10 < 7 else 70) for k in range(200)]
    got = states_of(spark, rows, gap_hours=12.0, interval_hours=1.0).orderBy("state_id").collect()
    runs = [k for k in range(200) if k == 0 or (k % 10 < 7) != ((k - 1) % 10 < 7)]
    assert [r.first_seen for r in got] == [T0 + timedelta(hours=8 * k) for k in runs]
    assert [r.state_id for r in got] == list(range(1, len(runs) + 1)) and {r.episode_id for r in got} == {1}


def fake(spark, *steps, gap=2):
    return scoring.detect_fake_promos(states_of(spark, prices(spark, *steps, gap=gap))).first()


def test_old_price_jump(spark):
    r = fake(spark, (1000, 900), (1200, 900))
    assert r.flags == "old_price_jump|depth_swing" and r.level == "suspicious" and r.suspicion_score == 0.385
    told = json.loads(r.evidence)
    assert set(told) == {"old_price_jump", "depth_swing"} and told["old_price_jump"]["growth_pct"] == 20.0 and told["old_price_jump"]["old_before"] == 1000


def test_stable_and_honest(spark):
    assert fake(spark, (1000, 950), (1000, 950)).level == "ok"
    r = fake(spark, (1000, 300), (1000, 300))
    assert (r.level, r.suspicion_score, r.flags) == ("ok", 0.0, "") and "deep_discount_for_group" in r.notes.split("|") and "single_state" in r.notes.split("|")


def test_both_rise_and_worse_than_best(spark):
    assert fake(spark, (1000, 900), (1150, 1035)).flags == "promo_price_rise|both_prices_rise|worse_than_best"
    assert 0 <= fake(spark, (1000, 600), (1800, 950), (2000, 990), gap=1).suspicion_score <= 1


def test_psychological_prices(spark):
    df = spark.createDataFrame([(x,) for x in (999.0, 249.99, 1990.0, 1.9, 100.0, 19.0, 250.5)], "p double")
    assert [r[0] for r in df.select(scoring.is_psychological(F.col("p"))).collect()] == [True, True, False, True, False, True, False]


def test_discounts_do_not_depend_on_polling(spark):
    rows = [("p1", "a", k, 100, 95) for k in range(10)] + [("p2", "a", k, 100, 50) for k in range(2)]
    r = history.discount_stats(states_of(spark, rows), "shop").first()
    assert (r.products, r.discount_median, r.shop) == (2, 27.5, "a")
    with pytest.raises(ValueError):
        history.discount_stats(states_of(spark, rows), "name")


def test_weekdays(spark):
    day = 24.0
    features = prep.add_features(frame(spark, [("p1", "a", day, 100, 80), ("p1", "a", day + 1, 100, 80)]))
    rows = patterns.weekday_lift(features, history.promo_episodes(prep.build_states(features))).collect()
    assert len(rows) == 14 and not any(r.reliable for r in rows)
    assert [(r.promo_starts, r.days_observed) for r in rows if r.shop == "ALL" and r.weekday == 3] == [(1, 1)]
    two = [("p1", "a", d * day + h, 100, 80) for d in (-6, 1) for h in (0, 1)]
    features = prep.add_features(frame(spark, two))
    r = patterns.weekday_lift(features, history.promo_episodes(prep.build_states(features))).filter("shop = 'ALL' and weekday = 3").first()
    assert (r.days_observed, r.starts_per_day, r.reliable) == (2, 1.0, True)


def test_competitors(spark):
    apart = states_of(spark, [("p1", "shopA", 0, 200, 100), ("p2", "shopB", 0, 200, 100)])
    assert competitors.competitor_comparison(apart).count() == 0 and competitors.shop_price_index(apart).count() == 0
    r = competitors.competitor_comparison(states_of(spark, [("p1", "shopA", 0, 200, 100), ("p1", "shopB", 0, 200, 125)])).first()
    assert (r.best_shop, r.worst_shop, r.dispersion_pct, r.savings_pct, r.reliable) == ("shopA", "shopB", 25.0, 20.0, True)
    mixed = states_of(spark, [("p1", "shopA", 0, 200, 100), ("p1", "shopB", 0, 200, 125, "provisional")])
    assert competitors.competitor_comparison(mixed, trusted_only=True).count() == 0 and not competitors.competitor_comparison(mixed).first().reliable


def test_coverage_of_a_short_window(spark):
    r = prep.coverage(prep.add_features(frame(spark, [("p1", "a", 0, 100, 80), ("p1", "a", 2, 100, 80)]))).first()
    assert not r.weekday_analysis_ready and r.window_hours == 2.0


def test_groups(spark):
    names = {"Молоко 1 л": "молочные продукты", "Комнатное растение": "декоративная косметика", "Игрушечная машина": "авто и мото", "Demo": "не распознано", "СЫР` мягкий": "сыры"}
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("g", prep.product_group(F.col("name")))
    assert {r.name: r.g for r in df.collect()} == names


def test_empty_input(spark):
    empty = frame(spark, [("p", "s", 0, 1, 1)]).limit(0)
    got = report.build_report(empty)
    assert len(got) == 14 and all(t.count() == 0 for t in got.values())


def test_report_and_export(spark, tmp_path):
    rows = [(p, s, h, 100, 80 - 5 * (h % 3)) for p in ("p1", "p2") for s in ("a", "b") for h in range(6)]
    made = report.build_report(frame(spark, rows))
    paths = tables.export_report({k: made[k] for k in ("coverage", "competitors")}, str(tmp_path))
    assert open(paths[0], "rb").read(3) == b"\xef\xbb\xbf" and len(open(paths[0], encoding="utf-8-sig").read().splitlines()) == 3


def test_load_products(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("canonical_product_id,name,shop,date,original_price,promotion_price,match_status\np1,Сыр,a,2026-09-16 10:00:00,100,80,confirmed\np2,x,a,2026-09-16 10:00:00,0,80,confirmed\n", encoding="utf-8")
    assert [r.name for r in tables.load_products(spark, str(path)).collect()] == ["Сыр"]
    path.write_text("canonical_product_id,name\np1,x\n")
    with pytest.raises(ValueError, match="date"):
        tables.load_products(spark, str(path))


def test_level_and_flag_tables(spark):
    got = scoring.detect_fake_promos(states_of(spark, prices(spark, (1000, 900), (1200, 900)) + prices(spark, (100, 90), product="p2", shop="b")))
    assert {r.shop: (r.likely_fake, r.suspicious, r.ok) for r in shape.level_counts(got).collect()} == {"shopA": (0, 1, 0), "b": (0, 0, 1)}
    assert {r.flag: r.n for r in shape.flag_counts(got).collect()} == {"old_price_jump": 1, "depth_swing": 1}


def test_latest_row_wins(spark):
    rows = frame(spark, [("p", "s", 0, 10, 5, "review"), ("p", "s", 0, 10, 5, "confirmed"), ("p", "s", 1, 10, 5, "review")]).withColumn("seq", F.monotonically_increasing_id())
    assert sorted(r.match_status for r in tables.latest_rows(rows, "seq").collect()) == ["confirmed", "review"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["p1", "p2"]), st.integers(0, 400), st.sampled_from([80, 90])), min_size=1, max_size=40, unique_by=lambda x: (x[0], x[1])))
def test_states_against_a_plain_loop(spark, rows):
    got = sorted((r.canonical_product_id, r.state_id, r.episode_id, r.first_seen, r.last_seen, r.n_obs) for r in states_of(spark, [(p, "s", h, 100, x) for p, h, x in rows], gap_hours=5.0, interval_hours=1.0).collect())
    want = []
    for p in ("p1", "p2"):
        last, state, episode = None, 0, 0
        for h, x in sorted((h, x) for q, h, x in rows if q == p):
            apart = last is None or h - last[0] > 5
            episode += apart
            if apart or x != last[1]:
                state += 1
                want.append([p, state, episode, h, h, 0])
            want[-1][4] = h
            want[-1][5] += 1
            last = (h, x)
    assert got == sorted((p, s, e, T0 + timedelta(hours=a), T0 + timedelta(hours=b), n) for p, s, e, a, b, n in want)


def test_exact_quantile(spark):
    import numpy as np

    values = np.random.default_rng(0).integers(0, 10**12, 500)
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v long")
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
        assert exact_quantile(df, "v", q, buckets=16, small=0) == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
    assert exact_quantile(df.filter("v is null"), "v", 0.5) is None


def test_weighted_median_is_the_lower_one(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 1.0), ("a", 10.0, 1.0), ("b", 3.0, 5.0), ("b", 1.0, 1.0)], "k string, v double, w double")
    assert {r.k: r.m for r in weighted_medians(df, ["k"], {"m": "v"}, "w").collect()} == {"a": 2.0, "b": 3.0}


def test_command(spark, tmp_path):
    from promolith.__main__ import run_once

    path = tmp_path / "p.csv"
    head = "canonical_product_id,name,shop,date,original_price,promotion_price,match_status\n"
    path.write_text(head + "p1,Сыр,a,2026-09-16 10:00:00,100,80,confirmed\n", encoding="utf-8")
    got = run_once(spark, str(path), str(tmp_path / "out"))
    assert got["observations"] == 1 and got["price_timeline"] == 1 and len(list((tmp_path / "out").iterdir())) == 14
    path.write_text(head)
    assert run_once(spark, str(path), str(tmp_path / "none")) == {} and not (tmp_path / "none").exists()


def test_grouped_quantiles(spark):
    """Against numpy: one value, equal values, ties, a lone far value, nulls."""
    rng = np.random.default_rng(8)
    groups = {"one": [3.5], "equal": [2.0] * 9, "ties": rng.integers(0, 4, 40).astype(float).tolist(), "far": [*rng.random(30).tolist(), 1e9], "plain": rng.normal(size=101).tolist(), "none": []}
    rows = [(k, float(v), -float(v)) for k, vs in groups.items() for v in vs] + [("none", None, None), ("plain", None, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    qs = (0.0, 0.25, 0.5, 0.95, 1.0)
    for cells in (4, 1 << 16):
        got = {r.k: r for r in grouped_quantiles(df, ["k"], {"a": ("v", qs), "b": ("w", (0.5,))}, cells).collect()}
        assert set(got) == set(groups) - {"none"}
        for k, r in got.items():
            assert r.a == pytest.approx(np.quantile(groups[k], qs).tolist()) and r.b == pytest.approx([-np.median(groups[k])])
    whole = [v for vs in groups.values() for v in vs] + [1.0]
    assert grouped_quantiles(df, [], {"a": ("v", (0.5,))}).first().a == pytest.approx([np.median(whole)])


def test_states_read_the_observations_once(spark, tmp_path):
    """All passes but the first start from the persisted spans."""
    rows = spark.sql("select 'p' canonical_product_id, 'n' name, 's' shop, timestamp'2024-01-01' + make_dt_interval(0, id) date, 10d + id % 3 original_price, 5d promotion_price, 'confirmed' match_status from range(40)")
    rows.write.parquet(str(tmp_path / "rows"))
    states = prep.build_states(prep.add_features(spark.read.parquet(str(tmp_path / "rows"))), gap_hours=5.0, interval_hours=1.0)
    assert not re.search(r"(?<!InMemory)Relation \[", states._jdf.queryExecution().withCachedData().toString())
    assert states.count() == 40
