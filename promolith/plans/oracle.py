"""DuckDB SQL for the promotion queries, written against the test tables."""

from __future__ import annotations

from promolith import config
from promolith.plans.adapter import NAMES, SHOPS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rounded(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


def _cases(on: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {on.format(k)} THEN {_text(v)}" for k, v in pairs) + f" ELSE {default} END"


def _group() -> str:
    tests = [(" OR ".join(f"contains(n, {_text(k)})" for k in words), group) for group, _, words in config.GROUPS]
    return "CASE " + " ".join(f"WHEN {t} THEN {_text(g)}" for t, g in tests) + f" ELSE {_text(config.NO_GROUP)} END"


_HOURS = "((epoch_us({1}) - epoch_us({0})) / 3.6e9)"
_DISCOUNT = "((1 - promotion_price / original_price) * 100)"
_PS = "canonical_product_id, shop"
_ORDER = "date, original_price, promotion_price, match_status, name"

OBSERVATIONS = f"""
    ev AS (SELECT *, user_id % 20 AS pid, CAST(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS INTEGER) AS k FROM events),
    priced AS (SELECT *, CAST(200 + 10 * pid + CASE WHEN k >= 90 THEN 40 ELSE 0 END AS DOUBLE) AS original_price FROM ev),
    obs AS (
        SELECT 'prod_' || lpad(CAST(pid AS VARCHAR), 2, '0') AS canonical_product_id, [{", ".join(map(_text, NAMES))}][pid + 1] AS name,
            {_cases("event_type = '{}'", SHOPS.items(), "NULL")} AS shop, ts AS date, original_price,
            round(original_price * CASE WHEN value < 20 THEN 8e-1 WHEN value < 60 THEN 7e-1 ELSE 5e-1 END, 2) AS promotion_price,
            CASE WHEN k % 10 < 6 THEN 'provisional' WHEN k % 10 < 8 THEN 'confirmed' ELSE 'auto_matched' END AS match_status, event_id AS sequence
        FROM priced
    )"""

FEATURES = f"""{OBSERVATIONS},
    named AS (SELECT *, replace(lower(name), '`', ' ') AS n FROM obs WHERE original_price > 0 AND promotion_price > 0 AND shop IS NOT NULL),
    grouped AS (SELECT * EXCLUDE (n), {_group()} AS "group" FROM named),
    feat AS (
        SELECT *, CASE {" ".join(f'WHEN "group" = {_text(g)} THEN {_text(c)}' for g, c, _ in config.GROUPS)} {" ".join(f"WHEN shop = {_text(s)} THEN {_text(c)}" for s, c in config.SHOP_CATEGORY.items())}
            ELSE {_text(config.NO_CATEGORY)} END AS category, {_DISCOUNT} AS discount_pct, CAST(date AS DATE) AS day, CAST(isodow(date) - 1 AS INTEGER) AS weekday
        FROM grouped
    )"""

STATES = f"""{FEATURES},
    before AS (
        SELECT *, lag(date) OVER w AS d0, lag(original_price) OVER w AS o0, lag(promotion_price) OVER w AS p0
        FROM feat WINDOW w AS (PARTITION BY {_PS} ORDER BY {_ORDER})
    ),
    poll AS (SELECT coalesce(quantile_cont(g, 0.25), 0) / 3.6e9 AS h FROM (SELECT epoch_us(date) - epoch_us(d0) AS g FROM before) WHERE g > 0),
    lim AS (SELECT h, least(1.2e1, greatest(3e0, h * 8)) AS gap FROM poll),
    flags AS (
        SELECT before.*, CASE WHEN d0 IS NULL OR {_HOURS.format("d0", "date")} > gap THEN 1 ELSE 0 END AS e,
            CASE WHEN d0 IS NULL OR {_HOURS.format("d0", "date")} > gap OR original_price <> o0 OR promotion_price <> p0 THEN 1 ELSE 0 END AS s
        FROM before, lim
    ),
    numbered AS (
        SELECT *, CAST(sum(e) OVER w AS BIGINT) AS episode_id, CAST(sum(s) OVER w AS BIGINT) AS state_id
        FROM flags WINDOW w AS (PARTITION BY {_PS} ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)
    ),
    statuses AS (
        SELECT {_PS}, state_id, match_status, row_number() OVER (PARTITION BY {_PS}, state_id ORDER BY count(*) DESC, match_status) AS r
        FROM numbered GROUP BY {_PS}, state_id, match_status
    ),
    folded AS (
        SELECT {_PS}, state_id, min(name) AS name, min(category) AS category, min("group") AS "group", min(episode_id) AS episode_id, min(original_price) AS original_price, min(promotion_price) AS promotion_price,
            min(date) AS first_seen, max(date) AS last_seen, count(*) AS n_obs
        FROM numbered GROUP BY {_PS}, state_id
    ),
    states AS (
        SELECT folded.*, statuses.match_status, {_HOURS.format("first_seen", "last_seen")} AS duration_hours,
            greatest({_HOURS.format("first_seen", "last_seen")}, greatest(h, 1e-6)) AS weight_hours, {_DISCOUNT} AS discount_pct
        FROM folded JOIN statuses USING (canonical_product_id, shop, state_id), lim WHERE r = 1
    )"""

EPISODES = f"""{STATES},
    ep0 AS (
        SELECT {_PS}, episode_id, min(name) AS name, min(category) AS category, min("group") AS "group", count(*) AS n_price_states, min(first_seen) AS started_at, max(last_seen) AS ended_at,
            median(discount_pct) AS median_discount, max(discount_pct) AS max_discount, min(promotion_price) AS min_price, max(promotion_price) AS max_price
        FROM states GROUP BY {_PS}, episode_id
    ),
    ep1 AS (SELECT *, {_rounded(_HOURS.format("started_at", "ended_at"), 2)} AS duration_hours FROM ep0),
    episodes AS (SELECT *, {_rounded("duration_hours / 24", 2)} AS duration_days, n_price_states > 1 AS price_changed FROM ep1)"""

SUMMARY = f"""{EPISODES},
    sm0 AS (
        SELECT {_PS}, min(name) AS name, min(category) AS category, min("group") AS "group", count(DISTINCT episode_id) AS n_episodes, CAST(sum(n_price_states) AS BIGINT) AS n_price_states,
            min(started_at) AS first_seen, max(ended_at) AS last_seen, {_rounded("sum(duration_hours)", 2)} AS promo_hours, {_rounded("median(median_discount)", 2)} AS median_discount,
            {_rounded("max(max_discount)", 2)} AS max_discount, min(min_price) AS lo, max(max_price) AS hi
        FROM episodes GROUP BY {_PS}
    ),
    summary AS (
        SELECT * EXCLUDE (lo, hi), {_rounded("lo", 2)} AS min_price, {_rounded("hi", 2)} AS max_price, {_rounded(_HOURS.format("first_seen", "last_seen"), 2)} AS observed_hours,
            {_rounded("promo_hours / 24", 2)} AS promo_days, {_rounded("(hi / lo - 1) * 100", 2)} AS price_spread_pct
        FROM sm0
    )"""


def _weighted(name: str, keys: str, value: str) -> str:
    return f"""
    {name} AS (
        SELECT {keys}, min(v) AS {name} FROM (
            SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY {keys}) AS total
            FROM (SELECT {keys}, {value} AS v, sum(weight_hours) AS w FROM states GROUP BY ALL)
        ) WHERE run >= total / 2 GROUP BY {keys}
    )"""


PRICES = f"""{STATES}, {_weighted("pp", _PS, "promotion_price")}, {_weighted("dp", _PS, "discount_pct")},
    st AS (SELECT {_PS}, match_status, row_number() OVER (PARTITION BY {_PS} ORDER BY count(*) DESC, match_status) AS r FROM states GROUP BY {_PS}, match_status),
    told AS (SELECT {_PS}, min(name) AS name, min(category) AS category, min("group") AS "group" FROM states GROUP BY ALL),
    prices AS (
        SELECT told.*, pp AS promo_price, dp AS discount_pct, match_status
        FROM told JOIN pp USING (canonical_product_id, shop) JOIN dp USING (canonical_product_id, shop) JOIN st USING (canonical_product_id, shop) WHERE r = 1
    )"""


def _discounts(by: str) -> str:
    keys = ", ".join([f'"{by}"', *(k for k in ("canonical_product_id", "shop") if k != by)])
    return f"""WITH {STATES}, {_weighted("wd", keys, "discount_pct")}, {_weighted("wp", keys, "promotion_price")},
        sizes AS (SELECT {keys}, sum(weight_hours) AS hours, count(*) AS n, sum(n_obs) AS o FROM states GROUP BY ALL),
        one AS (SELECT * FROM sizes JOIN wd USING ({keys}) JOIN wp USING ({keys}))
        SELECT "{by}", count(DISTINCT canonical_product_id) AS products, CAST(sum(n) AS BIGINT) AS price_states, CAST(sum(o) AS BIGINT) AS observations,
            {_rounded("sum(wd * hours) / sum(hours)", 2)} AS discount_mean, {_rounded("median(wd)", 2)} AS discount_median, {_rounded("quantile_cont(wd, 0.25)", 2)} AS discount_p25,
            {_rounded("quantile_cont(wd, 0.75)", 2)} AS discount_p75, {_rounded("quantile_cont(wd, 0.95)", 2)} AS discount_p95, {_rounded("max(wd)", 2)} AS discount_max, {_rounded("median(wp)", 2)} AS price_median
        FROM one GROUP BY "{by}" """


_FAKE = config.FakePromoConfig()

FAKE = f"""{STATES},
    prev AS (SELECT *, lag(original_price) OVER w AS po, lag(promotion_price) OVER w AS px FROM states WINDOW w AS (PARTITION BY {_PS} ORDER BY state_id)),
    steps AS (SELECT *, (original_price / po - 1) * 100 AS og, (promotion_price / px - 1) * 100 AS pg, abs(discount_pct - (1 - px / po) * 100) AS shift FROM prev),
    deep AS (SELECT "group", quantile_cont(discount_pct, 0.95) AS deep FROM states GROUP BY ALL),
    rules AS (
        SELECT {_PS}, arg_min(name, state_id) AS name, arg_min(category, state_id) AS category, arg_min("group", state_id) AS "group", count(*) AS n_price_states, count(DISTINCT episode_id) AS n_episodes,
            arg_min(promotion_price, state_id) AS price_first, arg_max(promotion_price, state_id) AS price_last, arg_max(discount_pct, state_id) AS d_last, max(discount_pct) AS d_max, min(discount_pct) AS d_min,
            min(promotion_price) AS best, arg_min(discount_pct, (promotion_price, state_id)) AS d_best,
            bool_or(round_even(promotion_price * 100, 0) % 100 IN (90, 99) OR floor(promotion_price) % 100 = 99 OR floor(promotion_price) % 10 = 9) AS psych,
            coalesce(bool_or(og >= 5 AND abs(pg) <= 1), false) AS r1, coalesce(bool_or(pg >= 2), false) AS r2, coalesce(bool_or(og >= 5 AND pg >= 5 AND shift <= 1.5), false) AS r3,
            max(CASE WHEN og >= 5 AND abs(pg) <= 1 THEN og END) AS g1, max(CASE WHEN pg >= 2 THEN pg END) AS g2,
            max(CASE WHEN og >= 5 AND pg >= 5 AND shift <= 1.5 THEN pg END) AS g3
        FROM steps GROUP BY {_PS}
    ),
    scored AS (
        SELECT *, d_max - d_min >= 10 AS r4, (price_last / best - 1) * 100 >= 3 AND d_last >= d_best AS r5 FROM rules JOIN deep USING ("group")
    ),
    fake0 AS (
        SELECT *, {_rounded("(CASE WHEN r1 THEN 1e0 ELSE 0 END + CASE WHEN r2 THEN 8e-1 ELSE 0 END + CASE WHEN r3 THEN 1e0 ELSE 0 END + CASE WHEN r4 THEN 5e-1 ELSE 0 END + CASE WHEN r5 THEN 6e-1 ELSE 0 END) / 3.9e0", 3)} AS suspicion_score
        FROM scored
    ),
    fake AS (
        SELECT *, CASE WHEN suspicion_score >= 6e-1 THEN 'likely_fake' WHEN suspicion_score >= 3e-1 THEN 'suspicious' ELSE 'ok' END AS level,
            concat_ws('|', CASE WHEN r1 THEN 'old_price_jump' END, CASE WHEN r2 THEN 'promo_price_rise' END, CASE WHEN r3 THEN 'both_prices_rise' END, CASE WHEN r4 THEN 'depth_swing' END, CASE WHEN r5 THEN 'worse_than_best' END) AS flags,
            concat_ws('|', CASE WHEN d_max >= deep THEN 'deep_discount_for_group' END, CASE WHEN psych THEN 'psych_price' END, CASE WHEN n_price_states = 1 THEN 'single_state' END) AS notes
        FROM fake0
    )"""

PROMOTIONS = f"""{OBSERVATIONS},
    copies AS (SELECT * FROM obs UNION ALL SELECT * REPLACE (sequence + 1000000000 AS sequence, 'confirmed' AS match_status) FROM obs WHERE sequence % 50 = 0),
    latest AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY canonical_product_id, shop, date, original_price, promotion_price ORDER BY sequence DESC) = 1)"""

_LAST30 = "date >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY"
_API = f"{_rounded('avg(' + _DISCOUNT + ')', 2)} AS avg_discount_pct, {_rounded('median(' + _DISCOUNT + ')', 2)} AS median_discount_pct"


def _favorites() -> str:
    part = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 5e-1 ELSE (CAST({c} AS DOUBLE) - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
    score = _rounded(f"0e0 + 35e-2 * {part('promo_hours')} + 25e-2 * {part('n_episodes')} + 2e-1 * {part('n_price_states')} + 2e-1 * {part('median_discount')}", 3)
    return f"""WITH {SUMMARY}, sc AS (SELECT *, {score} AS score FROM summary WINDOW w AS (PARTITION BY shop))
        SELECT canonical_product_id, shop, name, category, "group", score, CAST(rank() OVER (PARTITION BY shop ORDER BY score DESC) AS DOUBLE) AS rank_in_shop, n_episodes, n_price_states, promo_days,
            {_rounded("coalesce(promo_hours / nullif(observed_hours, 0), 1e0)", 3)} AS promo_time_share, median_discount, max_discount, min_price, max_price, price_spread_pct
        FROM sc ORDER BY score DESC, shop, canonical_product_id LIMIT 20"""


def _lift_level(by_shop: bool) -> str:
    shop, on = ("shop, ", "shop, weekday") if by_shop else ("", "weekday")
    name = "shop" if by_shop else "'ALL'"
    shops = "(SELECT DISTINCT shop FROM feat)" if by_shop else "(SELECT 'ALL' AS shop)"
    return f"""
        SELECT g.shop, g.weekday, coalesce(days_observed, 0) AS days_observed, coalesce(active_per_day, 0) AS active_per_day, coalesce(promo_starts, 0) AS promo_starts
        FROM (SELECT shop, CAST(unnest(range(7)) AS INTEGER) AS weekday FROM {shops}) g
        LEFT JOIN (SELECT {name} AS shop, weekday, count(DISTINCT day) AS days_observed FROM feat GROUP BY ALL) o ON o.shop = g.shop AND o.weekday = g.weekday
        LEFT JOIN (SELECT {name} AS shop, weekday, avg(p) AS active_per_day FROM (SELECT {shop} weekday, day, count(DISTINCT canonical_product_id) AS p FROM feat GROUP BY ALL) GROUP BY ALL) a ON a.shop = g.shop AND a.weekday = g.weekday
        LEFT JOIN (SELECT {name} AS shop, CAST(isodow(started_at) - 1 AS INTEGER) AS weekday, count(*) AS promo_starts FROM episodes GROUP BY ALL) e ON e.shop = g.shop AND e.weekday = g.weekday"""


LIFT = f"""{EPISODES}, grid AS ({_lift_level(True)} UNION ALL {_lift_level(False)}),
    shared AS (SELECT *, (promo_starts + 1e0) / (sum(promo_starts) OVER (PARTITION BY shop) + 7e0) AS share FROM grid),
    lift AS (
        SELECT shop, weekday, [{", ".join(map(_text, config.WEEKDAYS))}][weekday + 1] AS weekday_name, days_observed, promo_starts, {_rounded("promo_starts / nullif(days_observed, 0)", 4)} AS starts_per_day,
            {_rounded("active_per_day", 4)} AS active_per_day, {_rounded("share", 4)} AS starts_share, {_rounded("share / (1e0 / 7)", 4)} AS lift, days_observed >= 2 AS reliable
        FROM shared
    )"""

COVERAGE = f"""{FEATURES},
    cov0 AS (
        SELECT shop, count(DISTINCT canonical_product_id) AS products, count(*) AS observations, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT day) AS days_covered, count(DISTINCT weekday) AS weekdays_covered,
            {_rounded(_HOURS.format("min(date)", "max(date)"), 2)} AS window_hours FROM feat GROUP BY shop
    ),
    cov AS (SELECT *, {_rounded("window_hours / 168", 3)} AS weeks_covered, {_rounded("window_hours / 168", 3)} >= 2 AS weekday_analysis_ready FROM cov0)"""

GROUPS = f"""{PRICES},
    gp0 AS (SELECT category, "group", shop, count(DISTINCT canonical_product_id) AS products, median(discount_pct) AS md, max(discount_pct) AS xd, median(promo_price) AS mp FROM prices GROUP BY ALL),
    gp AS (
        SELECT category, "group", shop, products, {_rounded("md", 2)} AS median_discount, {_rounded("xd", 2)} AS max_discount, {_rounded("mp", 2)} AS median_price,
            count(*) OVER (PARTITION BY "group") >= 2 AS comparable, CAST(rank() OVER (PARTITION BY "group" ORDER BY md DESC) AS DOUBLE) AS discount_rank_in_group FROM gp0
    )"""


def _competitors(trusted: bool) -> str:
    return f"""{PRICES},
        cmp0 AS (
            SELECT canonical_product_id, arg_min(name, shop) AS name, arg_min(category, shop) AS category, arg_min("group", shop) AS "group", count(*) AS n_shops, min(promo_price) AS min_price, median(promo_price) AS median_price,
                max(promo_price) AS max_price, arg_min(shop, (promo_price, shop)) AS best_shop, arg_min(shop, (-promo_price, shop)) AS worst_shop,
                {_rounded("avg(CASE WHEN match_status = 'provisional' THEN 1e0 ELSE 0e0 END)", 2)} AS provisional_share, bool_and(match_status <> 'provisional') AS reliable
            FROM prices {"WHERE match_status IN ('confirmed', 'auto_matched')" if trusted else ""} GROUP BY canonical_product_id HAVING count(*) >= 2
        ),
        cmp AS (SELECT *, {_rounded("(max_price - min_price) / min_price * 100", 2)} AS dispersion_pct, {_rounded("(max_price - min_price) / max_price * 100", 2)} AS savings_pct FROM cmp0)"""


_FAKE_OUT = f"""{_PS}, name, category, "group", n_price_states, n_episodes, price_first, price_last, {_rounded("d_last", 2)} AS discount_now, {_rounded("d_max", 2)} AS discount_max, suspicion_score, level, flags, notes,
    {_rounded("g1", 2)} AS jump_growth_pct, {_rounded("g2", 2)} AS rise_growth_pct, {_rounded("g3", 2)} AS both_growth_pct, CASE WHEN r4 THEN {_rounded("d_max - d_min", 2)} END AS swing_pp,
    CASE WHEN r4 THEN {_rounded("d_min", 2)} END AS discount_low, CASE WHEN r5 THEN best END AS best_price, CASE WHEN r5 THEN {_rounded("(price_last / best - 1) * 100", 2)} END AS overpay_pct"""

_GTINS = """
    body AS (SELECT p_partkey AS k, lpad(CAST(p_partkey + 400000000000 AS VARCHAR), 12, '0') AS b FROM part),
    coded AS (SELECT k, b, CAST((10 - list_sum([CAST(b[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END for i in range(1, 13)]) % 10) % 10 AS INTEGER) AS d FROM body),
    gt AS (SELECT k, CASE WHEN k % 2 = 0 THEN b || CASE WHEN k % 3 = 0 THEN '0' ELSE CAST(d AS VARCHAR) END END AS raw, k % 2 = 0 AND (k % 3 <> 0 OR d = 0) AS valid FROM coded)"""

_EVENTS = f"""{OBSERVATIONS},
    bad AS (
        SELECT *, sequence % 13 = 0 AS no_name, sequence % 17 = 0 AS no_zone, sequence % 7 = 0 OR round(original_price * 100) <= round(promotion_price * 100) AS no_discount, sequence % 11 = 0 AS no_status FROM obs)"""

_STATUS = "CASE WHEN k % 10 < 6 THEN 'provisional' WHEN k % 10 < 8 THEN 'confirmed' ELSE 'auto_matched' END AS match_status"
_SURE = _STATUS.replace("CASE WHEN", "CASE WHEN pid % 2 = 0 AND event_type <> 'view' THEN 'confirmed' WHEN", 1)
_NOW, _OLD = "CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR)", "CAST(CAST(p_retailprice * 12e-1 AS DECIMAL(12, 2)) AS VARCHAR)"
_CENTS = "cents AS (SELECT p_partkey AS k, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) * 100 AS BIGINT) AS c FROM part)"
_WORDS = "list_sort(list_distinct(string_split(lower(p_name), ' ')))"

# name -> SQL; the columns are those of the query of the same name
SQL: dict[str, str] = {
    "features": f"WITH {FEATURES} SELECT {_PS}, name, \"group\", category, {_rounded('discount_pct', 6)} AS discount_pct, day, weekday, sequence FROM feat",
    "keyword_group": f"WITH {FEATURES} SELECT DISTINCT name, shop, \"group\", category FROM feat",
    "poll_interval": f"WITH {STATES} SELECT round(h, 6) AS interval_hours, round(gap, 6) AS gap_hours FROM lim",
    "coverage": f"WITH {COVERAGE} SELECT * FROM cov",
    "any_ready": f"WITH {COVERAGE} SELECT bool_or(weekday_analysis_ready) AS any_ready FROM cov",
    "price_history_filter": f"WITH {FEATURES} SELECT {_PS}, name, category, \"group\", date, original_price, promotion_price, {_rounded('discount_pct', 6)} AS discount_pct, match_status FROM feat WHERE shop = 'lenta' AND category = 'продукты'",
    "price_states": f"WITH {STATES} SELECT {_PS}, name, category, \"group\", episode_id, state_id, original_price, promotion_price, first_seen, last_seen, n_obs, match_status, round(duration_hours, 6) AS duration_hours, round(weight_hours, 6) AS weight_hours, round(discount_pct, 6) AS discount_pct FROM states",
    "price_timeline": f"WITH {STATES} SELECT {_PS}, name, category, \"group\", episode_id, first_seen, last_seen, {_rounded('duration_hours', 2)} AS duration_hours, n_obs, original_price, promotion_price, {_rounded('discount_pct', 2)} AS discount_pct, {_rounded('original_price - promotion_price', 2)} AS saving FROM states",
    "promo_episodes": f"WITH {EPISODES} SELECT * REPLACE (round(median_discount, 6) AS median_discount, round(max_discount, 6) AS max_discount) FROM episodes",
    "product_summary": f"WITH {SUMMARY} SELECT * FROM summary",
    "discount_by_shop": _discounts("shop"),
    "discount_by_category": _discounts("category"),
    "discount_by_group": _discounts("group"),
    "fake_promos": f"WITH {FAKE} SELECT {_FAKE_OUT} FROM fake",
    "level_pivot": f"WITH {FAKE} SELECT shop, count(*) FILTER (WHERE level = 'likely_fake') AS likely_fake, count(*) FILTER (WHERE level = 'suspicious') AS suspicious, count(*) FILTER (WHERE level = 'ok') AS ok, count(*) AS total FROM fake GROUP BY shop",
    "flag_counts": f"WITH {FAKE} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM fake) WHERE flag <> '' GROUP BY flag",
    "flagged_total": f"WITH {FAKE} SELECT count(*) FILTER (WHERE flags <> '') AS flagged, count(*) AS total FROM fake",
    "favorites": _favorites(),
    "group_promo_activity": f"""WITH {SUMMARY}, act AS (
            SELECT shop, category, "group", count(DISTINCT canonical_product_id) AS products, CAST(sum(n_episodes) AS BIGINT) AS episodes, {_rounded("sum(promo_days)", 3)} AS promo_days, {_rounded("median(median_discount)", 3)} AS median_discount FROM summary GROUP BY ALL)
        SELECT *, {_rounded("products / sum(products) OVER (PARTITION BY shop)", 3)} AS share_of_shop_products FROM act""",
    "observed_weekdays": f"WITH {FEATURES} SELECT shop, weekday, count(DISTINCT day) AS days_observed FROM feat GROUP BY ALL",
    "active_per_day": f"WITH {FEATURES} SELECT shop, weekday, round(avg(p), 6) AS active_per_day FROM (SELECT shop, weekday, day, count(DISTINCT canonical_product_id) AS p FROM feat GROUP BY ALL) GROUP BY ALL",
    "weekday_lift": f"WITH {LIFT} SELECT * FROM lift",
    "weekday_slice": f"WITH {LIFT} SELECT count(*) AS weekdays, count(*) FILTER (WHERE reliable) AS reliable_days, coalesce(max(CASE WHEN NOT reliable THEN days_observed END), 0) AS most_unreliable_days FROM lift WHERE shop = 'ALL'",
    "competitors": f"WITH {_competitors(False)} SELECT * FROM cmp",
    "competitors_trusted": f"WITH {_competitors(True)} SELECT * FROM cmp",
    "top_dispersion": f"WITH {_competitors(False)} SELECT * FROM cmp ORDER BY dispersion_pct DESC, canonical_product_id LIMIT 10",
    "shop_price_index": f"""WITH {PRICES}, idx AS (SELECT *, count(*) OVER w AS n, promo_price / min(promo_price) OVER w AS i FROM prices WINDOW w AS (PARTITION BY canonical_product_id))
        SELECT shop, {_rounded("avg(i)", 3)} AS avg_price_index, count(DISTINCT canonical_product_id) AS n_comparable_products, {_rounded("avg(CASE WHEN i <= 1 THEN 1e0 ELSE 0e0 END)", 3)} AS cheapest_share FROM idx WHERE n >= 2 GROUP BY shop""",
    "group_price_comparison": f"WITH {GROUPS} SELECT * FROM gp",
    "group_shop_heatmap": f"""WITH {GROUPS}, top AS (SELECT "group" FROM gp GROUP BY "group" ORDER BY sum(products) DESC, "group" LIMIT 14),
        cells AS (SELECT "group", {", ".join(f"avg(CASE WHEN shop = '{s}' THEN median_discount END) AS {s}" for s in SHOPS.values())} FROM gp JOIN top USING ("group") GROUP BY "group")
        SELECT "group", {", ".join(f"round({s}, 6) AS {s}" for s in SHOPS.values())}, round((SELECT avg(x) FROM unnest([{", ".join(SHOPS.values())}]) AS t(x)), 6) AS row_mean FROM cells""",
    "discount_distribution": f"""WITH {STATES} SELECT "group", count(*) AS n, round(min(discount_pct), 6) AS low, round(quantile_cont(discount_pct, 0.25), 6) AS p25, round(median(discount_pct), 6) AS median, round(quantile_cont(discount_pct, 0.75), 6) AS p75, round(max(discount_pct), 6) AS high
        FROM states GROUP BY "group" ORDER BY median(discount_pct) DESC, "group" LIMIT 12""",
    "changing_products": f"""WITH {STATES}, c AS (SELECT {_PS}, count(*) AS n_states, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM states GROUP BY ALL)
        SELECT * FROM c WHERE n_states > 1 OR (SELECT max(n_states) FROM c) <= 1 ORDER BY CASE WHEN (SELECT max(n_states) FROM c) > 1 THEN n_states ELSE n_obs END DESC, canonical_product_id, shop LIMIT 6""",
    "dashboard_meta": f"WITH {FEATURES} SELECT count(*) AS observations, count(DISTINCT canonical_product_id) AS products, count(DISTINCT shop) AS shops, {_rounded(_HOURS.format('min(date)', 'max(date)'), 2)} AS window_hours FROM feat",
    "run_summary": f"WITH {OBSERVATIONS} SELECT count(*) AS rows, count(DISTINCT canonical_product_id) AS products, count(DISTINCT shop) AS shops FROM obs",
    "dedup_final": f"WITH {PROMOTIONS} SELECT canonical_product_id, name, shop, date, original_price, promotion_price, match_status FROM latest",
    "latest_products": f"WITH {PROMOTIONS} SELECT canonical_product_id, name, shop, date, original_price, promotion_price, match_status FROM latest ORDER BY date DESC, canonical_product_id, name, shop, original_price, promotion_price, match_status LIMIT 100",
    "gtin_check": f"WITH {_GTINS} SELECT k, CASE WHEN valid THEN lpad(raw, 14, '0') END AS gtin, CASE WHEN raw IS NULL THEN 'missing' WHEN valid THEN 'valid' ELSE 'invalid' END AS status FROM gt",
    "make_id": "SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, 'prod_' || substr(sha256('source:lenta:' || p_partkey), 1, 16) AS product_id FROM part",
    "price_parse": "SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) * 100 AS BIGINT) AS current_kopecks, CAST(CAST(p_retailprice * 12e-1 AS DECIMAL(12, 2)) * 100 AS BIGINT) AS old_kopecks FROM part",
    "csv_escape": f"WITH {OBSERVATIONS}, s AS (SELECT sequence, ['=', ' +', '-', '@', '', 'x='][sequence % 6 + 1] || shop AS v FROM obs) SELECT sequence, CASE WHEN ltrim(v)[1] IN ('=', '+', '-', '@') THEN chr(39) || v ELSE v END AS value FROM s",
    "sink_valid": f"WITH {_EVENTS} SELECT sequence, canonical_product_id, name, date_trunc('second', date) AS date, original_price, promotion_price FROM bad WHERE NOT (no_name OR no_zone OR no_discount OR no_status)",
    "sink_rejects": f"""WITH {_EVENTS} SELECT sequence, concat_ws(',', CASE WHEN no_zone THEN 'date_zone' END, CASE WHEN no_discount THEN 'discount' END, CASE WHEN no_status THEN 'match_status' END, CASE WHEN no_name THEN 'name_text' END) AS errors
        FROM bad WHERE no_name OR no_zone OR no_discount OR no_status""",
    "identity_gtin": "SELECT 'lenta:' || p_partkey AS source_key, 'prod_c' || p_partkey AS canonical_product_id, 'confirmed' AS status FROM part WHERE p_partkey % 4 = 0",
    "blocked_pages": """SELECT page_id, coalesce(regexp_matches(lower(html), 'checking your browser before accessing|verify you are human to continue|/cdn-cgi/challenge-platform/|id="challenge-form"|<title[^>]*>\\s*(access denied|forbidden|too many requests|service unavailable|captcha|robot check|browser check|just a moment|attention required)'), false) AS blocked FROM pages""",
    "page_products": f"""SELECT 'holodilnik' AS shop, 'https://www.holodilnik.ru/' || CASE p_partkey % 5 WHEN 0 THEN 'product/p-' || p_partkey || '/' WHEN 1 THEN 'goods/' || p_partkey WHEN 2 THEN 'catalog/x/' || p_partkey ELSE 'product/' || p_partkey || '/' END AS source_url,
            CAST(p_partkey AS VARCHAR) AS source_product_id, true AS source_id_is_stable, p_name AS name_raw, CASE WHEN p_partkey % 5 < 2 THEN p_brand ELSE '' END AS brand_raw,
            {_NOW} || CASE WHEN p_partkey % 5 = 3 THEN ' ₽' ELSE '' END AS current_price_text, {_OLD} || CASE WHEN p_partkey % 5 IN (0, 3) THEN ' ₽' ELSE '' END AS old_price_text
        FROM part WHERE p_partkey % 5 <> 4 AND NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0)""",
    "linked_parts": f"""SELECT 'https://shop.example/p/' || p_partkey AS url, p_name AS name, '4006381333931' AS gtin, CAST(p_partkey AS VARCHAR) AS sku, '' AS model, 'red' AS variant, p_brand AS brand, 'a, ' || p_type AS category,
            p_size || ' kg' AS package, {_NOW} AS price FROM part WHERE p_partkey % 3 > 0""",
    "blocked_titles": "SELECT page_id, page_id % 6 <> 4 AS blocked FROM pages",
    "trusted_shops": f"WITH {_competitors(True).replace(_STATUS, _SURE)} SELECT * FROM cmp",
    "favorites_overall": _favorites().replace("PARTITION BY shop ORDER BY score", "ORDER BY score").replace("WINDOW w AS (PARTITION BY shop)", "WINDOW w AS ()"),
    "load_promotions": f"WITH {PROMOTIONS} SELECT canonical_product_id, name, shop, date, original_price, promotion_price, match_status FROM latest WHERE {_LAST30}",
    "raw_checks": """SELECT p_partkey AS k, concat_ws(',', CASE WHEN p_partkey % 17 = 0 THEN 'collected_at' END, CASE WHEN p_partkey % 19 = 0 THEN 'name_raw' END, CASE WHEN p_partkey % 11 = 0 THEN 'shop' END,
            CASE WHEN p_partkey % 23 = 0 THEN 'source_id_is_stable' END, CASE WHEN p_partkey % 13 = 0 THEN 'source_url' END) AS errors FROM part""",
    "gtin_counts": f"WITH {_GTINS} SELECT CASE WHEN raw IS NULL THEN 'missing' WHEN valid THEN 'valid' ELSE 'invalid' END AS status, count(*) AS n FROM gt GROUP BY ALL",
    "price_formats": f"WITH {_CENTS} SELECT k, CASE k % 8 WHEN 3 THEN c // 100 * 100 WHEN 5 THEN c // 100 * 100 WHEN 6 THEN NULL WHEN 7 THEN c // 10 * 10 ELSE c END AS kopecks FROM cents",
    "normalized_names": """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN lower(p_name) || ' ' || p_size * 1000 || 'g' WHEN 1 THEN lower(p_name) || ' ' || (p_size * 1000 + 500) || 'ml' WHEN 2 THEN lower(p_name)
            WHEN 3 THEN 'елка ' || lower(p_name) WHEN 4 THEN 'lcafe ' || lower(p_name) ELSE lower(p_name) || ' x' || p_size END AS name FROM part""",
    "source_keys": """SELECT p_partkey AS k, 'lenta:' || CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 19 = 0 THEN '' ELSE lower(p_name) || ' ' || p_size || 'ml' END AS source_key FROM part""",
    "catalog_issues": """WITH c AS (SELECT p_partkey AS k, 'prod_' || (p_partkey - CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END) AS id, p_partkey // 100 AS a FROM part), good AS (SELECT * FROM c WHERE k % 97 <> 0)
        SELECT 'line' AS problem, 'unknown fields: extra' AS value FROM c WHERE k % 97 = 0
        UNION ALL SELECT 'id', id FROM good GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'alias', '*:alias ' || a FROM good GROUP BY a HAVING count(DISTINCT id) > 1""",
    "identity_match": f"""WITH least AS (SELECT *, {_WORDS} AS w FROM part)
        SELECT 'lenta:' || p_partkey AS source_key, 'prod_c' || min(p_partkey) OVER (PARTITION BY w, p_brand, p_size, p_type) AS canonical_product_id, 'attribute_match' AS method, 1e0 AS score, 'auto_matched' AS status FROM least""",
    "block_keys": f"""WITH named AS (SELECT 'lenta:' || p_partkey AS source_key, string_split(lower(p_name), ' ') || [p_size || 'ml'] AS t, lower(replace(p_brand, '#', '')) AS b, p_size FROM part)
        SELECT source_key, concat_ws(',', 'name:' || array_to_string(list_sort(list_distinct(t)), ':'), CASE WHEN b <> '' AND p_size > 0 THEN 'brand_size:' || b || ':' || p_size || 'ml' END,
            nullif(array_to_string(list_transform(list_sort(list_transform(list_filter(t, lambda x: length(x) >= 5), lambda x: {{'n': -length(x), 't': x}}))[1:3], lambda x: 'token:' || x.t), ','), '')) AS keys FROM named""",
    "api_summary": f"WITH {PROMOTIONS} SELECT count(*) AS observations, count(DISTINCT canonical_product_id) AS products, count(DISTINCT shop) AS shops, {_API} FROM latest WHERE {_LAST30}",
    "api_by_shop": f"WITH {PROMOTIONS} SELECT shop, count(*) AS observations, count(DISTINCT canonical_product_id) AS products, {_API} FROM latest WHERE {_LAST30} GROUP BY shop",
}
