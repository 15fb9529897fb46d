"""Windowed operators over event timelines."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import DAY, EVENTS, HOUR, events, query
from touchline.operators import joins, ordered, windows

W = "WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)"
KEY, ORD = ["user_id"], ["t_ms", "event_id"]


def day_chunk(df, hot_rows=None):
    """Days of a user's timeline, when some user has too many rows for one task."""
    return ordered.split_if_hot(df, KEY, ordered.by_number("t_ms", DAY), hot_rows)


def days():
    """Always split: the plan for a hot key, checked against the same SQL."""
    return ordered.by_number("t_ms", DAY)


@query("wi01_lag_split_keys", f"WITH {EVENTS} SELECT event_id, lag(value) OVER w AS prev_value, lag(k) OVER w AS prev_k FROM ev {W}")
def _(t):
    return ordered.with_lag(events(t), {"value": "prev_value", "k": "prev_k"}, KEY, ORD, days()).select("event_id", "prev_value", "prev_k")


@query("wi02_lead_split_keys", f"WITH {EVENTS} SELECT event_id, lead(value) OVER w AS next_value FROM ev {W}")
def _(t):
    return ordered.with_lead(events(t), {"value": "next_value"}, KEY, ORD, days()).select("event_id", "next_value")


@query("wi04_carry_forward_split_keys", f"WITH {EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM ev")
def _(t):
    d = events(t).withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return ordered.carry_forward(d, "p", "last_purchase", KEY, ORD, days()).select("event_id", "last_purchase")


@query("wi07_running_max", f"WITH {EVENTS} SELECT event_id, max(k) OVER w AS top_k FROM ev {W}")
def _(t):
    e = events(t)
    return ordered.running_max(e, "k", "top_k", KEY, ORD, day_chunk(e)).select("event_id", "top_k")


@query("wi07_running_max_split_keys", f"WITH {EVENTS} SELECT event_id, max(k) OVER w AS top_k FROM ev {W}")
def _(t):
    return ordered.running_max(events(t), "k", "top_k", KEY, ORD, days()).select("event_id", "top_k")


@query("wi09_changes_only", f"WITH {EVENTS}, l AS (SELECT event_id, event_type, lag(event_type) OVER w AS o FROM ev {W}) SELECT event_id, event_type FROM l WHERE o IS NULL OR o <> event_type")
def _(t):
    e = events(t)
    return windows.changes_only(e, KEY, ["event_type"], ORD, day_chunk(e)).select("event_id", "event_type")


@query("wi10_gap_segments", f"""WITH {EVENTS}, s AS (SELECT *, event_type <> 'error' AND k >= 40 AS has FROM ev), a AS (SELECT *, coalesce(lag(has) OVER w, true) AS prev, max(t_ms) OVER (PARTITION BY user_id) AS last_t FROM s {W}),
 b AS (SELECT *, (SELECT min(n.t_ms) FROM s n WHERE n.user_id = a.user_id AND n.has AND n.t_ms > a.t_ms) AS e FROM a WHERE NOT has AND prev)
SELECT user_id, t_ms AS start_ms, coalesce(e, last_t) AS end_ms, coalesce(e, last_t) - t_ms + CASE WHEN e IS NULL THEN 1000 ELSE 0 END AS duration_ms FROM b WHERE coalesce(e, last_t) - t_ms + CASE WHEN e IS NULL THEN 1000 ELSE 0 END >= {6 * HOUR}""")
def _(t):
    e = events(t).withColumn("has", (F.col("event_type") != "error") & (F.col("k") >= 40))
    return windows.gap_segments(e, KEY, "t_ms", "has", 6 * HOUR, 1000, day_chunk(e))


@query("wi10_time_jumps", f"WITH {EVENTS}, n AS (SELECT user_id, t_ms, lead(t_ms) OVER w AS nx FROM ev {W}) SELECT user_id, t_ms AS start_ms, nx AS end_ms, nx - t_ms AS duration_ms FROM n WHERE nx - t_ms >= {DAY}")
def _(t):
    e = events(t)
    return windows.time_jumps(e, KEY, "t_ms", DAY, day_chunk(e))


@query("wi11_clock_stopped", f"WITH {EVENTS} SELECT event_id, coalesce(lag(day(ts)) OVER w = day(ts) AND lag(k % 3) OVER w = k % 3, false) AS clock_stopped FROM ev {W}")
def _(t):
    e = events(t).withColumns({"period": F.dayofmonth("ts"), "clock": F.col("k") % 3})
    return windows.clock_stopped(e, KEY, "period", "clock", ORD, day_chunk(e)).select("event_id", "clock_stopped")


@query("wi12_streak_score", f"""WITH {EVENTS}, h AS (SELECT *, event_type <> 'error' AS hit FROM ev), a AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER w AS isl FROM h {W}),
 b AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY user_id, isl ORDER BY t_ms, event_id) AS streak FROM a)
SELECT event_id, CASE WHEN hit THEN streak ELSE 0 END AS streak, CASE WHEN hit THEN CASE WHEN event_type = 'view' THEN 100 ELSE 50 END * CASE WHEN streak - 1 >= 30 THEN 4 WHEN streak - 1 >= 20 THEN 3 WHEN streak - 1 >= 10 THEN 2 ELSE 1 END ELSE 0 END AS points FROM b""")
def _(t):
    e = events(t)
    base = F.when(F.col("event_type") == "view", 100).otherwise(50)
    return windows.streak_score(e, KEY, ORD, F.col("event_type") != "error", base, day_chunk(e)).select("event_id", "streak", "points")


@query("wi12_streak_score_split_keys", f"""WITH {EVENTS}, h AS (SELECT *, event_type <> 'error' AS hit FROM ev), a AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER w AS isl FROM h {W})
SELECT event_id, CASE WHEN hit THEN count(*) FILTER (WHERE hit) OVER (PARTITION BY user_id, isl ORDER BY t_ms, event_id) ELSE 0 END AS streak FROM a""")
def _(t):
    return windows.streak_score(events(t), KEY, ORD, F.col("event_type") != "error", F.lit(1), days()).select("event_id", "streak")


@query("wi13_sequence", f"WITH {EVENTS} SELECT event_id, row_number() OVER w - 1 AS seq FROM ev {W}")
def _(t):
    e = events(t)
    return ordered.with_sequence(e, "seq", KEY, ORD, day_chunk(e)).select("event_id", "seq")


@query("wi13_sequence_split_keys", f"WITH {EVENTS} SELECT event_id, row_number() OVER w - 1 AS seq FROM ev {W}")
def _(t):
    return ordered.with_sequence(events(t), "seq", KEY, ORD, days()).select("event_id", "seq")


@query("wi14_monotonic_only", f"WITH {EVENTS}, m AS (SELECT event_id, k, max(k) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev) SELECT event_id, k FROM m WHERE b IS NULL OR k > b")
def _(t):
    e = events(t)
    return joins.monotonic_only(e, "k", KEY, ORD, day_chunk(e)).select("event_id", "k")


BREAK = f"""SELECT event_id, NOT coalesce(pp = period AND dt > 0 AND dt <= {6 * HOUR} AND NOT (step / (dt / 1000.0::DOUBLE) > 0.02), false) AS segment_start, coalesce(pp = period AND dt > 0 AND dt <= {6 * HOUR} AND step / (dt / 1000.0::DOUBLE) > 0.02, false) AS implausible, coalesce(pp = period AND dt > {6 * HOUR}, false) AS gap_too_long
FROM (SELECT event_id, week(ts) AS period, lag(week(ts)) OVER w AS pp, t_ms - lag(t_ms) OVER w AS dt, sqrt((value - lag(value) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS step FROM ev {W})"""


def _moving(t):
    return events(t).withColumns({"period": F.weekofyear("ts"), "x_m": F.col("value"), "y_m": F.col("k").cast("double")})


@query("wi15_segment_break", f"WITH {EVENTS} {BREAK}")
def _(t):
    e = _moving(t)
    return windows.segment_break(e, KEY, ORD, 6 * HOUR, 0.02, day_chunk(e)).select("event_id", "segment_start", "implausible", "gap_too_long")


@query("wi15_segment_break_split_keys", f"WITH {EVENTS} {BREAK}")
def _(t):
    return windows.segment_break(_moving(t), KEY, ORD, 6 * HOUR, 0.02, days()).select("event_id", "segment_start", "implausible", "gap_too_long")


@query("wi20_top_k_per_group", "SELECT event_id, user_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def _(t):
    return ordered.top_k(t("events", "event_id", "user_id", "value"), KEY, [F.desc("value"), F.asc("event_id")], 3)


@query("wi21_last_n", "SELECT event_id, user_id, from_end FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end FROM events) WHERE from_end <= 30")
def _(t):
    return ordered.last_n(t("events", "event_id", "user_id"), KEY, ["event_id"], 30)


TEAMSEC = f"""ts AS (SELECT event_type AS match_id, t_ms // {7 * DAY} AS period, t_ms // {HOUR} AS sec, min(t_ms) AS t_ms, avg(value) FILTER (WHERE user_id % 2 = 0) AS home_w, avg(value) FILTER (WHERE user_id % 2 = 1) AS away_w, avg(k) FILTER (WHERE user_id % 2 = 0) AS home_d FROM ev GROUP BY 1, 2, 3)"""


def team_seconds(t):
    e = events(t).withColumns({"match_id": F.col("event_type"), "period": F.floor(F.col("t_ms") / (7 * DAY)), "sec": F.floor(F.col("t_ms") / HOUR)})
    even = F.col("user_id") % 2 == 0
    return e.groupBy("match_id", "period", "sec").agg(F.min("t_ms").alias("t_ms"), F.avg(F.when(even, F.col("value"))).alias("home_w"),
                                                      F.avg(F.when(~even, F.col("value"))).alias("away_w"), F.avg(F.when(even, F.col("k"))).alias("home_d"))


def _trend(c):
    last = f"list_avg(list_filter(list_slice(l, len(l) - 2, len(l)), lambda r: r.{c} IS NOT NULL).list_transform(lambda r: r.{c}))"
    first = f"list_avg(list_filter(list_slice(l, 1, 3), lambda r: r.{c} IS NOT NULL).list_transform(lambda r: r.{c}))"
    return f"round({last} - {first}, 9)"


def _mean(c):
    return f"round(list_avg(list_filter(l, lambda r: r.{c} IS NOT NULL).list_transform(lambda r: r.{c})), 9)"


@query("wi22_moment_vectors", f"""WITH {EVENTS}, {TEAMSEC}, sp AS (SELECT match_id, period, min(sec) + 9 AS lo, max(sec) AS hi FROM ts GROUP BY 1, 2), an AS (SELECT match_id, period, unnest(range(lo, hi + 1, 2)) AS anchor FROM sp),
 g AS (SELECT an.match_id, an.period, an.anchor, list({{'sec': sec, 'home_w': home_w, 'away_w': away_w, 'home_d': home_d}} ORDER BY sec) AS l FROM an JOIN ts ON ts.match_id = an.match_id AND ts.period = an.period AND ts.sec > anchor - 10 AND ts.sec <= anchor GROUP BY 1, 2, 3 HAVING count(*) >= 8),
 v AS (SELECT match_id, period, anchor, {_mean('home_w')} AS hw, {_trend('home_w')} AS hwt, {_mean('away_w')} AS aw, {_trend('away_w')} AS awt, {_mean('home_d')} AS hd, {_trend('home_d')} AS hdt FROM g)
SELECT * FROM v WHERE ((hw IS NULL)::INT + (hwt IS NULL)::INT + (aw IS NULL)::INT + (awt IS NULL)::INT + (hd IS NULL)::INT + (hdt IS NULL)::INT) / 6.0 <= 0.25""")
def _(t):
    m = windows.moment_vectors(team_seconds(t), ["match_id"], ["home_w", "away_w", "home_d"])
    r = lambda c, n: F.round(c, 9).alias(n)
    return m.select("match_id", "period", "anchor", r("home_w__mean", "hw"), r("home_w__trend", "hwt"), r("away_w__mean", "aw"), r("away_w__trend", "awt"), r("home_d__mean", "hd"), r("home_d__trend", "hdt"))


@query("wi23_zscore", "SELECT event_id, round(coalesce((v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p IS NULL OR stddev_pop(v) OVER p = 0 THEN 1 ELSE stddev_pop(v) OVER p END, 0), 6) AS z FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_type = 'error' THEN 1.0 ELSE value END AS v FROM events) WINDOW p AS (PARTITION BY event_type)")
def _(t):
    from touchline.functions.scoring import zscore
    v = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_type") == "error", 1.0).otherwise(F.col("value"))
    return zscore(t("events").withColumn("v", v), {"v": "z"}, ["event_type"]).select("event_id", F.round("z", 6).alias("z"))


FILL = "coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_ms, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("wi24_fill_both", f"WITH {EVENTS}, s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM ev) SELECT event_id, {FILL} AS v FROM s")
def _(t):
    e = events(t).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.fill_both(e, ["v"], KEY, ORD, day_chunk(e)).select("event_id", "v")


@query("wi24_fill_both_split_keys", f"WITH {EVENTS}, s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM ev) SELECT event_id, {FILL} AS v FROM s")
def _(t):
    e = events(t).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.fill_both(e, ["v"], KEY, ORD, days()).select("event_id", "v")


@query("wi25_moving_avg3", f"WITH {EVENTS} SELECT event_id, (coalesce(lag(value) OVER w, 0.0) + value + coalesce(lead(value) OVER w, 0.0)) / 3 AS smooth FROM ev {W}")
def _(t):
    e = events(t)
    return windows.moving_avg3(e, "value", "smooth", KEY, ORD, day_chunk(e)).select("event_id", "smooth")


@query("wi26_lyric_sections", f"""WITH l AS (SELECT user_id, t_ms AS t, lead(t_ms) OVER w AS nx, lag(t_ms) OVER w AS pv, max(t_ms) OVER (PARTITION BY user_id) + {3 * DAY} AS dur FROM (SELECT user_id, (epoch_us(ts) // 1000) - 1704067200000 AS t_ms, event_id FROM events) {W}),
 g AS (SELECT *, coalesce(nx, dur) - t AS gap, sum(CASE WHEN pv IS NULL OR t - pv > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS isl FROM l), v AS (SELECT user_id, isl, min(t) AS s, max(t) AS e, arg_max(gap, t) AS gap, arg_max(nx, t) AS nx, max(dur) AS dur FROM g GROUP BY 1, 2)
SELECT user_id, 'vocal' AS type, s AS start_ms, e + least(gap, 3000) AS end_ms FROM v UNION ALL SELECT user_id, 'instrumental', e + 2000, nx - 500 FROM (SELECT v.*, lead(s) OVER (PARTITION BY user_id ORDER BY isl) AS nx2 FROM v) WHERE nx2 IS NOT NULL
UNION ALL SELECT user_id, 'instrumental', e + 3000, dur - 1000 FROM v WHERE gap > {DAY} AND isl = (SELECT max(isl) FROM v x WHERE x.user_id = v.user_id) UNION ALL SELECT user_id, 'instrumental', 2000, s - 500 FROM v WHERE isl = 1 AND s > {DAY}""")
def _(t):
    e = events(t).withColumn("t_ms", F.col("t_ms") - 1704067200000)
    d = e.join(e.groupBy("user_id").agg((F.max("t_ms") + 3 * DAY).alias("dur")), "user_id")
    return windows.lyric_sections(d, KEY, "t_ms", "dur", DAY, day_chunk(d))


@query("wi27_period_offsets", f"WITH {EVENTS}, p AS (SELECT user_id, CAST(week(ts) AS INTEGER) AS period, max(t_ms) - min(t_ms) AS dur FROM ev GROUP BY 1, 2) SELECT user_id, period, CAST(coalesce(sum(dur) OVER (PARTITION BY user_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM p")
def _(t):
    p = events(t).groupBy("user_id", F.weekofyear("ts").alias("period")).agg((F.max("t_ms") - F.min("t_ms")).alias("dur"))
    return windows.period_offsets(p, KEY, "period", "dur").select("user_id", "period", "offset_ms")
