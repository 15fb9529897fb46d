"""Movement metrics over the events table: users move over (value, k), a day is a window, a week a period."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from touchline.catalog.base import DAY, EVENTS, HOUR, events, query
from touchline.operators import ordered, tracking

CFG = replace(tracking.SOCCER, max_gap_ms=12 * HOUR, max_speed_player=0.01, max_speed_ball=0.02, high_speed=0.0005, sprint_speed=0.001,
              accel=1e-8, window_ms=DAY, min_outfield=5, ema_alpha=0.36787944117144233)
EPOCH = 1704067200000

POS = f"""pos AS (SELECT event_id AS seq, t_ms, user_id, CASE WHEN user_id % 10 = 0 THEN 'ball' ELSE 'player' END AS et, CAST(user_id % 2 AS VARCHAR) AS team, week(ts) AS period, value AS x, k::DOUBLE AS y,
 CASE WHEN k % 11 = 0 THEN NULL ELSE k - 50.0::DOUBLE END AS xa, value - 40 AS ya, event_id % 3 <> 0 AS det, CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' END AS poss FROM ev)"""


def positions(t):
    e = events(t)
    return e.select(F.lit("s").alias("session_id"), F.lit("m").alias("match_id"), F.col("user_id").cast("string").alias("entity_id"),
                    F.when(F.col("user_id") % 10 == 0, "ball").otherwise("player").alias("entity_type"), (F.col("user_id") % 2).cast("string").alias("team_id"),
                    F.col("event_id").alias("seq"), "t_ms", F.weekofyear("ts").alias("period"), F.col("value").alias("x_m"), F.col("k").cast("double").alias("y_m"),
                    F.when(F.col("k") % 11 != 0, F.col("k") - F.lit(50.0)).alias("x_att"), (F.col("value") - 40).alias("y_att"), (F.col("event_id") % 3 != 0).alias("is_detected"),
                    F.when(F.col("event_id") % 4 == 0, "0").when(F.col("event_id") % 4 == 1, "1").alias("possession"))


def periods(t):
    return events(t).select(F.lit("m").alias("match_id"), F.weekofyear("ts").alias("period")).distinct().withColumn(
        "offset_ms", F.lit(EPOCH) + (F.col("period") - 1).cast("bigint") * (7 * DAY))


OBS = f"""{POS}, lagd AS (SELECT *, row_number() OVER w AS rn, t_ms - lag(t_ms) OVER w AS dt, lag(t_ms) OVER w AS pt, lag(period) OVER w AS pp, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(team) OVER w AS pteam, lag(det) OVER w AS pdet,
  CASE WHEN xa IS NULL OR ya IS NULL THEN NULL ELSE least(greatest(CAST(trunc((xa + 52.5) / 105.0 * 21) AS INTEGER), 0), 20) END AS cx, CASE WHEN xa IS NULL OR ya IS NULL THEN NULL ELSE least(greatest(CAST(trunc((ya + 34.0) / 68.0 * 13) AS INTEGER), 0), 12) END AS cy
  FROM pos WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 raw AS (SELECT *, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, sqrt((x - px) ** 2 + (y - py) ** 2) AS step FROM lagd WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 brk AS (SELECT *, coalesce(pp = period AND dt > 0 AND dt <= {12 * HOUR} AND NOT (step / (dt / 1000.0::DOUBLE) > CASE WHEN et = 'ball' THEN 0.02 ELSE 0.01 END), false) AS ok, coalesce(pp = period AND dt > {12 * HOUR}, false) AS gap FROM raw),
 ema AS (SELECT user_id, rn, x AS sx, y AS sy, NULL::DOUBLE AS d, NULL::DOUBLE AS v, NULL::DOUBLE AS acc, false AS spr, 1000000000::BIGINT AS below, false AS entry FROM brk WHERE rn = 1
  UNION ALL SELECT user_id, rn, sx, sy, d, v, CASE WHEN d IS NOT NULL THEN (v - pv) / (dt / 1000.0::DOUBLE) END, CASE WHEN pl THEN v >= 0.001 ELSE spr0 END,
   CASE WHEN NOT pl THEN below0 WHEN v >= 0.001 THEN 0 WHEN spr0 THEN dt ELSE below0 + dt END, coalesce(pl AND v >= 0.001 AND NOT spr0 AND below0 >= 1000, false)
  FROM (SELECT *, d / (dt / 1000.0::DOUBLE) AS v FROM (SELECT b.user_id, b.rn, b.dt, CASE WHEN ok THEN 0.36787944117144233::DOUBLE * b.x + (1.0::DOUBLE - 0.36787944117144233::DOUBLE) * e.sx ELSE b.x END AS sx, CASE WHEN ok THEN 0.36787944117144233::DOUBLE * b.y + (1.0::DOUBLE - 0.36787944117144233::DOUBLE) * e.sy ELSE b.y END AS sy, ok AND et = 'player' AS pl,
     CASE WHEN ok THEN sqrt((0.36787944117144233::DOUBLE * b.x + (1.0::DOUBLE - 0.36787944117144233::DOUBLE) * e.sx - e.sx) ** 2 + (0.36787944117144233::DOUBLE * b.y + (1.0::DOUBLE - 0.36787944117144233::DOUBLE) * e.sy - e.sy) ** 2) END AS d, e.v AS pv, e.spr AS spr0, e.below AS below0 FROM ema e JOIN brk b ON b.user_id = e.user_id AND b.rn = e.rn + 1))),
 obs AS (SELECT b.*, e.sx, e.sy, e.d, e.v, e.acc, e.entry FROM brk b JOIN ema e USING (user_id, rn))"""


def rec(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def obs(t, hot=None):
    p = positions(t)
    return tracking.kinematics(p, CFG, tracking.plan_chunk(p, hot))


OBS_SQL = rec(f"WITH {EVENTS}, {OBS} SELECT seq, round(sx, 6) AS sx, round(sy, 6) AS sy, round(d, 6) AS dist_m, round(v * 1000, 6) AS mm_s, round(acc * 1e9, 2) AS acc, entry AS sprint_entry FROM obs")


def obs_out(d):
    return d.select("seq", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), F.round("dist_m", 6).alias("dist_m"), F.round(F.col("speed_mps") * 1000, 6).alias("mm_s"),
                    F.round(F.col("accel_mps2") * 1e9, 2).alias("acc"), "sprint_entry")


@query("wi16_smoothing_and_kinematics", OBS_SQL)
def _(t):
    return obs_out(obs(t))


@query("wi16_kinematics_split_keys", OBS_SQL)
def _(t):
    """The plan for entities with too many rows: blocks of sequence numbers, stages written in between."""
    p = positions(t)
    return obs_out(tracking.kinematics(p, CFG, ordered.by_number("seq", 2000)))


IV = f"""iv AS (SELECT *, gap AS is_gap, EPOCHP + (period - 1) * {7 * DAY} AS off, CASE WHEN gap THEN t_ms ELSE pt END AS st FROM obs WHERE et = 'player' AND (ok OR gap)),
 ivw AS (SELECT *, period * 10000 + greatest(st - off, 0) // {DAY} AS win, coalesce(pteam, team) AS tm FROM iv)""".replace("EPOCHP", str(EPOCH))


@query("st08_player_windows", rec(f"""WITH {EVENTS}, {OBS}, {IV} SELECT CAST(user_id AS VARCHAR) AS entity_id, win AS "window", arg_min(tm, seq) AS team_id, round(sum(CASE WHEN NOT is_gap THEN d ELSE 0 END), 6) AS distance_m, round(sum(CASE WHEN NOT is_gap THEN step ELSE 0 END), 6) AS distance_raw_m,
 CAST(sum(CASE WHEN NOT is_gap THEN dt ELSE 0 END) AS BIGINT) AS active_ms, CAST(sum(CASE WHEN NOT is_gap AND det AND pdet THEN dt ELSE 0 END) AS BIGINT) AS detected_ms, CAST(sum(CASE WHEN NOT is_gap AND v >= 0.0005 THEN dt ELSE 0 END) AS BIGINT) AS hi_ms,
 CAST(sum(CASE WHEN NOT is_gap AND v >= 0.001 THEN dt ELSE 0 END) AS BIGINT) AS sprint_ms, count(*) FILTER (WHERE entry AND NOT is_gap) AS sprint_count, count(*) FILTER (WHERE NOT is_gap AND acc >= 1e-8) AS accel_count, count(*) FILTER (WHERE NOT is_gap AND acc <= -1e-8) AS decel_count,
 CAST(sum(CASE WHEN NOT is_gap AND poss = tm THEN dt ELSE 0 END) AS BIGINT) AS in_poss_ms, CAST(sum(CASE WHEN NOT is_gap AND poss <> tm THEN dt ELSE 0 END) AS BIGINT) AS out_poss_ms, CAST(sum(CASE WHEN NOT is_gap AND poss IS NULL THEN dt ELSE 0 END) AS BIGINT) AS poss_unknown_ms,
 count(*) FILTER (WHERE NOT is_gap) AS n_intervals, CAST(sum(CASE WHEN is_gap THEN dt ELSE 0 END) AS BIGINT) AS excluded_gap_ms, CAST(sum(CASE WHEN NOT is_gap AND pcx IS NULL THEN dt ELSE 0 END) AS BIGINT) AS no_cell_ms, min(off) + (win % 10000) * {DAY} AS window_start_ms FROM ivw GROUP BY 1, 2"""))
def _(t):
    w = tracking.with_bounds(tracking.player_windows(tracking.attribute_intervals(obs(t), periods(t), CFG), CFG), CFG)
    return w.select("entity_id", "window", "team_id", F.round("distance_m", 6).alias("distance_m"), F.round("distance_raw_m", 6).alias("distance_raw_m"), "active_ms", "detected_ms", "hi_ms", "sprint_ms",
                    "sprint_count", "accel_count", "decel_count", "in_poss_ms", "out_poss_ms", "poss_unknown_ms", "n_intervals", "excluded_gap_ms", "no_cell_ms", "window_start_ms")


@query("st11_dwell", rec(f"WITH {EVENTS}, {OBS}, {IV} SELECT CAST(user_id AS VARCHAR) AS entity_id, win AS \"window\", pcx AS cell_x, pcy AS cell_y, CAST(sum(dt) AS BIGINT) AS dwell_ms FROM ivw WHERE NOT is_gap AND pcx IS NOT NULL GROUP BY 1, 2, 3, 4"))
def _(t):
    return tracking.dwell(tracking.attribute_intervals(obs(t), periods(t), CFG)).select("entity_id", "window", "cell_x", "cell_y", "dwell_ms")


# ------------------------------------------------------------------ team shape: every 20 events are one frame
FR = f"""fp AS (SELECT event_id // 20 AS seq, event_id, user_id, CAST(user_id % 2 AS VARCHAR) AS team, k - 50.0::DOUBLE AS x, value - 40 AS y, event_id % 3 <> 0 AS det FROM ev), ft AS (SELECT seq, team FROM (SELECT DISTINCT seq FROM fp), (SELECT unnest(['0', '1']) AS team)),
 outf AS (SELECT * FROM fp WHERE user_id % 25 <> 0)"""


def frame_positions(t):
    e = events(t)
    return e.select(F.lit("s").alias("session_id"), F.lit("m").alias("match_id"), F.col("event_id").cast("string").alias("entity_id"), F.lit("player").alias("entity_type"), (F.col("user_id") % 2).cast("string").alias("team_id"),
                    F.floor(F.col("event_id") / 20).alias("seq"), (F.col("k") - F.lit(50.0)).alias("x_att"), (F.col("value") - 40).alias("y_att"), (F.col("k") - F.lit(50.0)).alias("x_m"), (F.col("value") - 40).alias("y_m"),
                    (F.col("event_id") % 3 != 0).alias("is_detected"), "t_ms", "user_id")


def frame_rows(t):
    return frame_positions(t).groupBy("session_id", "match_id", "seq").agg(F.min("t_ms").alias("t_ms")).withColumns(
        {"period": F.lit(1), "possession": F.when(F.col("seq") % 3 == 0, "0").when(F.col("seq") % 3 == 1, "1")})


def teams(t):
    """The two teams of the match, taken from the table."""
    return t("events", "user_id").select(F.lit("m").alias("match_id"), (F.col("user_id") % 2).cast("string").alias("team_id")).distinct()


def team_frames(t, cfg=CFG, spacing=False):
    p = frame_positions(t)
    gk = p.filter("user_id % 25 = 0").select("match_id", "entity_id")
    return tracking.team_frames(p, frame_rows(t), gk, cfg, teams(t), hooks=[tracking.SPACING] if spacing else [])


SHAPE_SQL = f"""agg AS (SELECT seq, team, count(*) AS n, count(*) FILTER (WHERE det) AS nd, avg(x) AS cx, max(y) - min(y) AS w, max(x) - min(x) AS dp, list_avg(list_slice(list_sort(list(x)), 1, 4)) + 52.5 AS line FROM outf GROUP BY 1, 2),
 hull AS (SELECT seq, team, sum(ax * by_ - bx * ay) / 2 AS area FROM (SELECT DISTINCT a.seq, a.team, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM outf a JOIN outf b ON a.seq = b.seq AND a.team = b.team AND (a.x <> b.x OR a.y <> b.y)
   WHERE NOT EXISTS (SELECT 1 FROM outf c WHERE c.seq = a.seq AND c.team = a.team AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0))))) GROUP BY 1, 2)"""


@query("ag23_team_shape", f"""WITH {EVENTS}, {FR}, {SHAPE_SQL} SELECT ft.seq, ft.team AS team_id, coalesce(n, 0) AS n_outfield, coalesce(nd, 0) AS n_detected, coalesce(n >= 5, false) AS sufficient, round(CASE WHEN n >= 5 THEN cx END, 8) AS centroid_x, round(CASE WHEN n >= 5 THEN w END, 8) AS width_m, round(CASE WHEN n >= 5 THEN dp END, 8) AS depth_m,
 round(CASE WHEN n >= 5 THEN line END, 8) AS def_line_height_m, round(CASE WHEN n >= 5 THEN coalesce(area, 0) END, 6) AS hull_area_m2, CASE ft.seq % 3 WHEN 0 THEN ft.team = '0' WHEN 1 THEN ft.team = '1' END AS in_possession FROM ft LEFT JOIN agg USING (seq, team) LEFT JOIN hull USING (seq, team)""")
def _(t):
    r = lambda c: F.round(c, 8).alias(c)
    return team_frames(t).select("seq", "team_id", "n_outfield", "n_detected", "sufficient", r("centroid_x"), r("width_m"), r("depth_m"), r("def_line_height_m"), F.round("hull_area_m2", 6).alias("hull_area_m2"), "in_possession")


@query("ud03_spacing_hook", f"""WITH {EVENTS}, {FR}, s AS (SELECT seq, team, count(*) AS n, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS fs, count(*) FILTER (WHERE x >= 94 * 0.3048::DOUBLE / 2 - 19 * 0.3048::DOUBLE AND abs(y) <= 8 * 0.3048::DOUBLE) AS paint, count(*) FILTER (WHERE x >= 94 * 0.3048::DOUBLE / 2 - 14 * 0.3048::DOUBLE AND abs(y) >= 22 * 0.3048::DOUBLE) AS corner FROM fp GROUP BY 1, 2),
 pw AS (SELECT a.seq, a.team, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM fp a JOIN fp b ON a.seq = b.seq AND a.team = b.team AND a.event_id <> b.event_id GROUP BY 1, 2), o AS (SELECT *, CASE WHEN n >= 2 THEN CASE seq % 3 WHEN 0 THEN team = '0' WHEN 1 THEN team = '1' ELSE fs >= 0.6 END END AS off FROM s)
SELECT ft.seq, ft.team AS team_id, off AS offense, CASE WHEN off THEN paint END AS paint_count, CASE WHEN off THEN corner END AS corner_count, round(m, 3) AS mean_pairwise_m FROM ft LEFT JOIN o USING (seq, team) LEFT JOIN pw USING (seq, team)""")
def _(t):
    from touchline.operators.tracking import BASKETBALL
    return team_frames(t, BASKETBALL, True).select("seq", "team_id", "offense", "paint_count", "corner_count", "mean_pairwise_m")


@query("st09_team_windows", f"""WITH {EVENTS}, {FR}, {SHAPE_SQL}, fm AS (SELECT event_id // 20 AS seq, min(t_ms) AS t FROM ev GROUP BY 1), j AS (SELECT ft.seq, ft.team, t, coalesce(n >= 5, false) AS ok, round(w, 4) AS w, round(dp, 4) AS dp FROM ft JOIN fm USING (seq) LEFT JOIN agg USING (seq, team))
SELECT team AS team_id, 10000 + (t - {EPOCH}) // {DAY} AS "window", count(*) AS n_frames, count(*) FILTER (WHERE ok) AS n_sufficient, round(avg(w) FILTER (WHERE ok), 8) AS mean_width_m, round(avg(dp) FILTER (WHERE ok), 8) AS mean_depth_m,
 count(*) FILTER (WHERE CASE seq % 3 WHEN 0 THEN team = '0' WHEN 1 THEN team = '1' ELSE false END) AS in_possession_frames FROM j GROUP BY 1, 2""")
def _(t):
    per = frame_rows(t).select("match_id", "period").distinct().withColumn("offset_ms", F.lit(EPOCH))
    w = tracking.team_means(tracking.team_windows(team_frames(t), per, CFG))
    return w.select("team_id", "window", "n_frames", "n_sufficient", F.round("mean_width_m", 8).alias("mean_width_m"), F.round("mean_depth_m", 8).alias("mean_depth_m"), "in_possession_frames")
