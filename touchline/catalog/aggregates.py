"""Aggregates, serving views and catalog rollups on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import DAY, EVENTS, HOUR, events, query
from touchline.catalog.joins import FRAMES, frames
from touchline.functions import geometry as geo
from touchline.operators import aggregates as agg
from touchline.operators import quality
from touchline.plans import analyst, serving
from touchline.sources.payloads import SOCCER_STATS


@query("ag04_zone_profile", "SELECT l_suppkey, l_returnflag, l_linestatus, CAST(l_linenumber AS INTEGER) AS zone, count(*) AS fga, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS fgm, round(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 4) AS fg_pct FROM lineitem GROUP BY 1, 2, 3, 4")
def _(t):
    d = t("lineitem").withColumns({"made": F.when(F.col("l_discount") > 0.05, 1).otherwise(0), "zone": F.col("l_linenumber")})
    return agg.zone_profile(d, ["l_suppkey", "l_returnflag", "l_linestatus", "zone"], "made")


@query("ag05_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t("events", "user_id", "event_type").distinct()


@query("ag07_dedup_conflicts", """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey) AS rn FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM a WHERE rn = 1)
SELECT f.l_orderkey, f.l_linenumber, f.l_returnflag, count(*) - 1 AS duplicates, count(*) FILTER (WHERE a.l_returnflag <> f.l_returnflag) AS conflicts FROM f JOIN a USING (l_orderkey, l_linenumber) GROUP BY 1, 2, 3""")
def _(t):
    d = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_partkey")
    return agg.dedup_conflicts(d, ["l_orderkey", "l_linenumber"], ["l_returnflag"], ["l_extendedprice", "l_partkey"])


@query("ag08_team_seconds", f"WITH {EVENTS} SELECT event_type, t_ms // {HOUR} AS sec, min(t_ms) AS t_ms, count(*) AS n, round(avg(value) FILTER (WHERE k > 30), 9) AS value, round(avg(k), 9) AS k, round(avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 9) AS poss_share FROM ev GROUP BY 1, 2")
def _(t):
    d = events(t).withColumns({"sec": F.floor(F.col("t_ms") / HOUR), "sufficient": F.col("k") > 30})
    s = agg.team_seconds(d, ["event_type", "sec"], ["value"], ["k"], poss=F.col("user_id") % 2 == 0)
    return s.select("event_type", "sec", "t_ms", "n", *[F.round(c, 9).alias(c) for c in ("value", "k", "poss_share")])


PW = f"""pw AS (SELECT user_id AS entity_id, user_id % 2 AS team_id, t_ms // {DAY} AS "window", CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS distance_m, CAST(sum(CASE WHEN k > 80 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS hi_distance_m,
 count(*) FILTER (WHERE event_type = 'purchase') AS sprint_count, max(value) AS max_speed_mps, CAST(sum(k) * 1000 AS BIGINT) AS active_ms, CAST(sum(CASE WHEN event_type <> 'error' THEN k ELSE 0 END) * 1000 AS BIGINT) AS detected_ms, CAST(sum(k % 3) AS BIGINT) AS excluded_gap_ms, bool_or(event_type = 'view') AS is_final, (t_ms // {DAY}) * {DAY} AS window_start_ms FROM ev GROUP BY 1, 2, 3, window_start_ms)"""


def player_windows(t):
    e = events(t)
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.groupBy(F.col("user_id").alias("entity_id"), (F.col("user_id") % 2).alias("team_id"), F.floor(F.col("t_ms") / DAY).alias("window")).agg(
        F.sum(cents).alias("distance_m"), F.sum(F.when(F.col("k") > 80, cents).otherwise(0)).alias("hi_distance_m"), F.count_if(F.col("event_type") == "purchase").alias("sprint_count"),
        F.max("value").alias("max_speed_mps"), (F.sum("k") * 1000).alias("active_ms"), (F.sum(F.when(F.col("event_type") != "error", F.col("k")).otherwise(0)) * 1000).alias("detected_ms"),
        F.sum(F.col("k") % 3).alias("excluded_gap_ms"), F.bool_or(F.col("event_type") == "view").alias("is_final")).withColumns(
        {"window_start_ms": F.col("window") * DAY, "window_end_ms": (F.col("window") + 1) * DAY})


@query("ag09_count_if", "SELECT user_id, count(*) FILTER (WHERE value > 20) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("value") > 20).alias("n"))


TOTALS = f"""tot AS (SELECT entity_id, min(team_id) AS team_id, CAST(sum(distance_m) AS BIGINT) AS distance_m, CAST(sum(hi_distance_m) AS BIGINT) AS hi_distance_m, CAST(sum(sprint_count) AS BIGINT) AS sprints, max(max_speed_mps) AS max_speed_mps, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(detected_ms) AS BIGINT) AS detected_ms, CAST(sum(excluded_gap_ms) AS BIGINT) AS excluded_gap_ms, count(*) FILTER (WHERE is_final) AS final_windows, count(*) AS windows FROM pw GROUP BY 1 HAVING sum(active_ms) > 0)"""


@query("ag10_player_totals", f"WITH {EVENTS}, {PW}, {TOTALS} SELECT * FROM tot")
def _(t):
    return agg.player_totals(player_windows(t))


@query("ag11_rates", f"WITH {EVENTS}, {PW}, {TOTALS} SELECT entity_id, round(distance_m / (active_ms / 60000), 1) AS distance_per_active_min_m, round(detected_ms / active_ms, 3) AS detected_share FROM tot")
def _(t):
    return agg.rates(agg.player_totals(player_windows(t))).select("entity_id", "distance_per_active_min_m", "detected_share")


@query("ag12_exact_quantiles", "WITH o AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY round(value * 100), event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(v) FILTER (WHERE i = CAST(floor(0.5 * n) AS BIGINT)) AS p50, max(v) FILTER (WHERE i = CAST(floor(0.95 * n) AS BIGINT)) AS p95 FROM o GROUP BY 1")
def _(t):
    d = t("events").withColumn("v", F.round(F.col("value") * 100).cast("bigint"))
    return agg.exact_quantiles(d, "v", {"p50": 0.5, "p95": 0.95}, ["event_type"])


@query("ag12_exact_quantiles_overall", "WITH o AS (SELECT CAST(round(o_totalprice) AS BIGINT) AS v, row_number() OVER (ORDER BY round(o_totalprice)) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT max(v) FILTER (WHERE i = CAST(floor(0.5 * n) AS BIGINT)) AS p50, max(v) FILTER (WHERE i = CAST(floor(0.99 * n) AS BIGINT)) AS p99, max(v) AS p100 FROM o")
def _(t):
    return agg.exact_quantiles(t("orders").withColumn("v", F.round("o_totalprice").cast("bigint")), "v", {"p50": 0.5, "p99": 0.99, "p100": 1.0})


@query("ag13_frames_as_arrays", f"WITH {FRAMES} SELECT frame, array_to_string(list(ent || ':' || team ORDER BY ent), ',') AS ents FROM fr GROUP BY 1")
def _(t):
    f = agg.frames_as_arrays(frames(t), ["frame"], ["ent", "team"])
    return f.select("frame", F.array_join(F.transform("ents", lambda e: F.concat_ws(":", e["ent"].cast("string"), e["team"].cast("string"))), ",").alias("ents"))


@query("ag14_bucket_trend", f"WITH {EVENTS}, b AS (SELECT user_id, t_ms // {5 * DAY} AS b, avg(value) AS v, min(t_ms) AS t0 FROM ev GROUP BY 1, 2) SELECT user_id, count(*) AS buckets, round(arg_max(v, b) - arg_min(v, b), 9) AS delta, min(t0) AS first_t, max(t0) AS last_t FROM b GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return agg.bucket_trend(events(t), ["user_id"], "t_ms", "value", 5 * DAY).select("user_id", "buckets", F.round("delta", 9).alias("delta"), "first_t", "last_t")


CELLS = "cells AS (SELECT user_id, least(greatest(CAST(trunc((k - 50.0::DOUBLE + 52.5) / 105.0 * 21) AS INTEGER), 0), 20) AS cell_x, least(greatest(CAST(trunc((value - 40 + 34.0) / 68.0 * 13) AS INTEGER), 0), 12) AS cell_y, k AS dwell_ms, event_type FROM ev)"


def cells(t):
    return events(t).select("user_id", geo.grid_cell(F.col("k") - F.lit(50.0), 105.0, 21).alias("cell_x"), geo.grid_cell(F.col("value") - 40, 68.0, 13).alias("cell_y"),
                            F.col("k").cast("bigint").alias("dwell_ms"), "event_type")


@query("ag15_heatmap", f"WITH {EVENTS}, {CELLS} SELECT cell_x, cell_y, CAST(sum(dwell_ms) AS BIGINT) AS dwell_ms FROM cells WHERE event_type <> 'error' GROUP BY 1, 2")
def _(t):
    return agg.heatmap(cells(t).filter("event_type <> 'error'"))


@query("ag15_reconcile", f"WITH {EVENTS}, {CELLS} SELECT user_id, CAST(sum(dwell_ms) AS BIGINT) AS active_ms, CAST(sum(CASE WHEN event_type = 'error' THEN dwell_ms ELSE 0 END) AS BIGINT) AS no_cell_ms, CAST(sum(CASE WHEN event_type <> 'error' THEN dwell_ms ELSE 0 END) AS BIGINT) AS dwell_ms, true AS ok FROM cells GROUP BY 1")
def _(t):
    c = cells(t)
    w = c.select("user_id", F.col("dwell_ms").alias("active_ms"), F.when(F.col("event_type") == "error", F.col("dwell_ms")).otherwise(0).alias("no_cell_ms"))
    return agg.reconcile(c.filter("event_type <> 'error'"), w, ["user_id"])


@query("ag16_quality_gaps", f"""WITH {EVENTS}, {PW}, tw AS (SELECT event_type AS team_id, (t_ms // {DAY}) * {DAY} AS t0, count(*) AS n_frames, count(*) FILTER (WHERE k >= 20) AS n_sufficient FROM ev GROUP BY 1, 2)
SELECT 'quarantine' AS kind, event_type AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM ev WHERE k < 5 GROUP BY 2 UNION ALL SELECT 'low_coverage', team_id || ':' || t0, n_sufficient, n_sufficient / n_frames FROM tw WHERE n_sufficient < 0.8 * n_frames
UNION ALL SELECT 'undetected', 'player_time', CAST(sum(active_ms - detected_ms) AS BIGINT), sum(active_ms - detected_ms) / sum(active_ms) FROM pw""")
def _(t):
    e = events(t)
    tw = e.groupBy(F.col("event_type").alias("team_id"), (F.floor(F.col("t_ms") / DAY) * DAY).alias("window_start_ms")).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("k") >= 20).alias("n_sufficient"))
    return quality.quality_gaps(e.filter("k < 5").withColumnRenamed("event_type", "reason"), tw, player_windows(t))


@query("ag18_lineage", "SELECT 'positions' AS table_name, count(*) AS rows, count(*) FILTER (WHERE value > 1) AS valid, CAST(NULL AS BIGINT) AS partitions, CAST(NULL AS BIGINT) AS min_offset, CAST(NULL AS BIGINT) AS max_offset, count(DISTINCT event_id // 1000) AS batches, CAST(NULL AS BIGINT) AS final_rows, '1' AS feature_versions FROM events WHERE event_type = 'view' UNION ALL SELECT 'raw', count(*), NULL, count(DISTINCT user_id % 4), min(event_id), max(event_id), NULL, NULL, NULL FROM events WHERE event_type = 'view'")
def _(t):
    e = t("events").withColumns({"session_id": F.lit("s"), "match_id": F.col("event_type")})
    pos = e.select("session_id", "match_id", (F.col("value") > 1).alias("valid"), F.floor(F.col("event_id") / 1000).alias("batch_id"), F.lit("1").alias("feature_version"))
    raw = e.select("session_id", "match_id", (F.col("user_id") % 4).alias("kafka_partition"), F.col("event_id").alias("kafka_offset"))
    return quality.lineage({"positions": pos, "raw": raw}, "s", "view")


@query("ag20_direction_votes", """WITH fr AS (SELECT day(ts) % 4 AS period, user_id * 100 + day(ts) AS frame, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, value AS x FROM events),
 f AS (SELECT period, frame, count(*) AS n, max(x) AS hi, min(x) AS lo, avg(abs(x - 5.25)) FILTER (WHERE side = 'home') AS hl, avg(abs(x - 5.25)) FILTER (WHERE side = 'away') AS al, avg(abs(x - 88.75)) FILTER (WHERE side = 'home') AS hr, avg(abs(x - 88.75)) FILTER (WHERE side = 'away') AS ar FROM fr GROUP BY 1, 2),
 v AS (SELECT period, (CASE WHEN hi < 47 THEN hl > al WHEN lo > 47 THEN hr > ar END) = (lo > 47) AS plus FROM f WHERE n >= 2 AND (hi < 47 OR lo > 47))
SELECT period, count(*) FILTER (WHERE plus) AS plus, count(*) FILTER (WHERE NOT plus) AS minus, CASE WHEN count(*) FILTER (WHERE plus) >= count(*) FILTER (WHERE NOT plus) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS home_sign FROM v GROUP BY 1""")
def _(t):
    d = t("events").select((F.dayofmonth("ts") % 4).alias("period"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("frame"), F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("side"), F.col("value").alias("x"))
    return agg.direction_votes(d, ["period"], players=2).select("period", "plus", "minus", "home_sign")


@query("ag21_agreement", "SELECT event_type, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 9) AS agreement, count(*) AS checked, CASE WHEN avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 'validated' ELSE 'conflict' END AS status FROM events GROUP BY 1")
def _(t):
    return agg.agreement(t("events"), ["event_type"], F.col("value") > 10, 0.6, strict=False).withColumn("agreement", F.round("agreement", 9))


@query("ag22_infer_keeper", """WITH h AS (SELECT event_type AS side, event_id, user_id % 11 AS label, value / 100 AS x, dense_rank() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events), m AS (SELECT side, label, avg(x) AS mx FROM h WHERE r <= 125 GROUP BY 1, 2)
SELECT side, arg_max(label, abs(mx - 0.5)) AS keeper, CASE WHEN arg_max(mx, abs(mx - 0.5)) < 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM m GROUP BY 1""")
def _(t):
    d = t("events").select(F.col("event_type").alias("side"), "event_id", (F.col("user_id") % 11).alias("label"), (F.col("value") / 100).alias("x"))
    return agg.infer_keeper(d, ["side"], "label", "x", "event_id").select("side", "keeper", "sign")


@query("ag24_kth_mean", f"WITH {FRAMES} SELECT frame, round(list_avg(list_slice(list_sort(list(x)), 1, 4)), 9) AS line FROM fr GROUP BY 1")
def _(t):
    from touchline.operators.ordered import top_k
    least = top_k(frames(t), ["frame"], [F.asc("x"), F.asc("ent")], 4)
    return least.groupBy("frame").agg(F.round(F.avg("x"), 9).alias("line"))


@query("ag26_region_counts", f"WITH {FRAMES} SELECT frame, team, count(*) FILTER (WHERE x - 47 >= 94 * 0.3048::DOUBLE / 2 - 19 * 0.3048::DOUBLE AND abs(y - 25) <= 8 * 0.3048::DOUBLE) AS paint, count(*) FILTER (WHERE x - 47 >= 94 * 0.3048::DOUBLE / 2 - 14 * 0.3048::DOUBLE AND abs(y - 25) >= 22 * 0.3048::DOUBLE) AS corner FROM fr GROUP BY 1, 2")
def _(t):
    d = frames(t).withColumns({"x": F.col("x") - 47, "y": F.col("y") - 25})
    return d.groupBy("frame", "team").agg(F.count_if(geo.in_paint("x", "y")).alias("paint"), F.count_if(geo.in_corner("x", "y")).alias("corner"))


@query("ag27_offense_flag", f"WITH {FRAMES} SELECT frame, team, CASE WHEN frame % 3 = 0 THEN team = 1 ELSE avg(CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END) >= 0.6 END AS offense FROM fr GROUP BY 1, 2")
def _(t):
    poss = F.when(F.col("frame") % 3 == 0, F.col("team") == 1)
    return frames(t).groupBy("frame", "team").agg(F.avg((F.col("x") > 50).cast("double")).alias("s")).select("frame", "team", F.coalesce(poss, F.col("s") >= 0.6).alias("offense"))


PAIRS_IN = [a for a, _ in SOCCER_STATS]


@query("ag28_stat_pairs", f"""WITH m AS (SELECT unnest([{', '.join(str(i) for i in range(len(SOCCER_STATS)))}]) AS p, unnest([{', '.join(repr(a) for a, _ in SOCCER_STATS)}]) AS nm, unnest([{', '.join(repr(b) for _, b in SOCCER_STATS)}]) AS stat),
 s AS (SELECT o_custkey AS game_id, CASE WHEN o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, ([{', '.join(repr(a) for a in PAIRS_IN)}])[o_orderkey % {len(PAIRS_IN)} + 1] AS nm, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS v FROM orders),
 g AS (SELECT game_id, stat, p, max(v) FILTER (WHERE side = 'home') AS h, max(v) FILTER (WHERE side = 'away') AS a, row_number() OVER (PARTITION BY game_id, stat ORDER BY p) AS rn FROM s JOIN m USING (nm) GROUP BY 1, 2, 3)
SELECT game_id, stat, coalesce(h, '0') AS home, coalesce(a, '0') AS away FROM g WHERE rn = 1""")
def _(t):
    k = F.col("o_orderkey")
    d = t("orders").select(F.col("o_custkey").alias("game_id"), F.when(k % 2 == 0, "home").otherwise("away").alias("side"),
                           F.get(F.array(*map(F.lit, PAIRS_IN)), (k % len(PAIRS_IN)).cast("int")).alias("name"), F.lpad(k.cast("string"), 8, "0").alias("value"))
    return agg.stat_pairs(d, SOCCER_STATS)


@query("ag29_catalog_rollup", "SELECT source, count(*) AS assets, CAST(sum(n_chars) AS BIGINT) AS bytes, min(doc_id) AS first_retrieved, max(doc_id) AS last_retrieved, count(*) FILTER (WHERE doc_id % 3 = 0) AS publisher_checksums FROM documents GROUP BY 1")
def _(t):
    d = t("documents", "source", "n_chars", "doc_id").select("source", F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("retrieved_at"), F.when(F.col("doc_id") % 3 == 0, "x").alias("expected_checksum"))
    return agg.catalog_rollup(d)


@query("ag30_play_summary", "SELECT user_id AS play_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 50 END) AS BIGINT) AS score, count(*) AS total_notes, count(*) FILTER (WHERE event_type <> 'error') AS total_hits, count(*) FILTER (WHERE event_type = 'view') AS perfect_hits, max(event_id % 7) AS max_streak, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS accuracy FROM events GROUP BY 1")
def _(t):
    q = F.when(F.col("event_type") == "error", "MISS").when(F.col("event_type") == "view", "PERFECT").otherwise("GOOD")
    d = t("events").select(F.col("user_id").alias("play_id"), q.alias("quality"), F.when(F.col("event_type") == "error", 0).otherwise(50).alias("points"), (F.col("event_id") % 7).alias("streak"))
    return agg.play_summary(d)


@query("ag32_match_quality", """SELECT m.match_id, frames, frames_without_ball, frames_without_entities, round(det, 9) AS detected_fraction, coalesce(u, 0) AS unknown_ids FROM (SELECT event_type AS match_id, count(*) AS frames, count(*) FILTER (WHERE event_id % 7 = 0) AS frames_without_ball, count(*) FILTER (WHERE event_id % 11 = 0) AS frames_without_entities FROM events GROUP BY 1) m
 JOIN (SELECT event_type AS match_id, avg(CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS det FROM events GROUP BY 1) p USING (match_id) LEFT JOIN (SELECT event_type AS match_id, count(DISTINCT user_id) AS u FROM events WHERE user_id % 10 = 3 GROUP BY 1) x USING (match_id)""")
def _(t):
    e = t("events").withColumn("match_id", F.col("event_type"))
    fr = e.select("match_id", (F.col("event_id") % 7 != 0).alias("has_ball"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(22).alias("n_players"))
    pos = e.select("match_id", F.col("user_id").alias("entity_id"), F.lit("player").alias("entity_type"), F.when(F.col("event_id") % 3 != 0, F.col("value") > 10).alias("is_detected"))
    roster = pos.select("match_id", "entity_id").distinct().filter("entity_id % 10 <> 3")
    return agg.match_quality(fr, pos, roster).withColumn("detected_fraction", F.round("detected_fraction", 9))


@query("ag33_presence_span", "SELECT user_id, min(event_id) AS first_frame, max(event_id) AS last_frame FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def _(t):
    d = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("x"), F.col("value").alias("y"))
    return agg.presence_span(d, ["user_id"], "event_id", "x", "y")


# ------------------------------------------------------------------ analyst and serving
@query("cp19_top_players", f"WITH {EVENTS}, {PW} SELECT entity_id, CAST(sum(distance_m) AS DOUBLE) AS value FROM pw WHERE window_start_ms + {DAY} <= 1705500000000 GROUP BY 1 HAVING sum(active_ms) > 0 ORDER BY sum(distance_m) DESC, entity_id LIMIT 5")
def _(t):
    return analyst.top_players(player_windows(t), {"as_of_ms": 1705500000000}, "distance_m", 5).select("entity_id", "value")


@query("cp19_team_shape_trend", f"""WITH {EVENTS}, w AS (SELECT event_type AS team_id, t_ms // 60000 AS m, (t_ms // 60000) * 60000 AS t0, count(*) FILTER (WHERE k > 20) AS ns, avg(value) AS v FROM ev GROUP BY 1, 2), b AS (SELECT team_id, t0 // (45 * 60000) AS b, avg(v) AS v, min(t0) AS t0 FROM w WHERE ns > 0 AND t0 + 60000 <= 1705500000000 GROUP BY 1, 2)
SELECT team_id, round(arg_max(v, b) - arg_min(v, b), 2) AS value, min(t0) AS first_t, max(t0) AS last_t FROM b GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    w = events(t).groupBy(F.col("event_type").alias("team_id"), (F.floor(F.col("t_ms") / 60000) * 60000).alias("window_start_ms")).agg(
        F.count_if(F.col("k") > 20).alias("n_sufficient"), F.avg("value").alias("mean_width_m")).withColumn("window_end_ms", F.col("window_start_ms") + 60000)
    return analyst.team_shape_trend(w, {"as_of_ms": 1705500000000}, "width_m", 45).select("team_id", "value", "first_t", "last_t")


@query("cp20_frames_page", f"WITH {FRAMES}, p AS (SELECT DISTINCT frame FROM fr WHERE frame >= 100 ORDER BY frame LIMIT 300) SELECT frame AS seq, count(*) AS n, min(ent) AS first_ent FROM fr JOIN p USING (frame) GROUP BY 1")
def _(t):
    d = frames(t).select(F.lit("s").alias("session_id"), F.lit("m").alias("match_id"), F.col("frame").alias("seq"), F.col("frame").alias("t_ms"), F.lit(1).alias("period"), F.col("ent").alias("entity_id"),
                         F.lit("player").alias("entity_type"), F.col("team").cast("string").alias("team_id"), F.col("x").alias("x_m"), F.col("y").alias("y_m"), F.lit(True).alias("is_detected"), F.lit(1.0).alias("speed_mps"))
    return serving.frames(d, 100, 300).select("seq", F.size("ents").cast("bigint").alias("n"), F.get("ents", F.lit(0))["entity_id"].alias("first_ent"))


@query("cp20_players_view", f"WITH {EVENTS}, {PW}, {TOTALS} SELECT entity_id, c_name AS name, distance_m, final_windows FROM tot LEFT JOIN customer ON c_custkey = entity_id")
def _(t):
    meta = t("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return serving.players(player_windows(t), meta).select("entity_id", "name", "distance_m", "final_windows")


@query("st17_processing_lag", "WITH l AS (SELECT event_type, o - CAST(floor(value) AS BIGINT) AS lag, row_number() OVER (PARTITION BY event_type ORDER BY o - CAST(floor(value) AS BIGINT)) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT *, 5000 AS o FROM events)) SELECT event_type, max(n) AS frames, max(lag) FILTER (WHERE i = CAST(floor(0.5 * n) AS BIGINT)) AS p50_ms, max(lag) FILTER (WHERE i = CAST(floor(0.95 * n) AS BIGINT)) AS p95_ms FROM l GROUP BY 1")
def _(t):
    ts = F.col("ts").cast("timestamp")
    d = t("events").select("event_type", F.col("event_id").alias("seq"), F.date_trunc("second", ts).alias("p0"), F.floor("value").cast("bigint").alias("v"))
    ms = lambda c: F.timestamp_millis(F.unix_millis("p0") + c)
    d = d.withColumns({"produced_at": ms(F.col("v")), "processed_at": ms(F.lit(5000))})
    return serving.latency(d, ["event_type"]).select("event_type", "frames", "p50_ms", "p95_ms")


@query("cp21_sessions", "SELECT user_id AS session_id, arg_max(event_type, ts) AS match_id, max(ts) AS updated_at FROM events GROUP BY 1 ORDER BY updated_at DESC, session_id LIMIT 50")
def _(t):
    d = t("events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("match_id"), F.col("ts").alias("updated_at"))
    return serving.sessions(d)


@query("cp26_catalog", "SELECT doc_id AS match_id, source, lang AS license, quality FROM documents d JOIN (SELECT DISTINCT source AS s, min(lang) OVER (PARTITION BY source) AS l FROM documents) x ON x.s = d.source LEFT JOIN labels USING (doc_id) WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 0)")
def _(t):
    docs = t("documents", "doc_id", "source", "lang")
    lic = docs.groupBy("source").agg((F.min("doc_id") % 2 == 0).alias("redistributable"))
    d = serving.catalog(docs.withColumnRenamed("doc_id", "match_id"), lic, t("labels").withColumnRenamed("doc_id", "match_id"), public=True)
    return d.select("match_id", "source", F.col("lang").alias("license"), "quality")


@query("sk10_sink_ledger", "SELECT event_type AS query_name, count(DISTINCT event_id // 100) AS batches, max(ts) AS last_commit, round(avg(k), 9) AS avg_ms, CAST(sum(user_id) AS BIGINT) AS rows FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1")
def _(t):
    d = events(t).select(F.col("event_type").alias("query_name"), F.floor(F.col("event_id") / 100).alias("batch_id"), F.col("ts").cast("timestamp_ntz").alias("committed_at"), F.col("k").alias("duration_ms"), F.col("user_id").alias("rows"))
    return serving.sinks(d).withColumn("avg_ms", F.round("avg_ms", 9))
