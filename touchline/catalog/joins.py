"""Joins, sets, sorts and reshaping on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import DAY, EVENTS, HOUR, events, query
from touchline.functions import geometry as geo
from touchline.functions.music import band_tags
from touchline.operators import aggregates as agg
from touchline.operators import joins, ordered, reshape, sets
from touchline.operators.windows import top_n, with_page
from touchline.sinks.tables import latest_version, merge_insert_only, upsert


# ------------------------------------------------------------------ joins
@query("jn01_merge_advanced", """WITH adv AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber) AS rn FROM lineitem)
SELECT o_orderkey, o_custkey, l_extendedprice, l_partkey FROM orders LEFT JOIN adv ON l_orderkey = o_orderkey AND rn = 1""")
def _(t):
    adv = t("lineitem", "l_orderkey", "l_extendedprice", "l_partkey", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.merge_advanced(t("orders", "o_orderkey", "o_custkey"), adv, ["o_orderkey"], ["l_extendedprice", "l_partkey", "l_linenumber"]).drop("l_linenumber")


@query("jn02_normalized_name_join", """WITH r AS (SELECT lower(replace(c_name, '#', '')) AS nm, c_nationkey AS nk, max(c_acctbal) AS salary FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2)
SELECT c_custkey, salary FROM customer LEFT JOIN r ON nm = lower(replace(c_name, '#', '')) AND nk = c_nationkey""")
def _(t):
    from touchline.functions.identity import normalize_name
    r = t("customer").filter("c_custkey % 2 = 0").groupBy(normalize_name("c_name").alias("nm"), F.col("c_nationkey").alias("nk")).agg(F.max("c_acctbal").alias("salary"))
    d = t("customer", "c_custkey", "c_name", "c_nationkey").withColumn("_n", normalize_name(F.upper("c_name")))
    return joins.join_by_normalized(d, r, {"nm": F.col("_n"), "nk": F.col("c_nationkey")}, ["salary"]).select("c_custkey", "salary")


@query("jn03_expand_validity", """SELECT o_orderkey, CAST(m AS INTEGER) AS step FROM orders, unnest(range(greatest(o_orderkey % 10, 3), least(o_orderkey % 10 + o_orderkey % 4, 11) + 1)) AS u(m)""")
def _(t):
    d = t("orders", "o_orderkey").withColumns({"a": F.col("o_orderkey") % 10, "b": F.col("o_orderkey") % 10 + F.col("o_orderkey") % 4})
    return joins.expand_validity(d, "a", "b", "step", 3, 11).select("o_orderkey", "step")


@query("jn04_band_tags", """WITH bands AS (SELECT unnest([0,1,2,3,4,5,6]) AS i, unnest([90,110,120,125,130,140,150]) AS lo, unnest([110,125,130,135,145,155,180]) AS hi, unnest(['downtempo','deep house','house','tech house','techno','trance','drum and bass']) AS g)
SELECT p_partkey, coalesce(string_agg(g, ',' ORDER BY i) FILTER (WHERE g IS NOT NULL), '') AS tags FROM part LEFT JOIN bands ON p_size * 2 + 85 >= lo AND p_size * 2 + 85 < hi GROUP BY 1""")
def _(t):
    return t("part", "p_partkey", "p_size").select("p_partkey", F.array_join(band_tags(F.col("p_size") * 2 + 85), ",").alias("tags"))


@query("jn05_nearest_join", f"""WITH {EVENTS}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'view'),
 c AS (SELECT l.event_id, r.event_id AS near_id, r.k AS near_k, abs(l.t_ms - r.t_ms) AS dist, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t_ms - r.t_ms), r.event_id) AS rn FROM l JOIN r ON l.user_id = r.user_id WHERE abs(l.t_ms - r.t_ms) <= {12 * HOUR})
SELECT l.event_id, near_id, near_k, dist FROM l LEFT JOIN c ON c.event_id = l.event_id AND rn = 1""")
def _(t):
    e = events(t)
    r = e.filter("event_type = 'view'").select("user_id", "t_ms", F.col("event_id").alias("near_id"), F.col("k").alias("near_k"))
    d = joins.nearest_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "t_ms"), r, ["user_id"], "t_ms", "t_ms", ["near_id", "near_k"], 12 * HOUR, "near_id", DAY)
    return d.select("event_id", F.col("matched.near_id").alias("near_id"), F.col("matched.near_k").alias("near_k"), F.col("distance").alias("dist"))


@query("jn06_asof_on_running_clock", f"""WITH {EVENTS}, f AS (SELECT user_id, t_ms, k, max(k) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS clock FROM ev WHERE event_type <> 'error'),
 e AS (SELECT event_id, user_id, k AS mel FROM ev WHERE event_type = 'error'), last AS (SELECT user_id, max(t_ms) AS last_t FROM f GROUP BY 1),
 j AS (SELECT e.event_id, e.mel, (SELECT min(f.t_ms) FROM f WHERE f.user_id = e.user_id AND f.clock >= e.mel) AS hit_t, last_t, e.user_id FROM e JOIN last USING (user_id))
SELECT event_id, coalesce(hit_t, last_t) AS t_ms, coalesce((SELECT f.clock - j.mel BETWEEN 0 AND 5 FROM f WHERE f.user_id = j.user_id AND f.t_ms = j.hit_t), false) AS tracked FROM j""")
def _(t):
    e = events(t)
    frames = e.filter("event_type <> 'error'").select("user_id", F.col("k").alias("mel_ms"), F.col("t_ms").alias("frame_t"))
    ev = e.filter("event_type = 'error'").select("event_id", "user_id", F.col("k").alias("mel_ms"))
    d = joins.place_on_frames(ev, frames, ["user_id"], "mel_ms", "mel_ms", "frame_t", tracked_within=5, width=DAY)
    return d.select("event_id", "t_ms", "tracked")


@query("jn07_asof_backward", f"""WITH {EVENTS} SELECT l.event_id, r.event_id AS prev_id, r.value AS prev_value FROM (SELECT * FROM ev WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.t_ms >= r.t_ms""")
def _(t):
    e = events(t)
    r = e.filter("event_type = 'view'").select("user_id", "t_ms", F.col("event_id").alias("prev_id"), F.col("value").alias("prev_value"))
    d = joins.asof_backward(e.filter("event_type = 'click'").select("event_id", "user_id", "t_ms"), r, ["user_id"], "t_ms", "t_ms", ["prev_id", "prev_value"], "prev_id", DAY)
    return d.select("event_id", F.col("matched.prev_id").alias("prev_id"), F.col("matched.prev_value").alias("prev_value"))


@query("jn07_asof_backward_split_keys", f"""WITH {EVENTS} SELECT l.event_id, r.event_id AS prev_id FROM (SELECT * FROM ev WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') r ON l.t_ms >= r.t_ms""")
def _(t):
    """One key for all rows: the timeline is chunked by day, as for a key that is too large for a task."""
    e = events(t).withColumn("all", F.lit(1))
    r = e.filter("event_type = 'view'").select("all", "t_ms", F.col("event_id").alias("prev_id"))
    d = joins.asof_backward(e.filter("event_type = 'click'").select("event_id", "all", "t_ms"), r, ["all"], "t_ms", "t_ms", ["prev_id"], "prev_id", DAY, hot_rows=0)
    return d.select("event_id", F.col("matched.prev_id").alias("prev_id"))


@query("jn08_frame_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    look = t("orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey")
    return t("lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(look, "l_orderkey", "left").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("jn09_attack_normalize", f"""WITH {EVENTS}, d AS (SELECT DISTINCT day(ts) % 2 AS period, user_id % 4 AS team, CASE WHEN (day(ts) % 2 = 0) = (user_id % 4 IN (0, 1)) THEN 1.0 ELSE -1.0 END AS sign FROM ev WHERE user_id % 4 <> 3)
SELECT event_id, round(value * sign, 6) AS x_att, round(k * sign, 6) AS y_att FROM ev LEFT JOIN d ON d.team = CASE WHEN event_type = 'error' THEN k % 4 ELSE user_id % 4 END AND d.period = day(ts) % 2""")
def _(t):
    e = events(t).select("event_id", F.when(F.col("event_type") == "error", "ball").otherwise("player").alias("entity_type"), (F.dayofmonth("ts") % 2).alias("period"),
                         (F.col("user_id") % 4).alias("team_id"), (F.col("k") % 4).cast("bigint").alias("possession_team_id"), F.col("value").alias("x_m"), F.col("k").alias("y_m"))
    s = events(t).select((F.dayofmonth("ts") % 2).alias("period"), (F.col("user_id") % 4).alias("team_id")).filter("team_id <> 3").distinct()
    s = s.withColumn("sign", F.when((F.col("period") == 0) == F.col("team_id").isin(0, 1), 1.0).otherwise(-1.0))
    d = joins.attack_normalize(e, s, by=("period",))
    return d.select("event_id", F.round("x_att", 6).alias("x_att"), F.round("y_att", 6).alias("y_att"))


@query("jn10_new_only", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    idx = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.new_only(t("customer", "c_custkey", "c_name"), idx, "c_custkey")


@query("jn11_parity", """WITH b AS (SELECT o_orderkey, o_totalprice AS m, o_custkey AS q FROM orders WHERE o_orderkey % 10 <> 1), s AS (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 7 = 0 THEN 1.01::DOUBLE ELSE 1.00000001::DOUBLE END AS m, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS q FROM orders WHERE o_orderkey % 10 <> 2)
SELECT count(b.o_orderkey) AS batch_rows, count(s.o_orderkey) AS stream_rows, count(*) FILTER (WHERE s.o_orderkey IS NULL) AS only_batch, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS only_stream,
 count(*) FILTER (WHERE b.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND NOT abs(b.m - s.m) <= 0.001 + 0.0001 * abs(s.m)) AS diff_m, count(*) FILTER (WHERE b.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL AND s.q IS NULL) AS diff_q
FROM b FULL OUTER JOIN s ON b.o_orderkey = s.o_orderkey""")
def _(t):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("m"), F.col("o_custkey").alias("q"))
    n = F.col("o_orderkey")
    s = o.filter(n % 10 != 2).withColumns({"m": F.col("m") * F.when(n % 7 == 0, 1.01).otherwise(1.00000001), "q": F.when(n % 5 != 0, F.col("q"))})
    return joins.parity(o.filter(n % 10 != 1), s, ["o_orderkey"], ["m", "q"])


@query("jn12_pair_key_join", """WITH a AS (SELECT n_nationkey AS g, n_name AS h, 'NATION_' || (n_nationkey + 3) % 25 AS w FROM nation), b AS (SELECT n_nationkey AS e, 'NATION_' || (n_nationkey + 3) % 25 AS x, n_name AS y FROM nation WHERE n_nationkey % 4 <> 0)
SELECT g, e FROM a JOIN b ON least(h, w) = least(x, y) AND greatest(h, w) = greatest(x, y)""")
def _(t):
    other = F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 3) % 25).cast("string"))
    a = t("nation").select(F.col("n_nationkey").alias("g"), F.col("n_name").alias("h"), other.alias("w"))
    b = t("nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("e"), other.alias("x"), F.col("n_name").alias("y"))
    return joins.pair_key_join(a, b, "h", "w", "x", "y").select("g", "e")


FRAMES = "fr AS (SELECT o_custkey AS frame, o_orderkey AS ent, (o_totalprice / 5000) AS x, (o_orderkey % 50)::DOUBLE AS y, o_orderkey % 2 AS team FROM orders)"


def frames(t):
    """Orders of a customer as the entities of a frame."""
    return t("orders").select(F.col("o_custkey").alias("frame"), F.col("o_orderkey").alias("ent"), (F.col("o_totalprice") / 5000).alias("x"),
                           (F.col("o_orderkey") % 50).cast("double").alias("y"), (F.col("o_orderkey") % 2).alias("team"))


@query("sk09_overfull_frames", "SELECT o_custkey AS frame, count(*) AS entities, 'too_many_entities' AS reason FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(t):
    return agg.overfull_frames(frames(t), ["frame"], 15)


@query("jn13_mean_pairwise", f"""WITH {FRAMES}, p AS (SELECT a.frame, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m, min(sqrt((a.x - 50) ** 2 + (a.y - 25) ** 2)) AS n FROM fr a JOIN fr b ON a.frame = b.frame AND a.ent <> b.ent GROUP BY 1)
SELECT frame, round(m, 6) AS mean_pairwise, round(n, 6) AS nearest_to_ball FROM p""")
def _(t):
    f = agg.frames_as_arrays(frames(t), ["frame"], ["x", "y"], "pts").filter(F.size("pts") >= 2)
    return f.select("frame", F.round(geo.mean_pairwise("pts"), 6).alias("mean_pairwise"), F.round(geo.nearest("pts", F.lit(50.0), F.lit(25.0)), 6).alias("nearest_to_ball"))


@query("jn14_nearest_per_cell", f"""WITH {FRAMES}, g AS (SELECT x AS cx, y AS cy FROM range(10) t1(x), range(7) t2(y)), big AS (SELECT frame FROM fr GROUP BY 1 HAVING count(*) > 3),
 d AS (SELECT fr.frame, cx, cy, team, row_number() OVER (PARTITION BY fr.frame, cx, cy ORDER BY ((x - 52.5) - (-52.5 + (cx + 0.5) * 10.5)) ** 2 + ((y - 34.0) - (-34.0 + (cy + 0.5) * 10.5)) ** 2, ent) AS rn FROM fr JOIN big USING (frame), g)
SELECT frame, team, count(*) AS cells FROM d WHERE rn = 1 GROUP BY 1, 2""")
def _(t):
    from touchline.operators.tracking import SOCCER, nearest_per_cell
    p = frames(t).select("frame", F.lit("player").alias("entity_type"), F.col("ent").alias("entity_id"), F.col("team").alias("team_id"),
                         (F.col("x") - 52.5).alias("x_m"), (F.col("y") - 34.0).alias("y_m"))
    return nearest_per_cell(p, SOCCER, 10.5, ["frame"]).groupBy("frame", F.col("team_id").alias("team")).agg(F.count(F.lit(1)).alias("cells"))


@query("jn15_hit_match", f"""WITH {EVENTS}, n AS (SELECT event_id AS note_id, user_id % 5 AS lane, t_ms AS time_ms FROM ev WHERE event_type = 'view'), p AS (SELECT user_id % 3 AS play_id, user_id % 5 AS lane, t_ms FROM ev WHERE event_type = 'click'), plays AS (SELECT DISTINCT play_id FROM p),
 c AS (SELECT n.note_id, plays.play_id, n.time_ms, (SELECT min(p.t_ms) FROM p WHERE p.play_id = plays.play_id AND p.lane = n.lane AND p.t_ms >= n.time_ms - 600000) AS press FROM n, plays)
SELECT play_id, note_id, CASE WHEN abs(press - time_ms) <= 300000 THEN 'PERFECT' WHEN abs(press - time_ms) <= 600000 THEN 'GOOD' ELSE 'MISS' END AS quality FROM c""")
def _(t):
    e = events(t).withColumns({"lane": F.col("user_id") % 5, "song_id": F.lit("s")})
    n = e.filter("event_type = 'view'").select("song_id", F.col("event_id").alias("note_id"), "lane", F.col("t_ms").alias("time_ms"))
    p = e.filter("event_type = 'click'").select((F.col("user_id") % 3).alias("play_id"), "song_id", "lane", F.col("t_ms").alias("time_ms"))
    return joins.hit_match(n, p, 300_000, 600_000).select("play_id", "note_id", F.coalesce("quality", F.lit("MISS")).alias("quality"))


@query("jn16_decorate", "SELECT user_id, count(*) AS n, any_value(c_name) AS name FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1")
def _(t):
    g = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.join(t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), "user_id", "left")


# ------------------------------------------------------------------ reshaping and filters
@query("pr01_resolve_columns", "SELECT c_custkey AS player_id, c_name AS player_name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS height, CAST(NULL AS DOUBLE) AS weight FROM customer")
def _(t):
    return reshape.resolve_columns(t("customer"), {"player_id": {"names": ["PLAYER_ID", "C_CUSTKEY"]}, "player_name": {"names": ["player", "c_name"]},
                                                   "segment": {"names": [], "contains": ["segment"]}, "height": {}, "weight": {"type": "double"}})


@query("pr03_cast_void", "SELECT r_regionkey, CAST(NULL AS VARCHAR) AS nothing FROM region")
def _(t):
    return reshape.cast_void(t("region").select("r_regionkey", F.lit(None).alias("nothing")))


@query("pr06_unpivot_tracking", "SELECT p_partkey, 'Ball' AS label, p_size * 1.0::DOUBLE AS x, p_retailprice AS y, 0 AS entity_order FROM part UNION ALL SELECT p_partkey, 'Player1', p_size / 50.0::DOUBLE, 0.5::DOUBLE, 1 FROM part WHERE p_size > 10")
def _(t):
    w = t("part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size") / 50.0).alias("Player1_x"), F.lit(0.5).alias("Player1_y"),
                         (F.col("p_size") * 1.0).alias("Ball_x"), F.col("p_retailprice").alias("Ball_y"))
    return reshape.unpivot_tracking(w, ["p_partkey"], ["Player1", "Ball"])


@query("pr07_melt", "SELECT o_orderkey, unnest(['price', 'key']) AS component, unnest([o_totalprice, o_custkey::DOUBLE]) AS value FROM orders")
def _(t):
    d = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("key"))
    return reshape.melt(d, ["o_orderkey"], ["price", "key"])


@query("pr08_pivot_team_seconds", f"""WITH {EVENTS} SELECT t_ms // {HOUR} AS sec, round(avg(value) FILTER (WHERE event_type = 'view'), 8) AS view_value, round(avg(k) FILTER (WHERE event_type = 'view'), 8) AS view_k, round(avg(value) FILTER (WHERE event_type = 'click'), 8) AS click_value, round(avg(k) FILTER (WHERE event_type = 'click'), 8) AS click_k FROM ev GROUP BY 1""")
def _(t):
    d = events(t).withColumn("sec", F.floor(F.col("t_ms") / HOUR))
    p = reshape.pivot_team_seconds(d, ["sec"], "event_type", ["view", "click"], ["value", "k"])
    return p.select("sec", *[F.round(c, 8).alias(c) for c in p.columns if c != "sec"])


SNAP = """SELECT o_custkey, list({'type': CASE o_orderstatus WHEN 'P' THEN 'substitution' ELSE 'goal' END, 'minute': (o_orderkey % 90)::INTEGER, 'who': o_orderpriority} ORDER BY o_orderkey) AS ev FROM orders GROUP BY 1"""


@query("pr09_explode_and_route_events", """SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'substitution' ELSE 'goal' END AS event_type, CAST(o_orderkey % 90 AS INTEGER) AS minute, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS player_name,
 CASE WHEN o_orderstatus = 'P' THEN 'in ' || o_orderkey END AS player_in, CASE WHEN o_orderstatus = 'P' THEN 'out ' || o_orderkey END AS player_out, 'team' AS team FROM orders""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    e = F.struct(F.when(F.col("o_orderstatus") == "P", "substitution").otherwise("goal").alias("type"), (F.col("o_orderkey") % 90).cast("int").alias("minute"),
                 F.col("o_orderpriority").alias("player"), F.concat(F.lit("in "), k).alias("playerIn"), F.concat(F.lit("out "), k).alias("playerOut"), F.lit("team").alias("team"))
    # an order carries its own short event list; one list per customer could grow without bound
    d = t("orders").select("o_custkey", F.array(e).alias("evs")).unionByName(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.array().cast(
        "array<struct<type:string,minute:int,player:string,playerIn:string,playerOut:string,team:string>>").alias("evs")))
    return reshape.event_columns(reshape.explode_nonempty(d, "evs", "e", ["o_custkey"]))


@query("pr15_every_nth", "SELECT event_id, value FROM events WHERE event_id % 10 = 0")
def _(t):
    return reshape.every_nth(t("events", "event_id", "value"), "event_id", 10)


@query("pr16_validation_rules", f"WITH {EVENTS} SELECT event_id, CASE WHEN k IS NULL THEN 'no_k' WHEN k < 10 THEN 'small_k' WHEN value > 50 THEN 'large_value' WHEN event_type = 'error' THEN 'error_type' END AS invalid_reason FROM ev")
def _(t):
    rules = [("no_k", F.col("k").isNull()), ("small_k", F.col("k") < 10), ("large_value", F.col("value") > 50), ("error_type", F.col("event_type") == "error")]
    return events(t).select("event_id", reshape.first_failing(rules).alias("invalid_reason"))


@query("pr17_attribute_by_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 's' || user_id ELSE 'own' END AS session_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE 'mine' END AS match_id, event_id % 3 = 1 AS attributed_by_key FROM events")
def _(t):
    n = F.col("event_id") % 3
    d = t("events").withColumns({"key": F.when(n == 0, "plain").otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("|"), F.col("event_type"))),
                                 "s0": F.when(n == 2, "own"), "m0": F.when(n == 2, "mine")})
    return reshape.attribute_by_key(d, "key", "session_id", "match_id", "s0", "m0").select("event_id", "session_id", "match_id", "attributed_by_key")


@query("pr18_scoped", f"WITH {EVENTS} SELECT event_id FROM ev WHERE event_type = 'view' AND t_ms <= 1705000000000")
def _(t):
    return reshape.scoped(events(t), {"event_type": "view", "user_id": None}, 1705000000000, "t_ms", {"event_type": ["view", "click"]}).select("event_id")


@query("pr19_cursor_cutoff", f"WITH {EVENTS}, c AS (SELECT user_id, least(max(t_ms), 1705000000000) AS cut FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id FROM ev JOIN c USING (user_id) WHERE t_ms <= cut")
def _(t):
    e = events(t)
    cur = e.filter("event_type = 'purchase'").select("user_id", F.col("t_ms").alias("cursor_t"))
    return reshape.cursor_cutoff(e, cur, ["user_id"], "t_ms", "cursor_t", 1705000000000).select("event_id")


@query("pr20_redistributable_only", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t):
    reg = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 1).alias("redistributable"))
    return reshape.redistributable_only(t("customer", "c_custkey", "c_nationkey"), reg, "c_nationkey").select("c_custkey")


# ------------------------------------------------------------------ sets and sorts
@query("se01_union_sources", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    return sets.union_sources([t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), t("supplier").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("k"))])


@query("se02_union_drift", "SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS nm FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def _(t):
    return sets.union_drift([t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg")),
                             t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_name").alias("nm"))])


@query("se04_diff_keys", "SELECT k, CASE WHEN a THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT k, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT o_custkey AS k, true AS a, false AS b FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, false, true FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000) GROUP BY 1) WHERE a <> b")
def _(t):
    o = t("orders")
    return sets.diff_keys(o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), o.filter("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.col("o_custkey").alias("k")), ["k"])


@query("se05_dedup_tags", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = lower(p_type) THEN lower(p_type) || ',x' ELSE split_part(p_name, ' ', 1) || ',x,' || lower(p_type) END AS tags FROM part")
def _(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return t("part").select("p_partkey", F.array_join(sets.dedup_tags(F.array(first, F.lit("x"), F.lower("p_type"), first, F.lit("x"))), ",").alias("tags"))


@query("so01_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return top_n(t("orders", "o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@query("so02_page", "SELECT event_id, user_id FROM events WHERE event_id >= 5000 ORDER BY event_id LIMIT 300")
def _(t):
    return with_page(t("events", "event_id", "user_id"), "event_id", 5000, 300, ["event_id"])


@query("so03_canonical_order", "SELECT event_id, event_type, user_id FROM events ORDER BY event_type <> 'error', event_type, user_id, event_id")
def _(t):
    return t("events", "event_id", "event_type", "user_id").orderBy((F.col("event_type") != "error"), "event_type", "user_id", "event_id")


@query("so05_timeline", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def _(t):
    return t("events", "event_id", "ts").orderBy("ts", "event_id")


# ------------------------------------------------------------------ table maintenance as plans
@query("sk05_merge_insert_only", """WITH new AS (SELECT o_custkey AS game, o_orderstatus AS kind, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 3)::INTEGER END AS minute, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS team FROM orders),
 old AS (SELECT * FROM new WHERE game % 5 = 0), k AS (SELECT DISTINCT game, kind, minute, team FROM new WHERE team IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old WHERE old.game = new.game AND old.kind = new.kind AND coalesce(old.minute, -1) = coalesce(new.minute, -1) AND old.team = new.team))
SELECT * FROM k UNION ALL SELECT * FROM new WHERE team IS NULL""")
def _(t):
    n = t("orders").select(F.col("o_custkey").alias("game"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 3).cast("int")).alias("minute"),
                           F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("team"))
    return merge_insert_only(n, n.filter("game % 5 = 0"), ["game", "kind", "minute", "team"], {"minute": -1})


@query("sk06_upsert", """WITH a AS (SELECT o_custkey, o_orderkey AS ver, o_totalprice AS v, 1 AS new FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey + 3000, o_totalprice, 0 FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, arg_max(ver, ver * 2 + new) AS ver, arg_max(v, ver * 2 + new) AS v FROM a GROUP BY 1""")
def _(t):
    o = t("orders").select("o_custkey", F.col("o_orderkey").alias("ver"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    old = o.filter("o_orderstatus = 'O'").withColumn("ver", F.col("ver") + 3000).drop("o_orderstatus")
    return upsert(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), old, ["o_custkey"], "ver")


@query("sk07_conform", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST(NULL AS DOUBLE) AS rating, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def _(t):
    from pyspark.sql import types as T
    return reshape.conform(t("supplier"), T.StructType([T.StructField("s_suppkey", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("s_nationkey", T.LongType())]))


@query("wi08_latest_version", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(t):
    return latest_version(t("events", "user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("ag06_dedup", "SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def _(t):
    return ordered.first_by(t("lineitem", "l_orderkey", "l_partkey", "l_extendedprice"), ["l_orderkey"], ["l_extendedprice", "l_partkey"])
