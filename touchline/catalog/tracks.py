"""Track tags and texts, vector search, moments, change points, sections."""
from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import DAY, EVENTS, HOUR, events, query
from touchline.functions import identity, music
from touchline.functions.music import TEMPO_BANDS
from touchline.operators import changes, moments, sections, vectors
from touchline.plans import tracks

# ------------------------------------------------------------------ tags and texts
TRK = """trk AS (SELECT p_partkey, p_name AS title, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS artist, p_size * 2 + 85.5::DOUBLE AS bpm, (p_partkey % 50) * 80.0::DOUBLE AS centroid, (p_size % 12) / 100.0::DOUBLE AS energy,
 (p_size % 9) / 100.0::DOUBLE AS estd, (p_size % 10) * 0.9::DOUBLE AS onset, 180 + p_size * 3.3::DOUBLE AS dur, p_size % 3 AS kind, 20 + p_size * 1.0::DOUBLE AS cut FROM part)"""


def part_tracks(t):
    s = F.col("p_size")
    cut = 20 + s * F.lit(1.0)
    sec = lambda label, a, b, lv: F.struct(F.lit(label).alias("label"), a.alias("start_sec"), b.alias("end_sec"), F.lit(lv).alias("energy_level"))
    secs = (F.when(s % 3 == 0, F.array(sec("intro", F.lit(0.0), cut, "low"), sec("drop", cut, F.lit(150.0), "high")))
            .when(s % 3 == 1, F.array(sec("breakdown", F.lit(0.0), cut, "medium")))
            .otherwise(F.array().cast("array<struct<label:string,start_sec:double,end_sec:double,energy_level:string>>")))
    feats = F.struct((s * 2 + F.lit(85.5)).alias("tempo_bpm"), ((F.col("p_partkey") % 50) * 80.0).alias("spectral_centroid_mean"), ((s % 12) / 100.0).alias("energy_mean"),
                     ((s % 9) / 100.0).alias("energy_std"), ((s % 10) * 0.9).alias("onset_rate"), (180 + s * 3.3).alias("duration_seconds"))
    return t("part").select("p_partkey", F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("youtube_id"), F.col("p_name").alias("title"),
                            F.when(s % 4 != 0, F.col("p_brand")).alias("artist"), feats.alias("features"), secs.alias("sections"))


GENRE = ("list_distinct_keep([" + ", ".join(f"CASE WHEN bpm >= {a} AND bpm < {b} THEN '{g}' END" for a, b, g in TEMPO_BANDS) +
         ", CASE WHEN centroid < 1500 THEN 'dark' WHEN centroid > 3000 THEN 'bright' END, CASE WHEN estd > 0.05 THEN 'dynamic' ELSE 'hypnotic' END, CASE WHEN onset > 6 THEN 'percussive' WHEN onset < 2 THEN 'minimal' END])")
MOOD = ("list_distinct_keep([CASE WHEN centroid < 1500 THEN 'dark' WHEN centroid > 3000 THEN 'bright' ELSE 'balanced' END, CASE WHEN centroid < 1500 THEN 'atmospheric' WHEN centroid > 3000 THEN 'energetic' END, "
        "CASE WHEN energy > 0.08 THEN 'driving' WHEN energy < 0.03 THEN 'subtle' END, CASE WHEN estd < 0.03 THEN 'hypnotic' ELSE 'dynamic' END, CASE WHEN kind = 0 AND cut >= 45 THEN 'long-intro' END, CASE WHEN kind = 0 THEN 'peak-time' END, "
        "CASE WHEN kind = 1 THEN 'breakdowns' END, CASE WHEN onset > 6 THEN 'percussive' WHEN onset < 2 THEN 'minimal' END])")


def _keep(sql):
    """No two entries of these lists can be equal except by repeat of the same word; order of first occurrence."""
    inner = sql[len("list_distinct_keep("):-1]
    a = f"list_filter({inner}, lambda x: x IS NOT NULL)"
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


GENRE, MOOD = _keep(GENRE), _keep(MOOD)


@query("fn37_tags", f"WITH {TRK} SELECT p_partkey, array_to_string({GENRE}, ',') AS genre, array_to_string({MOOD}, ',') AS mood FROM trk")
def _(t):
    d = tracks.describe(part_tracks(t))
    return d.select("p_partkey", F.array_join("genre_tags", ",").alias("genre"), F.array_join("mood_tags", ",").alias("mood"))


STRUCT = "CASE kind WHEN 0 THEN 'intro (low, ' || CAST(round(cut) AS BIGINT) || 's), drop (high, ' || CAST(round(150 - cut) AS BIGINT) || 's)' WHEN 1 THEN 'breakdown (medium, ' || CAST(round(cut) AS BIGINT) || 's)' ELSE 'unstructured' END"


@query("fn38_search_text", f"""WITH {TRK}, g AS (SELECT *, array_to_string({GENRE}, ', ') AS genre, array_to_string({MOOD}, ', ') AS mood, CAST(round_even(bpm, 0) AS BIGINT) AS b, CAST(round_even(dur, 0) AS BIGINT) AS s FROM trk)
SELECT p_partkey, title || ': ' || genre || ' track at ' || b || ' BPM with ' || CASE WHEN energy > 0.08 THEN 'high energy' WHEN energy < 0.03 THEN 'low energy' ELSE 'moderate energy' END || ' and ' ||
 CASE WHEN centroid < 1500 THEN 'dark, low spectral energy' WHEN centroid > 3000 THEN 'bright, high spectral energy' ELSE 'mid-range spectral balance' END || '. Rhythm is ' || CASE WHEN onset > 6 THEN 'percussive, high onset density' WHEN onset < 2 THEN 'sparse, minimal rhythm' ELSE 'steady rhythmic pulse' END ||
 '. Duration ' || s || ' seconds. Structure: ' || {STRUCT} || '. Mood: ' || mood || '. Electronic dance music suitable for DJ sets.' AS search_text,
 '"' || title || '" by ' || coalesce(artist, 'Unknown') || ' is a ' || b || ' BPM ' || genre || ' track (' || s || 's) with a ' || mood || ' character.' || CASE WHEN kind = 0 AND cut >= 20 THEN ' It opens with a ' || CAST(round(cut) AS BIGINT) || 's intro,' ELSE '' END ||
 ' Energy flow: ' || CASE kind WHEN 0 THEN 'intro → drop' WHEN 1 THEN 'breakdown' ELSE 'flat' END || '. Use it where ' || genre || ' and ' || mood || ' vibes fit the set.' AS summary FROM g""")
def _(t):
    return tracks.describe(part_tracks(t)).select("p_partkey", "search_text", "summary")


@query("fn39_explain", f"""WITH {TRK} SELECT p_partkey, CASE WHEN abs(bpm - 120) <= 3 THEN 'near-identical tempo (' || CAST(round_even(bpm, 0) AS BIGINT) || ' BPM)' WHEN abs(bpm - 120) <= 8 THEN 'close tempo (' || CAST(round_even(bpm, 0) AS BIGINT) || ' vs 120 BPM)'
  ELSE 'tempo offset ' || CASE WHEN bpm >= 120 THEN '+' ELSE '' END || CAST(round_even(bpm - 120, 0) AS BIGINT) || ' BPM' END || '; ' || CASE WHEN abs(energy - 0.055) < 0.02 THEN 'similar energy' WHEN energy > 0.055 THEN 'higher energy' ELSE 'lower energy' END || '; ' ||
  CASE WHEN abs(centroid - 2001) < 400 THEN 'similar brightness' WHEN centroid < 2001 THEN 'darker tone' ELSE 'brighter tone' END AS why FROM trk""")
def _(t):
    f = lambda n: F.col(f"features.{n}")
    return part_tracks(t).select("p_partkey", music.explain_delta(f("tempo_bpm"), F.lit(120.0), f("energy_mean"), F.lit(0.055), f("spectral_centroid_mean"), F.lit(2001.0)).alias("why"))


@query("cp22_track_index", f"WITH {TRK}, h AS (SELECT *, sha256('v' || p_partkey) AS h FROM trk) SELECT p_partkey, (CAST(('0x' || substr(h, 1, 1)) AS BIGINT) % 8) * 1152921504606846976 + CAST(('0x' || substr(h, 2, 15)) AS BIGINT) AS point_id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS analyzed_at FROM h")
def _(t):
    p = part_tracks(t)
    old = tracks.describe(p.withColumn("analyzed_at", F.lit(1)))
    return tracks.index(p.filter("p_partkey % 3 = 0").withColumn("analyzed_at", F.lit(2)), old).select("p_partkey", "point_id", "analyzed_at")


# ------------------------------------------------------------------ vectors
VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 7)"


def vecs(t):
    return t("embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("audio"), F.reverse("embedding").alias("text_vec"), "label")


@query("ve01_vector_topk", f"WITH {VEC} SELECT vec_id AS track_id, round(list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe)), 9) AS score FROM v, q WHERE list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe)) >= 0.05 ORDER BY score DESC, track_id LIMIT 20")
def _(t):
    q = vectors.vector_of(t("embeddings"), "vec_id", 7, "embedding")
    return vectors.vector_topk(vecs(t), q, "audio", 20, 0.05).select("track_id", F.round("score", 9).alias("score"))


KNN = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query("ve02_knn_join", f"WITH {VEC}, d AS (SELECT a.vec_id AS qid, b.vec_id AS cid, {KNN} AS d2 FROM v a, v b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, cid) AS rank FROM d) SELECT qid, cid, rank, round(sqrt(d2), 9) AS distance FROM r WHERE rank <= 5")
def _(t):
    e = t("embeddings")
    d = vectors.knn_join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec")), 5)
    return d.select("qid", "cid", "rank", F.round("distance", 9).alias("distance"))


@query("ve02_knn_join_in_group", f"WITH {VEC}, d AS (SELECT a.vec_id AS qid, b.vec_id AS cid, {KNN} AS d2 FROM v a JOIN v b ON a.label = b.label), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, cid) AS rank FROM d) SELECT qid, cid, rank, round(sqrt(d2), 9) AS distance FROM r WHERE rank <= 3")
def _(t):
    e = t("embeddings")
    d = vectors.knn_join(e.select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("cid"), "label", F.col("embedding").alias("vec")), 3, by="label", cells=4, leaf=16, block_rows=32)
    return d.select("qid", "cid", "rank", F.round("distance", 9).alias("distance"))


@query("ve03_rerank", f"""WITH {VEC}, s AS (SELECT vec_id, e, list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe)) AS a, list_dot_product(list_reverse(e), qe) AS tx FROM v, q),
 p AS (SELECT *, row_number() OVER (ORDER BY a DESC, vec_id) - 1 AS pos FROM s WHERE a >= 0.2 ORDER BY a DESC, vec_id LIMIT 15), n AS (SELECT count(*) AS n FROM p)
SELECT vec_id AS track_id, round(0.9 * (0.7 * a + 0.3 * tx) + 0.1 * (1 - pos / n), 9) AS combined FROM p, n ORDER BY combined DESC, track_id LIMIT 5""")
def _(t):
    q = vectors.vector_of(t("embeddings"), "vec_id", 7, "embedding")
    return vectors.rerank(vecs(t), q, q, 5).select("track_id", F.round("combined", 9).alias("combined"))


@query("ve04_l2_normalize", f"WITH {VEC} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)) )), 9) AS total, round(e[1] / sqrt(list_dot_product(e, e)), 9) AS first FROM v")
def _(t):
    d = t("embeddings").withColumn("u", music.l2_normalize("embedding"))
    return d.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), F.round(F.get("u", F.lit(0)), 9).alias("first"))


@query("ve05_list_and_lookup", f"WITH {TRK} SELECT p_partkey, title FROM trk WHERE p_partkey = 17")
def _(t):
    p = part_tracks(t)
    return tracks.get_track(p.withColumn("point_id", identity.stable_int_id("youtube_id")), "v17").select("p_partkey", "title")


# ------------------------------------------------------------------ moments, changes, sections
def team_seconds(t):
    """Hours as seconds, event types as matches, odd and even users as teams."""
    e = events(t)
    home = F.when(F.col("user_id") % 2 == 0, "home").otherwise("away")
    return e.select(F.col("event_type").alias("match_id"), F.floor((F.col("t_ms") - 1704067200000) / (15 * DAY)).alias("period"), F.floor((F.col("t_ms") - 1704067200000) / HOUR).alias("sec"), home.alias("team_id"), "t_ms", "value", "k").groupBy(
        "match_id", "period", "sec", "team_id").agg(F.min("t_ms").alias("t_ms"), F.avg("value").alias("width_m"), F.avg("k").alias("depth_m"), F.avg((F.col("k") > 40).cast("double")).alias("poss_share"))


def moment_index(t):
    from touchline.session import materialize
    return materialize(moments.build_index(team_seconds(t), ["match_id"], ["home", "away"], ["width_m", "depth_m"]), "moments")


@query("ve06_similar_moments")
def _(t):
    return moments.similar_moments(moment_index(t), {"match_id": "view"}, 1705000000000, 5)


@query("ve07_moment_lift")
def _(t):
    return moments.lift(moment_index(t), 5)


# the least-cost segmentation as a recursive query: the best cost of each prefix from those before it, then back along the choices
CHANGES = f"""WITH RECURSIVE {EVENTS}, ts AS (SELECT event_type AS match_id, CAST(floor((t_ms - 1704067200000) / (15 * {DAY}.0)) AS BIGINT) AS period, CAST(floor((t_ms - 1704067200000) / {HOUR}.0) AS BIGINT) AS sec, CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS team_id,
  min(t_ms) AS t_ms, avg(value) AS w, avg(k) AS d FROM ev GROUP BY 1, 2, 3, 4),
 b AS (SELECT match_id, team_id, period, floor(sec / 6) AS bin, avg(w) AS w, avg(d) AS d, min(t_ms) AS t_ms FROM ts GROUP BY 1, 2, 3, 4),
 z AS (SELECT *, count(*) OVER s AS n, row_number() OVER (s ORDER BY bin) - 1 AS i, (w - avg(w) OVER s) / coalesce(nullif(stddev_pop(w) OVER s, 0), 1) AS z0, (d - avg(d) OVER s) / coalesce(nullif(stddev_pop(d) OVER s, 0), 1) AS z1 FROM b WINDOW s AS (PARTITION BY match_id, team_id, period)),
 c AS (SELECT *, sum(z0) OVER r AS p0, sum(z1) OVER r AS p1, sum(z0 * z0 + z1 * z1) OVER r AS pq FROM z WHERE n >= 12 WINDOW r AS (PARTITION BY match_id, team_id, period ORDER BY i)),
 l AS (SELECT match_id, team_id, period, any_value(n) AS n, list_prepend(0.0, list(p0 ORDER BY i)) AS s0, list_prepend(0.0, list(p1 ORDER BY i)) AS s1, list_prepend(0.0, list(pq ORDER BY i)) AS sq FROM c GROUP BY 1, 2, 3),
 dp AS (SELECT match_id, team_id, period, n, s0, s1, sq, CAST(4 AS BIGINT) AS e, [0.0::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE] AS best, [0::BIGINT, 0, 0, 0] AS prev FROM l
  UNION ALL SELECT match_id, team_id, period, n, s0, s1, sq, e + 1, list_append(best, list_min(tot) + 3.0 * ln(n)), list_append(prev, list_extract(from_, list_position(tot, list_min(tot)))) FROM (
   SELECT *, list_transform(from_, lambda s: best[s + 1] + sq[e + 1] - sq[s + 1] - ((s0[e + 1] - s0[s + 1]) ** 2 + (s1[e + 1] - s1[s + 1]) ** 2) / (e - s)) AS tot FROM (
    SELECT *, list_concat([0::BIGINT], range(4, e - 3)) AS from_ FROM dp WHERE e <= n))),
 back AS (SELECT match_id, team_id, period, prev, n AS stop FROM dp WHERE e = n + 1 UNION ALL SELECT match_id, team_id, period, prev, prev[stop + 1] FROM back WHERE prev[stop + 1] > 0),
 seg AS (SELECT c.match_id, c.team_id, c.period, c.i, (SELECT count(*) FROM back k WHERE k.match_id = c.match_id AND k.team_id = c.team_id AND k.period = c.period AND k.stop <= c.i) AS segment, c.w, c.d, c.z0, c.z1, c.t_ms FROM c),
 m AS (SELECT match_id, team_id, period, segment, arg_min(t_ms, i) AS t_ms, arg_max(t_ms, i) AS final_ms, avg(w) AS w, avg(d) AS d, avg(z0) AS z0, avg(z1) AS z1 FROM seg GROUP BY 1, 2, 3, 4),
 g AS (SELECT *, lag(t_ms) OVER o AS before_from_ms, lag(w) OVER o AS bw, lag(d) OVER o AS bd, z0 - lag(z0) OVER o AS d0, z1 - lag(z1) OVER o AS d1 FROM m WINDOW o AS (PARTITION BY match_id, team_id, period ORDER BY segment))
SELECT match_id, team_id, period, t_ms, round(sqrt(d0 * d0 + d1 * d1), 2) AS magnitude_z, before_from_ms, final_ms + 6000 AS after_to_ms, CASE WHEN abs(d0) >= abs(d1) THEN ['width_m', 'depth_m'] ELSE ['depth_m', 'width_m'] END AS features,
 CASE WHEN abs(d0) >= abs(d1) THEN [round(w - bw, 2), round(d - bd, 2)] ELSE [round(d - bd, 2), round(w - bw, 2)] END AS deltas, CASE WHEN abs(d0) >= abs(d1) THEN [round(bw, 2), round(bd, 2)] ELSE [round(bd, 2), round(bw, 2)] END AS befores,
 CASE WHEN abs(d0) >= abs(d1) THEN [round(w, 2), round(d, 2)] ELSE [round(d, 2), round(w, 2)] END AS afters, 'change:' || match_id || ':' || team_id || ':' || t_ms AS evidence_id FROM g WHERE before_from_ms IS NOT NULL"""


@query("ve08_change_points", CHANGES)
def _(t):
    c = changes.change_points(team_seconds(t), ["match_id", "team_id", "period"], ["width_m", "depth_m"], 6)
    return changes.evidence(c, "change", "match_id", "team_id", "t_ms")


# the greedy rule of the boundaries as a recursive query: one step a frame, carrying the last boundary
@query("ve09_sections", f"""WITH RECURSIVE {EVENTS}, f AS (SELECT event_type AS track_id, floor((t_ms - 1704067200000) / {6 * HOUR}.0) AS hour, avg(value) AS rms FROM ev GROUP BY 1, 2),
 s AS (SELECT track_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n, rms, (coalesce(lag(rms) OVER w, 0) + rms + coalesce(lead(rms) OVER w, 0)) / 3 AS sm FROM f WINDOW w AS (PARTITION BY track_id ORDER BY hour)),
 e0 AS (SELECT track_id, i, n, CASE WHEN n >= 3 THEN sm ELSE rms END AS v FROM s), top AS (SELECT track_id, max(v) AS top FROM e0 GROUP BY 1),
 e AS (SELECT e0.track_id, i, n, v / top AS e, lead(v / top) OVER (PARTITION BY e0.track_id ORDER BY i) AS nxt FROM e0 JOIN top USING (track_id) WHERE top >= 1e-10),
 walk AS (SELECT track_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last, true AS cut FROM e WHERE i = 0
  UNION ALL SELECT w.track_id, e.i, CASE WHEN e.i <= e.n - 2 AND abs(e.nxt - e.e) > 0.15 AND e.i - w.last >= 2 THEN e.i ELSE w.last END, e.i <= e.n - 2 AND abs(e.nxt - e.e) > 0.15 AND e.i - w.last >= 2
   FROM walk w JOIN e ON e.track_id = w.track_id AND e.i = w.i + 1),
 cuts AS (SELECT track_id, i AS a, row_number() OVER w - 1 AS section, lead(i) OVER w AS b, count(*) OVER (PARTITION BY track_id) AS k FROM walk WHERE cut WINDOW w AS (PARTITION BY track_id ORDER BY i)),
 part AS (SELECT c.track_id, c.section, any_value(c.a) AS a, coalesce(any_value(c.b), any_value(e.n)) AS b, any_value(k) AS k, any_value(e.n) AS n, avg(e.e) AS energy, CASE WHEN count(*) >= 2 THEN arg_max(e.e, e.i) - arg_min(e.e, e.i) ELSE 0 END AS trend
  FROM cuts c JOIN e ON e.track_id = c.track_id AND e.i >= c.a AND (c.b IS NULL OR e.i < c.b) GROUP BY 1, 2), p AS (SELECT *, section / greatest(k - 1, 1) AS pos FROM part)
SELECT track_id, CAST(section AS INTEGER) AS section, CASE WHEN pos < 0.15 AND energy < 0.4 THEN 'intro' WHEN pos > 0.85 AND energy < 0.4 THEN 'outro' WHEN energy >= 0.65 THEN 'drop' WHEN trend > 0.1 THEN 'buildup' WHEN energy < 0.4 AND pos > 0.2 AND pos < 0.8 THEN 'breakdown' WHEN energy >= 0.4 THEN 'buildup' ELSE 'breakdown' END AS label,
 round(a * 4.0::DOUBLE, 1) AS start_sec, round(least(b * 4.0::DOUBLE, n * 4.0::DOUBLE), 1) AS end_sec, CASE WHEN energy < 0.3 THEN 'low' WHEN energy < 0.65 THEN 'medium' ELSE 'high' END AS energy_level FROM p
UNION ALL SELECT track_id, 0, 'silence', 0.0::DOUBLE, round(count(*) * 4.0::DOUBLE, 1), 'low' FROM e0 JOIN top USING (track_id) WHERE top < 1e-10 GROUP BY 1""")
def _(t):
    f = events(t).groupBy(F.col("event_type").alias("track_id"), F.floor((F.col("t_ms") - 1704067200000) / (6 * HOUR)).alias("hour")).agg(F.avg("value").alias("rms"))
    from touchline.operators.ordered import with_sequence
    return sections.sections(with_sequence(f, "frame_idx", ["track_id"], ["hour"]))


@query("ve10_framed_rms", f"WITH {EVENTS} SELECT user_id, event_id // 100 AS frame_idx, round(sqrt(avg(value * value)), 9) AS rms FROM ev GROUP BY 1, 2")
def _(t):
    return sections.framed_rms(events(t), ["user_id"], "event_id", "value", 100).withColumn("rms", F.round("rms", 9))
