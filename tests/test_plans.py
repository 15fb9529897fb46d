from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import identity as ids
from touchline.functions import parsing as ps
from touchline.functions import questions
from touchline.models import training
from touchline.operators import joins, ordered
from touchline.plans import analyst, medallion, playlog, scores, timeline, tracks


def col_of(spark, values, expr, typ="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in d.select(expr.alias("x"), "i").orderBy("i").select("x").collect()]


def test_names_teams_seasons_ids(spark):
    names = ["LeBron James", "Tim Hardaway Jr.", "Wendell Carter III", "Nikola Jokić", None, "  Padded   Name  ", "Ken Griffey Sr. Jr.", "ÀÉÎÕÜ Ñandú", "Ｆｕｌｌ Width"]
    want = ["lebron james", "tim hardaway", "wendell carter", "nikola jokic", "", "padded name", "ken griffey", "aeiou nandu"]
    assert col_of(spark, names, ids.normalize_name("v"))[:8] == want
    assert col_of(spark, names, ids.normalize_name("v", full_unicode=True)) == want + ["full width"]
    assert col_of(spark, ["NJN", "BRK", "NOH", "SEA", None, " bos "], ids.normalize_team("v")) == ["BKN", "BKN", "NOP", "OKC", "UNK", "BOS"]
    assert col_of(spark, ["2023", "2023-2024", "2023-24", "1999", None], ids.normalize_season("v")) == ["2023-24"] * 3 + ["1999-00", ""]
    assert col_of(spark, ["201566", " 7 ", None, "", "x"], ids.player_id("v")) == ["P201566", "P7", "", "", None]
    assert col_of(spark, ["1610612747", "0"], ids.team_id("v")) == ["T1610612747", ""]
    assert col_of(spark, ["2023"], ids.season_id("v")) == ["S2023-24"]
    import hashlib
    x = "dQw4w9WgXcQ"
    assert col_of(spark, [x], ids.stable_int_id("v")) == [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") % 2**63]
    assert col_of(spark, ["a"], ids.hash_player_id("v", F.lit("nj"), F.lit("2023")))[0] == "PX" + hashlib.md5(b"a|BKN|2023-24").hexdigest()[:10]


def test_questions(spark):
    teams = {"t:home": "Auckland FC", "t:away": "Newcastle Jets"}
    q = ["How high was the defensive line of Auckland FC?", "Did Newcastle get more compact?", "Show moments similar to 20:00", "Top 3 players by sprints", "'; SELECT * FROM system.users; --"]
    d = questions.route(spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, question string"), teams=teams).orderBy("i").collect()
    assert [(r.tool, r.metric, r.team_id, r.t_ms, r.n) for r in d] == [
        ("team_shape_trend", "def_line_height_m", "t:home", None, None), ("team_shape_trend", "depth_m", "t:away", None, None),
        ("similar_moments", None, None, 1_200_000, None), ("top_players", "sprints", None, None, 3), (None, None, None, None, None)]
    assert d[4].refusal_reason == "commands in question"


PLAYERS = 12
SEASONS = ["2020-21", "2021-22", "2022-23", "2023-24"]


@pytest.fixture(scope="module")
def player_tables(spark):
    """12 players x 4 seasons: a missing middle salary, a traded player, one without contract, one with few games."""
    stats, con, inj = [], [], []
    for p in range(1, PLAYERS + 1):
        for k, s in enumerate(SEASONS):
            pts = 8.0 + p + 2.5 * k * (p % 2)
            gp = 5.0 if p == 12 else 60.0
            for team in (["LAL", "NJN"] if p == 3 else ["BOS"]):
                stats.append((p, f"Player {p} Jr.", team, s, 20.0 + p % 9, gp, 30.0, pts, 4.0, 3.0, 1.0, None if p == 5 else 0.5, 1.5, 0.5 + p / 100))
            if p != 7 and not (p == 4 and k == 1):
                con.append((f"player {p}", s[:4], float(1_000_000 * p + 100_000 * k), "BOS"))
        inj.append((f"Player {p}", "2023-24", 3 * p))
    return (spark.createDataFrame(stats, "player_id int, player_name string, team_abbreviation string, season string, age double, gp double, min double, pts double, reb double, ast double, stl double, blk double, tov double, ts_pct double"),
            spark.createDataFrame(con, "player string, season string, salary double, team string"),
            spark.createDataFrame(inj, "player_name string, season string, games_missed int"))


@pytest.fixture(scope="module")
def summary(player_tables):
    st, con, inj = player_tables
    return medallion.player_season_summary(medallion.fact_player_season_stats(st), medallion.fact_player_contracts(con), medallion.fact_player_injuries(inj)).cache()


def test_summary(summary):
    assert summary.count() == PLAYERS * 4
    r = {(x.PLAYER_ID, x.SEASON): x for x in summary.collect()}
    assert r["P4", "2021-22"].salary == 0 and r["P4", "2020-21"].salary == 4_000_000 and r["P7", "2023-24"].salary == 0
    assert (r["P2", "2023-24"].total_games_missed, r["P2", "2023-24"].injury_count, r["P2", "2020-21"].injury_count) == (6, 1, 0)
    assert r["P3", "2020-21"].TEAM_ABBREVIATION == "LAL"


def test_features(summary):
    v = {(x.PLAYER_ID, x.SEASON): x for x in medallion.features_value_model(summary).collect()}
    assert v["P4", "2021-22"].salary == 4_000_000 and not any(k[0] == "P7" for k in v) and v["P1", "2020-21"].prev_PTS is None
    i = {(x.PLAYER_ID, x.SEASON): x for x in medallion.features_improvement_model(summary).collect()}
    assert len(i) == PLAYERS * 3 and i["P1", "2021-22"].improved_flag == 1 and i["P2", "2021-22"].improved_flag == 0 and i["P1", "2023-24"].improved_flag == 0
    t = {(x.PLAYER_ID, x.SEASON): x for x in medallion.features_trade_target(summary).collect()}
    assert not any(k[0] == "P12" for k in t)
    x = t["P5", "2023-24"]
    assert x.performance_score == pytest.approx(x.PTS + 1.2 * 4 + 1.5 * 3 + 2 - 1.5) and x.contract_efficiency == pytest.approx(x.performance_score / 5.3)


def test_scores(summary):
    f = medallion.features_trade_target(summary)
    few = scores.score_trade(f).collect()                           # fewer than ten players stay: ranked, and said so
    assert few and {r.pool_status for r in few} == {"too_few_rows"} and sorted(r["rank"] for r in few) == list(range(1, len(few) + 1))
    many = f
    for k in range(1, 4):
        many = many.unionByName(f.withColumns({"PLAYER_ID": F.concat("PLAYER_ID", F.lit(str(k))), "salary": F.col("salary") * (1 + k / 10)}))
    s = scores.score_trade(many).orderBy("rank").collect()
    assert [r["rank"] for r in s] == list(range(1, len(s) + 1)) and len(s) >= 10
    assert all(a.trade_target_score >= b.trade_target_score for a, b in zip(s, s[1:])) and all(r.tier for r in s)


def test_models(summary, spark):
    v = medallion.features_value_model(summary)
    many = v
    for k in range(1, 5):
        many = many.unionByName(v.withColumns({"PLAYER_ID": F.concat("PLAYER_ID", F.lit(str(k))), "PTS": F.col("PTS") + k, "salary": F.col("salary") * (1 + k / 10)}))
    r = training.train_value(many, "2022-23", "2023-24", models={"linear_regression": training.value_models()["linear_regression"],
                                                                "random_forest": training.value_models(trees=5)["random_forest"]})
    assert r["best"] in r["results"] and r["results"][r["best"]]["mae"] == min(x["mae"] for x in r["results"].values())
    imp = training.importance(r["models"]["random_forest"], r["features"], spark)
    assert imp.count() == len(r["features"]) and imp.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert training.importance(r["models"]["linear_regression"], r["features"], spark) is None
    no_val = training.train_value(many, "2022-23", "2030-31", models={"linear_regression": training.value_models()["linear_regression"]})
    assert no_val["results"]["linear_regression"]["mae"] > 0 and no_val["results"]["linear_regression"]["rmse"] == 0
    assert training.train_value(v.filter("PLAYER_ID = 'P1'"))["best"] is None
    assert training.best({"a": {"f1": 0.0}}, "f1", lowest=False) is None
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "y double, prediction double")
    assert training.auc(one, "y") == 0.0
    m = training.classification_metrics(one, "y").first()
    assert (m.precision, m.recall, m.accuracy) == (1.0, 0.5, 0.5)


def test_score_timeline(spark):
    rows = [("1", 1, 1, "12:00", None, None), ("1", 2, 1, "11:30", "0 - 2", "2"), ("1", 3, 2, "10:00", "3 - 2", "-1"), ("1", 4, 5, "4:00", "3 - 4", "1"), ("1", 5, 1, "11:00", "0 - 2", "-2")]
    d = timeline.scoring_events(spark.createDataFrame(rows, "GAME_ID string, EVENTNUM int, PERIOD int, PCTIMESTRING string, SCORE string, SCOREMARGIN string")).orderBy("event_num").collect()
    assert [(r.home, r.away, r.mel_ms, r.conflict) for r in d] == [(2, 0, 30_000, False), (2, 3, 840_000, False), (4, 3, 2_940_000, False), (2, 0, 60_000, True)]
    mel = [*range(0, 11_000, 1000), 60_000]
    fr = spark.createDataFrame([("m", 1, m, 1_000_000 + i * 1000) for i, m in enumerate(mel)], "match_id string, period int, mel_ms bigint, t_ms bigint")
    ev = spark.createDataFrame([("m", 1, 4_500), ("m", 1, 30_000), ("m", 2, 800_000), ("m", 1, 99_000)], "match_id string, period int, mel_ms bigint")
    for hot in (None, 0):
        got = sorted((r.mel_ms, r.t_ms, r.tracked) for r in timeline.place(ev, fr, hot_rows=hot).collect())
        assert got == [(4_500, 1_005_000, True), (30_000, 1_011_000, False), (99_000, 1_011_000, False)]


def test_play_log(spark):
    r = random.Random(4)
    notes = [("s", f"n{i}", i % 5, 1000 + i * 300 + r.randrange(50)) for i in range(60)]
    presses = [("p1", "s", l, t + r.choice([-250, -190, -100, 0, 90, 150, 201])) for _, _, l, t in notes if r.random() < 0.95] + [("p2", "s", 0, 1000)]
    nd = spark.createDataFrame(notes, "song_id string, note_id string, lane int, time_ms bigint")
    pd_ = spark.createDataFrame(presses, "play_id string, song_id string, lane int, time_ms bigint")
    want = {}
    for play in ("p1", "p2"):
        ev = []
        for _, n, l, t in notes:
            hit = sorted(pt for pp, _, pl, pt in presses if pp == play and pl == l and abs(pt - t) <= 200)
            ev.append((hit[0] if hit else t + 200, t, n, None if not hit else "PERFECT" if abs(hit[0] - t) <= 120 else "GOOD"))
        score = streak = best = hits = 0
        for _, _, _, q in sorted(ev, key=lambda e: e[:3]):
            if q:
                score += (100 if q == "PERFECT" else 50) * (4 if streak >= 30 else 3 if streak >= 20 else 2 if streak >= 10 else 1)
                streak, hits = streak + 1, hits + 1
                best = max(best, streak)
            else:
                streak = 0
        want[play] = (score, hits, best)
    for hot in (None, 0):
        got = {x.play_id: x for x in playlog.results(playlog.score_plays(nd, pd_, hot_rows=hot)).collect()}
        assert {k: (v.score, v.total_hits, v.max_streak) for k, v in got.items()} == want
        assert got["p2"].grade == "F"
    lb = playlog.leaderboard(spark.createDataFrame([("s", f"p{i}", i * 10) for i in range(15)], "song_id string, play_id string, score int"))
    assert [x.play_id for x in lb.orderBy("rank").collect()][:2] == ["p14", "p13"] and lb.count() == 10


def test_analyst_allow_lists_and_cutoff(spark):
    w = spark.createDataFrame([("e1", "t", 0, 60000, 100.0, 10.0, 1, 5.0, 60000, 60000, 0, True), ("e2", "t", 60000, 120000, 900.0, 10.0, 1, 5.0, 60000, 30000, 0, True)],
                              "entity_id string, team_id string, window_start_ms bigint, window_end_ms bigint, distance_m double, hi_distance_m double, sprint_count int, max_speed_mps double, active_ms bigint, detected_ms bigint, excluded_gap_ms bigint, is_final boolean")
    assert [r.entity_id for r in analyst.top_players(w, {"as_of_ms": 60000}).collect()] == ["e1"]
    with pytest.raises(ValueError):
        analyst.top_players(w, {}, metric="distance_m; drop table x")
    with pytest.raises(ValueError):
        analyst.top_players(w, {}, team_id="t:other", teams=["t"])
    with pytest.raises(ValueError):
        analyst.team_shape_trend(w, {}, metric="nope")
    assert analyst.top_players(w, {}, metric="distance_per_active_min_m").count() == 0


def test_tracks(spark):
    feats = (128.0, 0.09, 0.06, 1200.0, 7.0, 300.0)
    t = spark.createDataFrame([("v1", "One", None, feats, [("intro", 0.0, 50.0, "low"), ("drop", 50.0, 300.0, "high")], [1.0, 0.0], [1.0, 0.0], 1),
                               ("v2", "Two", "Ann", (90.0, 0.02, 0.01, 3200.0, 1.0, 100.4), [], [0.6, 0.8], [0.0, 1.0], 1)],
                              "youtube_id string, title string, artist string, features struct<tempo_bpm:double,energy_mean:double,energy_std:double,spectral_centroid_mean:double,onset_rate:double,duration_seconds:double>, "
                              "sections array<struct<label:string,start_sec:double,end_sec:double,energy_level:string>>, audio array<float>, text_vec array<float>, analyzed_at int")
    idx = tracks.index(t, None).cache()
    one = idx.filter("youtube_id = 'v1'").first()
    assert one.genre_tags == ["house", "tech house", "dark", "dynamic", "percussive"]
    assert one.mood_tags == ["dark", "atmospheric", "driving", "dynamic", "long-intro", "peak-time", "percussive"]
    assert one.search_text.startswith("One: house, tech house, dark, dynamic, percussive track at 128 BPM with high energy and dark, low spectral energy.")
    assert '"Two" by Ann is a 90 BPM' in idx.filter("youtube_id = 'v2'").first().summary
    hit = tracks.search_text(idx, "dark techno with long intro", [1.0, 0.0]).first()
    assert hit.youtube_id == "v1" and "intro lasts 50s" in hit.why and "darker spectral profile" in hit.why and "128 BPM aligns with the genre cue" in hit.why
    sim = tracks.search_similar(idx, {"tempo_bpm": 92, "energy_mean": 0.03, "spectral_centroid_mean": 3300}, [0.6, 0.8]).collect()
    assert sim[0].why.startswith("near-identical tempo (90 BPM); similar energy; similar brightness; tags: downtempo, bright, hypnotic")
    assert sim[1].why.startswith("tempo offset +36 BPM; higher energy; darker tone")
    assert tracks.to_analyse(t, idx.filter("youtube_id = 'v1'")).count() == 1 and tracks.get_track(idx, "v2").count() == 1 and tracks.list_tracks(idx).count() == 2


def test_hot_key_takes_the_chunked_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 13).alias("v"))
    assert ordered.split_if_hot(df, ["k"], F.col("t"), 10_000) is None and ordered.split_if_hot(df, ["k"], F.col("t"), 100) is not None
    plain = ordered.running_sum(df, "v", "s", ["k"], ["t"]).orderBy("t").collect()
    split = ordered.running_sum(df, "v", "s", ["k"], ["t"], ordered.by_number("t", 50)).orderBy("t").collect()
    assert plain == split
    s = df.withColumn("score", F.when(F.col("t") % 2 == 0, 1.0).otherwise(F.col("v").cast("double")))
    got = [r.t for r in ordered.global_rank(s, "score", "t", buckets=8).orderBy("rank").collect()]
    assert got == [r.t for r in s.orderBy(F.desc("score"), "t").collect()]


def test_nearest_join_ties_and_tolerance(spark):
    l = spark.createDataFrame([(1, 100.0), (1, 200.0), (2, 5.0)], "p int, t double")
    r = spark.createDataFrame([(1, 97.0, "b", 2), (1, 103.0, "a", 1), (1, 204.0, "c", 3)], "p int, rt double, name string, o int")
    for hot in (None, 0):
        d = joins.nearest_join(l, r, ["p"], "t", "rt", ["name"], 3.0, "o", 50, hot_rows=hot)
        assert sorted((x.p, x.t, x.matched.name if x.matched else None) for x in d.collect()) == [(1, 100.0, "a"), (1, 200.0, None), (2, 5.0, None)]


def test_lyrics(spark):
    d = spark.createDataFrame([("d", "[ti:x]\n[00:05.50] hello\n[00:07.123]  world \n[00:20.00]\n[01:00.00] end")], "doc string, text string")
    rows = ps.parse_lrc(d, "text", ["doc"])
    assert sorted((r.time_ms, r.words) for r in rows.collect()) == [(5500, "hello"), (7123, "world"), (60000, "end")]
    from touchline.operators.windows import lyric_sections
    s = lyric_sections(rows.withColumn("dur", F.lit(70000)), ["doc"], "time_ms", "dur")
    assert sorted((r.start_ms, r.end_ms, r.type) for r in s.collect()) == [
        (2000, 5000, "instrumental"), (5500, 10123, "vocal"), (9123, 59500, "instrumental"), (60000, 63000, "vocal"), (63000, 69000, "instrumental")]


@pytest.mark.parametrize("name, module, attribute, asked", [
    ("cp11_score_underrated", "touchline.plans.scores", "score_underrated", "trees"), ("cp11_score_improvement", "touchline.plans.scores", "score_improvement", "trees"),
    ("ml03_train_value_models", "touchline.models.training", "train_value", "models"), ("ml04_train_improvement_models", "touchline.models.training", "train_improvement", "models")])
def test_registered_queries_fit_the_default_models(spark, monkeypatch, name, module, attribute, asked):
    import importlib

    from touchline.catalog import QUERIES

    class Called(Exception):
        pass

    def seen(*args, **options):
        assert asked not in options
        raise Called

    monkeypatch.setattr(importlib.import_module(module), attribute, seen)
    with pytest.raises(Called):
        QUERIES[name](spark, "/root/testdata/sf0.001")


def test_a_chunked_window_shuffles_its_rows_once(spark):
    """The rows' window and the join to what earlier chunks hand on have one key; null keys are one key."""
    from touchline.operators import ordered

    df = spark.createDataFrame([(k, i, float(i)) for k in ("a", None) for i in range(40)], "k string, t bigint, v double")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        d = ordered.with_lag(df, {"v": "p"}, ["k"], ["t"], ordered.by_number("t", 7))
        side = d._jdf.queryExecution().executedPlan().toString()
        assert side.count("Exchange hashpartitioning(_scope") == 1 and "coalesce(k" not in side
        assert sorted((r.k or "", r.t, r.p) for r in d.collect()) == sorted((k, i, float(i - 1) if i else None) for k in ("a", "") for i in range(40))
    finally:
        for c in conf:
            spark.conf.unset(c)


def test_sums_and_lasts_in_chunks_are_those_without(spark):
    from touchline.operators import ordered

    rows = [(k, i, None if i % 5 == 1 else i % 7, None if i % 3 else i) for k in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint, w bigint")
    run = lambda c: ordered.sums_and_lasts(df, {"v": "s"}, {"w": "l"}, ["k"], ["t"], c).select("k", "t", "s", "l").collect()
    assert sorted(map(str, run(None))) == sorted(map(str, run(ordered.by_number("t", 8))))


def test_upsert_spreads_rows_before_it_sorts_them(spark):
    from touchline.sinks.tables import upsert

    new = spark.createDataFrame([("a", 2, "x"), (None, 1, "n")], "k string, at int, s string")
    old = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("b", 1, "w"), (None, 1, "m")], "k string, at int, s string")
    d = upsert(new, old, ["k"], "at")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange"):]
    assert sorted((r.k or "", r.at, r.s) for r in d.collect()) == [("", 1, "n"), ("a", 2, "x"), ("b", 1, "w")]


def test_forests_keep_their_rows_nodes(spark, monkeypatch):
    """Every forest keeps the rows' nodes; that changes no tree."""
    from pyspark.ml.regression import RandomForestRegressor

    seen = []

    class Stop(Exception):
        pass

    def caught(features, model):
        seen.append(model)
        raise Stop

    monkeypatch.setattr(training, "feature_pipeline", caught)
    rows = spark.range(80).select(F.when(F.col("id") < 60, "1").otherwise("2").alias("SEASON"), (F.col("id") + 1.0).alias("salary"),
                                  F.lit(50).alias("GP"), F.lit(20.0).alias("MIN"), (F.col("id") % 7).alias("PTS"), F.col("id").alias("PLAYER_ID"))
    with pytest.raises(Stop):
        scores.score_underrated(rows)
    monkeypatch.undo()
    forests = [*seen, training.value_models()["random_forest"], training.improvement_models()["random_forest"]]
    assert [f.getCacheNodeIds() for f in forests] == [True] * 3
    d = training.prepared(rows, ["GP", "PTS", "MIN"])
    fit = lambda keep: training.feature_pipeline(["GP", "PTS", "MIN"], RandomForestRegressor(
        labelCol="salary", numTrees=5, seed=42, cacheNodeIds=keep)).fit(d).stages[-1].toDebugString.split("\n", 1)[1]
    assert fit(True) == fit(False)


def test_a_forest_is_fitted_in_parts(spark, monkeypatch, tmp_path):
    """Parts of two trees are one forest: all its trees count, in predictions, importances and after a reload."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    monkeypatch.setattr(training.ForestInParts, "PART", 2)
    d = training.prepared(spark.range(300).select((F.col("id") % 17).alias("a"), (F.col("id") * 7 % 30).alias("b"), (F.col("id") % 17 * 3.0).alias("salary"),
                                                  (F.col("id") % 17 > 8).cast("double").alias("flag")), ["a", "b"]).coalesce(1)
    for model in (RandomForestRegressor(labelCol="salary", numTrees=5, maxDepth=3, seed=42), RandomForestClassifier(labelCol="flag", numTrees=5, maxDepth=3, seed=42)):
        fitted = training.feature_pipeline(["a", "b"], model).fit(d)
        forest = fitted.stages[-1]
        assert forest.getNumTrees == len(forest.trees) == 5 and forest.getOrDefault("labelCol") == model.getLabelCol()
        assert abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9 and forest.featureImportances[0] > 0.5
        fitted.save(f"{tmp_path}/{forest.uid}")
        again = PipelineModel.load(f"{tmp_path}/{forest.uid}")
        rows, reloaded = (m.transform(d).select("a", "b", "features", "prediction").collect() for m in (fitted, again))
        assert rows == reloaded
        for r in rows[:20]:
            votes = [t.predict(r.features) for t in forest.trees]
            if isinstance(model, RandomForestRegressor):
                assert abs(r.prediction - sum(votes) / 5) < 1e-9
        whole = training.ForestInParts(model.copy({model.numTrees: 2})).fit(fitted.stages[1].transform(fitted.stages[0].transform(d)))
        assert [t.toDebugString.split("\n", 1)[1] for t in whole.trees] == [t.toDebugString.split("\n", 1)[1] for t in forest.trees[:2]]


def test_models_are_fitted_at_once(spark):
    """Two models that each wait for the other: one after the other they would never end."""
    import threading

    from pyspark.ml import Estimator
    from pyspark.ml.regression import LinearRegression

    both = threading.Barrier(2, timeout=60)

    class Meets(Estimator):
        def _fit(self, dataset):
            both.wait()
            return LinearRegression(labelCol="salary").fit(dataset)

    rows = spark.range(120).select(F.when(F.col("id") < 80, "2021-22").otherwise("2023-24").alias("SEASON"), (F.col("id") * 2.0 + 1).alias("salary"), F.col("id").alias("PTS"))
    r = training.train_value(rows, models={"a": Meets(), "b": Meets()})
    assert list(r["results"]) == list(r["models"]) == ["a", "b"] and r["status"] == "ok"
    assert r["results"]["a"]["mae"] == r["results"]["b"]["mae"] < 1e-6
