from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from touchline.sinks import tables as tb
from touchline.sources import files, payloads, tracking as tr


def test_csv_and_seasons_from_file_names(spark, tmp_path):
    for s, rows in (("2022-23", "1,10\n2,20\n"), ("2023-24", "1,30\n")):
        (tmp_path / f"advanced_stats_{s}.csv").write_text("PLAYER_ID,PIE\n" + rows)
    assert files.read_csv(spark, f"{tmp_path}/advanced_stats_2022-23.csv").dtypes == [("PLAYER_ID", "int"), ("PIE", "int")]
    d = files.read_partitioned_files(spark, f"{tmp_path}/advanced_stats_*.csv", r"advanced_stats_(.+)\.csv", "PLAYER_ID int, PIE double")
    assert sorted((r.season, r.PLAYER_ID, r.PIE, r.raw_file_name) for r in d.collect()) == [
        ("2022-23", 1, 10.0, "advanced_stats_2022-23.csv"), ("2022-23", 2, 20.0, "advanced_stats_2022-23.csv"), ("2023-24", 1, 30.0, "advanced_stats_2023-24.csv")]
    m = tb.add_metadata(files.read_csv(spark, f"{tmp_path}/advanced_stats_2023-24.csv"), "adv", "b1").first()
    assert (m.source_name, m.batch_id, m.raw_file_name) == ("adv", "b1", "advanced_stats_2023-24.csv") and m.ingestion_ts


def test_enveloped_json_with_drift(spark, tmp_path):
    (tmp_path / "2019-20.json").write_text(json.dumps({"meta": [], "Stats": [{"a": 1, "bubble": "x"}, {"a": 2, "bubble": None}]}))
    (tmp_path / "2020-21.json").write_text(json.dumps({"Stats": [{"a": 3}]}))
    (tmp_path / "2021-22.json").write_text(json.dumps({"Stats": []}))
    d = files.read_enveloped_json(spark, f"{tmp_path}/*.json", "Stats")
    assert sorted((r.season, r.a, r.bubble) for r in d.collect()) == [("2019-20", 1, "x"), ("2019-20", 2, None), ("2020-21", 3, None)]
    auto = files.read_enveloped_json(spark, f"{tmp_path}/*.json", None, all_string=True)
    assert auto.count() == 3 and set(t for _, t in auto.dtypes) == {"string"}


def test_json_documents_and_jdbc_or_csv(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps([{"name": "A", "style": {"role": "PG"}, "tags": ["x", "y"]}, {"name": "B"}]))
    d = {r.name: r for r in files.read_documents(spark, f"{tmp_path}/docs.json").collect()}
    assert d["A"].style == '{"role":"PG"}' and d["A"].tags == '["x","y"]' and d["B"].style is None
    assert files.read_json(spark, f"{tmp_path}/docs.json").count() == 2
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert files.read_jdbc_or_csv(spark, "t", f"{tmp_path}/t.csv").count() == 1
    with pytest.raises(Exception, match="(?i)driver"):              # a database that cannot be read is not replaced by a file
        files.read_jdbc_or_csv(spark, "t", f"{tmp_path}/t.csv", url="jdbc:none:x")


def test_asset_audit(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "s").mkdir(parents=True)
    (raw / "s" / "a.txt").write_bytes(b"aaa")
    (raw / "s" / "b.txt").write_bytes(b"bbb")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("s/a.txt", sha(b"aaa"), hashlib.md5(b"aaa").hexdigest(), "md5"), ("s/b.txt", sha(b"xxx"), None, None), ("s/c.txt", sha(b"c"), None, None)]
    man = spark.createDataFrame(rows, "path string, sha256 string, expected_checksum string, checksum_algo string")
    assert {r.path: r.status for r in files.verify_assets(spark, str(raw), man).collect()} == {"s/a.txt": "ok", "s/b.txt": "mismatch", "s/c.txt": "missing"}


def test_wide_tracking(spark, tmp_path):
    def write(name, prefix, labels, val):
        head = [",,,," + ",".join(prefix for _ in labels for _ in "xy"), ",,,1,,2,", "Period,Frame,Time [s]," + ",".join(f"{l}," for l in labels)]
        head[2] = "Period,Frame,Time [s]," + ",".join(x for l in labels for x in (l, ""))
        body = []
        for i in range(130):
            body.append(f"1,{i + 1},{i * 0.04}," + ",".join(str(v) if v is not None else "" for l in labels for v in val(l, i)))
        (tmp_path / name).write_text("\n".join(head + body) + "\n")
    def home(l, i):
        if l == "Ball":
            return (None, None) if 10 <= i < 14 else (0.5, 0.5)
        return (0.05, 0.5) if l == "Player11" else (0.3 + i / 1000, 0.25)
    away = lambda l, i: (0.96, 0.5) if l == "Player25" else (0.6, 0.75)
    write("h.csv", "Home", ["Player11", "Player1", "Ball"], home)
    write("a.csv", "Away", ["Player25", "Player26", "Ball"], away)
    h, a = tr.read_wide_tracking(spark, f"{tmp_path}/h.csv"), tr.read_wide_tracking(spark, f"{tmp_path}/a.csv")
    assert h[1] == ["Player11", "Player1", "Ball"] and h[0].count() == 130
    n = tr.normalize_wide(h, a, "g1")
    k = {r.side: (r.keeper, r.sign) for r in n["keepers"].collect()}
    assert k == {"Home": ("Player11", 1.0), "Away": ("Player25", -1.0)}
    p = n["positions"].filter("entity_id = 'metrica:player:g1.away.26' and frame = 1").first()
    assert p.x_m == pytest.approx(10.5) and p.y_m == pytest.approx(-17.0) and p.x_att == pytest.approx(-10.5) and p.team_id == "metrica:team:g1.away"
    assert n["positions"].filter("entity_type = 'ball'").agg(F.count("x_m"), F.count("x_att")).first() == (126, 0)
    f = {r.frame: r for r in n["frames"].collect()}
    assert f[11].frame_quality_flags == "no_ball" and f[1].frame_quality_flags == "" and f[130].t_ms == 129 * 40
    assert n["spans"].filter("entity_id like '%home.1'").first()[2:] == (1, 130)


def test_frame_lines(spark, tmp_path):
    def line(frame, period, n=3, ball=True, det=True):
        return json.dumps({"frame": frame, "period": period, "timestamp": "00:00:01.00", "possession": {"player_id": 7, "group": "home team"},
                           "ball_data": {"x": 1.0, "y": 2.0, "z": 0.1, "is_detected": True} if ball else {},
                           "player_data": [{"player_id": i, "x": float(i), "y": 0.0, "is_detected": det or i != 8} for i in range(7, 7 + n)]})
    rows = [line(10, 1), line(11, 1, det=False), line(11, 1), line(9, 1), line(12, None), line(12, 1, ball=False), line(70, 1, n=0), line(100, 2), line(101, 2, n=4)]
    (tmp_path / "t.jsonl").write_text("\n".join(rows))
    lines = tr.read_frames_jsonl(spark, f"{tmp_path}/t.jsonl").withColumn("match_id", F.lit("m"))
    match = spark.createDataFrame([("m", 1, 2, 1, 10, 60, "left_to_right"), ("m", 1, 2, 2, 100, 160, "right_to_left")],
                                  "match_id string, home_id bigint, away_id bigint, period int, start_frame bigint, end_frame bigint, home_side string")
    players = spark.createDataFrame([("m", 7, 1), ("m", 8, 1), ("m", 9, 2)], "match_id string, player_id bigint, team_id bigint")
    for hot in (None, 0):
        n = tr.normalize_frame_lines(lines, match, players, hot_rows=hot)
        f = sorted(n["frames"].collect(), key=lambda r: r.seq)
        assert [(r.seq, r.source_frame_id, r.t_ms) for r in f] == [(0, 10, 0), (1, 11, 100), (2, 12, 200), (3, 70, 6000), (4, 100, 6100), (5, 101, 6200)]
        assert [r.frame_quality_flags for r in f] == ["", "provider_extrapolated", "no_ball", "no_entities", "", ""]
    q = n["quality"].first()
    assert (q.frames, q.dropped_no_period, q.non_monotonic, q.unknown_ids, q.frames_without_ball) == (6, 1, 2, 1, 1)
    p = n["positions"].filter("seq = 4 and entity_id = 'skillcorner:player:9'").first()
    assert p.team_id == "skillcorner:team:2" and p.x_att == 9.0
    assert n["positions"].filter("seq = 0 and entity_type = 'ball'").first().x_att == 1.0
    ev = spark.createDataFrame([("m", 11), ("m", 99)], "match_id string, frame_start bigint")
    assert sorted((r.frame_start, r.match_elapsed_ms) for r in tr.events_on_frames(ev, n["frames"]).collect()) == [(11, 100), (99, None)]
    ph = spark.createDataFrame([("m", 1, 1, "left_to_right"), ("m", 1, 2, "right_to_left"), ("m", 2, 1, "right_to_left")],
                               "match_id string, period int, team_in_possession_id bigint, attacking_side string")
    assert tr.direction_agreement(ph, match).first().status == "validated"


def test_moments(spark, tmp_path):
    def ents(x0, x1, ball=True):
        e = [[-1, -1, 10.0, 25.0, 5.0]] if ball else []
        return e + [[1, 100 + i, x0, 10.0 + i, 0.0] for i in range(5)] + [[2, 200 + i, x1, 10.0 + i, 0.0] for i in range(5)]
    mk = lambda per, t, clk, e: [per, t, clk, 24.0, None, e]
    ms1 = [mk(1, 1000, 720.0, ents(40, 20)), mk(1, 1040, 719.96, ents(40, 20)), mk(1, 1080, 719.96, ents(40, 20, False))]
    ms2 = [mk(1, 1040, 719.96, ents(40, 20)), mk(1, 1080, 719.5, ents(41, 20)), mk(1, 9000, None, ents(40, 20))]
    team = lambda i, base: {"teamid": i, "name": "T", "abbreviation": "T", "players": [{"playerid": base + k, "firstname": "F", "lastname": str(k), "jersey": str(k), "position": "G"} for k in range(4)]}
    doc = {"gameid": "g", "gamedate": "d", "events": [{"eventId": str(i), "home": team(1, 100), "visitor": team(2, 200), "moments": m} for i, m in enumerate((ms1, ms2))]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    m = tr.read_moments(spark, f"{tmp_path}/g.json")
    assert m.count() == 6
    n = tr.normalize_moments(m, tr.read_moment_players(spark, f"{tmp_path}/g.json"))
    f = sorted(n["frames"].collect(), key=lambda r: r.seq)
    assert [(r.t_ms, r.mel_ms, r.source_clock) for r in f] == [(0, 0, "12:00.00"), (40, 40, "11:59.96"), (80, 40, "11:59.96"), (8000, None, None)]
    assert [r.frame_quality_flags for r in f] == ["", "", "clock_stopped,no_ball", ""]
    q = n["quality"].first()
    assert (q.moments_total, q.unique_moments, q.duplicates_dropped, q.conflicting, q.unknown_ids) == (6, 4, 2, 1, 2)
    assert [(r.start_ms, r.duration_ms) for r in n["gaps"].collect()] == [(80, 7920)]
    # both teams left of half court, away nearer to the left basket: home attacks toward -x
    assert n["votes"].first().home_sign == -1.0
    p = n["positions"].filter("seq = 0 and entity_id = 'sportvu:player:100'").first()
    assert p.x_m == pytest.approx(-7 * 0.3048) and p.x_att == pytest.approx(7 * 0.3048)


def test_frame_messages(spark, circle):
    d = tr.assemble_frames(circle["frames"].filter("seq < 3"), circle["positions"].filter("seq < 3"), "s1", {"source": "test"})
    rows = {r.sequence: json.loads(r.value) for r in d.collect()}
    assert sorted(rows) == [0, 1, 2, 3] and len(rows[0]["players"]) == 22 and rows[0]["ball"]["entity_type"] == "ball"
    assert rows[3]["end_of_stream"] and len(rows[3]["roster"]) == 23 and rows[3]["roster"] == sorted(rows[3]["roster"])


def test_lake_and_tables(spark, tmp_path):
    lake = tb.Lake(spark, str(tmp_path), {"x": "a bigint, batch_id bigint"})
    assert lake.safe("x") is None and lake.read("x").count() == 0
    assert lake.write(spark.range(3).withColumn("v", F.lit(None)), "t") == 3
    assert lake.write(lake.read("t").filter("id > 0"), "t") == 2          # replaced from its own rows
    assert lake.append(spark.range(2).withColumn("v", F.lit("z")), "t") == 2 and lake.safe("t").count() == 4
    tb.ensure_tables(spark, {"silver_x.facts": ("id bigint, day date", ["day"])})
    assert tb.safe_table(spark, "silver_x.facts") is None and tb.safe_table(spark, "silver_x.none") is None
    tb.write_table(spark.range(2), "silver_x.t2")
    tb.append_table(spark.range(2), "silver_x.t2")
    assert tb.safe_table(spark, "silver_x.t2").count() == 4
    tb.export_gold({"g": spark.range(5)}, f"{tmp_path}/gold")
    assert spark.read.parquet(f"{tmp_path}/gold/g").count() == 5
    assert tb.write_normalized(spark.range(4), spark.range(9), f"{tmp_path}/n") == {"frames": 4, "position_rows": 9}


def test_fan_out(spark):
    rows = [("s", "m", "frame", '{"t": 5, "seq": 1}'), ("s", "m", "late", '{"seq": 9, "reason": "late"}'), ("s", "m", "frame", '{"t": 6, "seq": 2}')]
    got = {}
    tb.fan_out(spark.createDataFrame(rows, "session_id string, match_id string, kind string, payload string"),
               {"frame": ("frames", "seq bigint, t bigint", {"t": "t_ms"}), "late": ("q", "seq bigint, reason string", {})},
               lambda d, n: got.update({n: sorted(map(tuple, d.collect()))}))
    assert got == {"frames": [("s", "m", 1, 5), ("s", "m", 2, 6)], "q": [("s", "m", 9, "late")]}


def test_soccer_payloads(spark):
    comp = lambda side, score, name: {"homeAway": side, "score": score, "team": {"displayName": name}}
    ev = [{"id": "1", "competitions": [{"status": {"displayClock": "45'", "type": {"description": "First Half"}}, "competitors": [comp("away", "2", "A"), comp("home", "1", "H")]}]},
          {"id": "2", "competitions": [{"status": {"displayClock": "90'", "type": {"description": "Full Time"}}, "competitors": [comp("home", "0", "H"), comp("away", None, "A")]}]},
          {"id": "3", "competitions": []}]
    df = lambda docs, s: spark.read.schema(s).json(spark.sparkContext.parallelize([json.dumps(x) for x in docs]))
    g = {r.game_id: r for r in payloads.soccer_games(df(ev, payloads.SOCCER_EVENT)).collect()}
    assert (g["1"].status_text, g["1"].home_score, g["1"].away_score) == ("First Half · 45'", 1, 2) and g["2"].status_text == "Full Time" and g["2"].away_score == 0 and "3" not in g
    who = lambda *n: [{"athlete": {"displayName": x}} for x in n]
    kev = lambda text, disp, val, *n: {"type": {"text": text}, "clock": {"displayValue": disp, "value": val}, "team": {"displayName": "H"}, "participants": who(*n)}
    s = {"game_id": "1", "keyEvents": [kev("Goal", "45'+2'", 2700.0, "P"), kev("Own Goal", "", 120.0, "Q"), kev("Substitution", "60'", None, "Out", "In"), kev("Kickoff", "1'", None)],
         "header": {"competitions": [{"competitors": [{"id": "h", "homeAway": "home", "linescores": [{"value": 1}, {"value": 0}]}, {"id": "a", "homeAway": "away", "linescores": [{"value": 2}]}]}]},
         "boxscore": {"teams": [{"team": {"id": "a"}, "statistics": [{"name": "shotsTotal", "displayValue": "4"}, {"name": "fouls", "displayValue": "9"}]}, {"team": {"id": "h"}, "statistics": [{"name": "totalShots", "displayValue": "7"}]}]},
         "commentary": [{"time": {"displayValue": "1'"}, "text": "off"}], "rosters": [{"team": {"displayName": "H"}, "formation": "4-4-2", "homeAway": "home", "roster": [{"athlete": {"displayName": "P"}, "jersey": "9", "position": {"abbreviation": "F"}, "starter": True}]}]}
    d = df([s], payloads.SOCCER_SUMMARY)
    assert [(r.type, r.minute, r.player, r.playerIn, r.playerOut) for r in sorted(payloads.soccer_events(d).collect(), key=lambda r: r.pos)] == [
        ("goal", 45, "P", None, None), ("goal", 2, "Q (OG)", None, None), ("substitution", 60, None, "In", "Out")]
    assert [tuple(r) for r in payloads.soccer_periods(d).collect()] == [("1", 1, 1, 2)]
    assert sorted(tuple(r) for r in payloads.soccer_stats(d).collect()) == [("1", "fouls", "0", "9"), ("1", "shots", "7", "0")]
    assert payloads.soccer_commentary(d).first().type == "" and payloads.soccer_lineups(d).first().color == "#888888"


def test_basketball_and_football_payloads(spark):
    df = lambda docs, s: spark.read.schema(s).json(spark.sparkContext.parallelize([json.dumps(x) for x in docs]))
    acts = [{"game_id": "g", "actionNumber": i, "clock": f"PT{11 - i % 12:02d}M30.00S", "period": 1, **({"x": 1.234, "y": 2.0} if i % 2 else {})} for i in range(40)]
    games = [{"gameId": "g", "gameStatusText": "Q1", "homeTeam": {"teamName": "H", "teamTricode": "HOM", "score": 3, "periods": [{"period": 1, "score": 3}]}, "awayTeam": {"teamName": "A", "teamTricode": "AWY", "score": 2, "periods": [{"period": 1, "score": 2}]}}]
    g = payloads.nba_games(df(games, payloads.NBA_GAME))
    assert [tuple(r) for r in payloads.nba_periods(df(games, payloads.NBA_GAME)).collect()] == [("g", 1, 3, 2)]
    other = spark.createDataFrame([("e", "AWY", "HOM")], "other_id string, code_a string, code_b string")
    gm = payloads.match_games(g, other)
    assert [tuple(r) for r in gm.collect()] == [("g", "e")]
    coords = payloads.usable_coords(spark.createDataFrame([("e", 1, "9:28", 5.0, 6.0, 1), ("e", 1, "9:32", 7.0, 8.0, 0), ("e", 1, "7:00", 1.0, 1.0, 2), ("e", 1, "5:30", -5000.0, 1.0, 3)],
                                                          "other_id string, period int, clock string, x double, y double, ord int"))
    p = {r.actionNumber: r for r in payloads.nba_plays(df(acts, payloads.NBA_ACTION), coords, gm).collect()}
    assert sorted(p) == list(range(10, 40)) and p[11].x == 1.23 and p[11].other_x is None
    assert (p[14].clock_text, p[14].other_x) == ("9:30", 7.0) and p[16].other_x is None       # equal distance: first in order
    pl = {"starter": "0", "played": "1", "side": "home", "game_id": "g", "name": "N", "position": "G", "statistics": {"minutes": "PT05M07.00S", "fieldGoalsMade": 2, "fieldGoalsAttempted": 5, "points": 4}}
    b = payloads.nba_box(df([pl, {**pl, "played": "0"}], payloads.NBA_PLAYER)).collect()
    assert len(b) == 1 and (b[0].minutes, b[0].fg, b[0].ft) == ("5:07", "2/5", "0/0")
    ts = spark.createDataFrame([("g", "home", {"fieldGoalsMade": 2.0, "fieldGoalsAttempted": 5.0, "fieldGoalsPercentage": 40.0, "assists": 3.0}), ("g", "away", {"assists": 9.0})], "game_id string, side string, statistics map<string,double>")
    s = {r.stat: (r.home, r.away) for r in payloads.nba_team_stats(ts).collect()}
    assert s["fieldGoals"] == ("2/5 (40.0%)", "0/0") and s["assists"] == ("3", "9")
    drive = lambda i, n: {"id": str(i), "team": {"displayName": "T", "abbreviation": "T"}, "plays": [{"id": f"{i}-{k}", "text": "t"} for k in range(n)]}
    d = df([{"game_id": "n", "drives": {"previous": [drive(i, 5) for i in range(12)], "current": drive(99, 3)}}], payloads.NFL_DRIVES_SCHEMA)
    assert sorted(r.id for r in payloads.nfl_drives(d).collect()) == sorted(str(i) for i in range(2, 12))
    ids = {r.id for r in payloads.nfl_plays(d).collect()}
    assert len(ids) == 40 and "99-2" in ids and "4-2" not in ids and "4-3" in ids
    box = spark.createDataFrame([("n", "home", [("yards", "10")]), ("n", "away", [("yards", "7"), ("sacks", "1")]), ("solo", "home", [("yards", "1")])], "game_id string, homeAway string, statistics array<struct<name:string,displayValue:string>>")
    assert sorted(tuple(r) for r in payloads.nfl_stats(box).collect()) == [("n", "sacks", "", "1"), ("n", "yards", "10", "7")]


def test_season_rows(spark):
    w = spark.createDataFrame([("A", "LAL", 5, 28.5, None)], "PLAYER_NAME string, TEAM_ABBREVIATION string, GP int, PTS double, REB double")
    r = payloads.nba_season_rows(w, "2025-26").first()
    assert json.loads(r.stats) == {"points": 28.5, "rebounds": 0.0} and r.games_played == 5
    doc = {"leaders": [{"name": "goals", "leaders": [{"value": 15.0, "athlete": {"displayName": "X", "team": {"displayName": "T", "abbreviation": "TT"}}}]}]}
    d = spark.read.schema(payloads.LEADERS).json(spark.sparkContext.parallelize([json.dumps(doc)]))
    assert json.loads(payloads.leader_rows(d, "epl", "2025").first().stats) == {"goals": "15.0"}
    r = payloads.leader_rows(d, "nfl", "2025", "passing", "abbreviation").first()
    assert r.team == "TT" and json.loads(r.stats)["category"] == "passing"


def test_question_clock_and_length(spark):
    """The minute that stands first counts, full-width digits are digits, and a long question is refused, not cut."""
    from touchline.functions import questions

    ask = ["show similar in the 30th minute, minute 45", "similar at minute 45 or the 30th minute", "moments similar to ２０：３０", "similar " + "x" * 600]
    r = [x.asDict() for x in questions.route(spark.createDataFrame([(q,) for q in ask], "question string")).collect()]
    assert [x["t_ms"] for x in r] == [1_800_000, 2_700_000, 1_230_000, None]
    assert [x["refusal_reason"] for x in r] == [None, None, None, "question too long"]


def test_analyst_arguments_out_of_range(spark):
    from touchline.plans import analyst

    with pytest.raises(ValueError, match="bucket_min"):
        analyst.team_shape_trend(spark.range(1), {}, bucket_min=90)


def test_a_replacement_that_stops_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    """The replacing run dies before its n-th file operation; the table is the old or the new version, and the next write tidies up."""
    import os

    from touchline.sinks.tables import Lake

    class Stop(Exception):
        pass

    for step in range(4):
        lake = Lake(spark, f"{tmp_path}/lake{step}")
        lake.write(spark.range(3).toDF("a"), "t")
        real, done = lake._hadoop, []

        class Files:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, what):
                def call(*args):
                    if what in ("rename", "delete"):
                        if len(done) == step:
                            raise Stop
                        done.append(what)
                    return getattr(self.fs, what)(*args)
                return call

        lake._hadoop = lambda path: (real(path)[0], Files(real(path)[1]))
        try:
            lake.write(spark.range(5).toDF("a"), "t")
            assert step == 3
        except Stop:
            assert step < 3
        again = Lake(spark, f"{tmp_path}/lake{step}")
        assert again.read("t").count() == (3 if step == 0 else 5)
        again.write(spark.range(7).toDF("a"), "t")
        assert again.read("t").count() == 7 and [f for f in os.listdir(f"{tmp_path}/lake{step}") if not f.startswith(".")] == ["t"]
