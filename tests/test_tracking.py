"""Movement metrics against closed forms, and the split plan against the plain plan."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import circle as circ
from touchline.functions import geometry as geo
from touchline.operators import ordered, tracking
from touchline.operators.joins import parity


@pytest.fixture(scope="module")
def result(circle):
    r = tracking.run_batch(circle["positions"], circle["frames"], circle["periods"], circle["teams"], circle["keepers"], tracking.SOCCER)
    return {k: v.cache() for k, v in r.items()}


def test_windows_are_those_of_the_periods(result):
    pw = result["player_window"]
    assert sorted(r[0] for r in pw.select("window").distinct().collect()) == [10000, 10001, 10002, 20000, 20001, 20002]
    assert pw.count() == pw.select("entity_id", "window").distinct().count() == 22 * 6
    tw = result["team_window"]
    assert tw.count() == tw.select("team_id", "window").distinct().count() == 12


def test_dwell_adds_up_to_active_time(result):
    a, n = result["player_window"].agg(F.sum("active_ms"), F.sum("no_cell_ms")).first()
    assert result["dwell"].agg(F.sum("dwell_ms")).first()[0] == a - n


def test_distance_is_speed_times_time(result):
    rows = {r["entity_id"]: r for r in result["player_window"].groupBy("entity_id").agg(
        F.sum("distance_m").alias("d"), F.sum("distance_raw_m").alias("raw"), F.sum("active_ms").alias("a")).collect()}
    for j in (3, 5, 14):
        r = rows[f"player:{j}"]
        assert r["d"] == pytest.approx(circ.speed(j) * r["a"] / 1000, rel=0.03)
        assert r["raw"] == pytest.approx(circ.speed(j) * r["a"] / 1000, rel=0.01)


def test_gap_is_excluded(result):
    g = {r["entity_id"]: r["g"] for r in result["player_window"].groupBy("entity_id").agg(F.sum("excluded_gap_ms").alias("g")).collect()}
    assert g["player:0"] == pytest.approx(3100, abs=100)
    assert all(v == 0 for k, v in g.items() if k != "player:0")


def test_possession_and_detection_split(result):
    r = result["player_window"].filter("entity_id = 'player:4'").agg(
        F.sum("active_ms").alias("a"), F.sum("in_poss_ms").alias("i"), F.sum("out_poss_ms").alias("o"),
        F.sum("poss_unknown_ms").alias("u"), F.sum("detected_ms").alias("d")).first()
    assert r["i"] + r["o"] + r["u"] == r["a"] and r["u"] == 0 and r["d"] == r["a"]
    assert result["player_window"].filter("entity_id = 'player:3'").agg(F.sum("detected_ms")).first()[0] == 0


def test_team_shape_matches_numpy(result, circle):
    f = result["team_frame"].filter("seq = 777 and team_id = 'team:away'").first()
    p = [(r.x_att, r.y_att) for r in circle["positions"].filter("seq = 777 and team_id = 'team:away' and entity_id <> 'player:11'").collect()]
    x, y = np.array(p).T
    assert f["n_outfield"] == 10 and f["sufficient"]
    assert f["width_m"] == pytest.approx(y.max() - y.min())
    assert f["depth_m"] == pytest.approx(x.max() - x.min())
    assert f["def_line_height_m"] == pytest.approx(np.sort(x)[:4].mean() + 52.5)
    assert f["hull_area_m2"] == pytest.approx(_shoelace_hull(p))


def _shoelace_hull(pts):
    """Area by the angle-sorted outline of points that lie on an edge with everything on one side."""
    edges = 0.0
    for a in pts:
        for b in pts:
            if a != b and all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > -1e-12 for c in pts):
                edges += a[0] * b[1] - a[1] * b[0]
    return edges / 2


def _corners(p):
    """Longest directed edges with every point on or left of them."""
    out = []
    for a in set(p):
        for b in set(p):
            side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in p]
            inside = [(c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0 for c in p]
            if a != b and all(s > 0 or (s == 0 and i) for s, i in zip(side, inside)):
                out.append((a, b))
    return out


def test_hull_special_cases():
    assert geo._hull_area([0, 1, 2, 3.0], [0, 1, 2, 3.0]) == 0
    rng = np.random.default_rng(0)
    for _ in range(200):
        p = [tuple(map(float, v)) for v in rng.integers(0, 6, (10, 2))]
        want = sum(max(a[0] * b[1] - a[1] * b[0], -1e9) for a, b in _corners(p))
        assert geo._hull_area(*zip(*p)) == pytest.approx(abs(want) / 2)
    assert geo._hull_area([0, 2, 2, 0, 1, 1, 0.0], [0, 0, 2, 2, 1, 0, 0.0]) == pytest.approx(4)


def test_split_plan_equals_plain_plan(circle, result):
    """The plan for entities with too many rows gives the same numbers."""
    iv = tracking.attribute_intervals(
        tracking.kinematics(circle["positions"], tracking.SOCCER, ordered.by_number("seq", 400)), circle["periods"], tracking.SOCCER)
    w = tracking.player_windows(iv, tracking.SOCCER)
    cols = ["distance_m", "active_ms", "hi_ms", "sprint_count", "accel_count", "decel_count", "max_speed_mps", "in_poss_ms", "excluded_gap_ms", "no_cell_ms"]
    row = parity(result["player_window"], w, ["entity_id", "window"], cols, rtol=1e-9, atol=1e-9).first().asDict()
    assert row["batch_rows"] == row["stream_rows"] == 132
    assert all(v == 0 for k, v in row.items() if k.startswith(("only", "diff")))


def _reference_walk(points, cfg):
    """Plain sequential model of one entity: smoothing, speed and sprint entries."""
    out, prev = [], None
    for t, x, y in points:
        if prev is None:
            prev = dict(t=t, x=x, y=y, sx=x, sy=y, v=None, spr=False, below=10**9)
            out.append((x, y, None, None, False))
            continue
        dt = t - prev["t"]
        ok = 0 < dt <= cfg.max_gap_ms and math.hypot(x - prev["x"], y - prev["y"]) / (dt / 1000) <= cfg.max_speed_player
        if not ok:
            prev.update(t=t, x=x, y=y, sx=x, sy=y, v=None)
            out.append((x, y, None, None, False))
            continue
        sx, sy = cfg.ema_alpha * x + (1 - cfg.ema_alpha) * prev["sx"], cfg.ema_alpha * y + (1 - cfg.ema_alpha) * prev["sy"]
        v = math.hypot(sx - prev["sx"], sy - prev["sy"]) / (dt / 1000)
        acc = None if prev["v"] is None else (v - prev["v"]) / (dt / 1000)
        fast = v >= cfg.sprint_speed
        entry = fast and not prev["spr"] and prev["below"] >= 1000
        below = 0 if fast else (0 if prev["spr"] else prev["below"]) + dt
        prev = dict(t=t, x=x, y=y, sx=sx, sy=sy, v=v, spr=fast, below=below)
        out.append((sx, sy, v, acc, entry))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_random_walk_matches_sequential_model(spark, split):
    """Breaks, jumps and bursts in random order over several blocks of 256 rows."""
    rng = np.random.default_rng(5)
    cfg = tracking.SOCCER
    t, x, y, pts = 0, 0.0, 0.0, []
    for i in range(1500):
        t += int(rng.choice([100, 100, 100, 100, 500, 600, 40]))
        v = 9.0 if (i // 37) % 4 == 0 else rng.uniform(0, 6)
        ang = rng.uniform(-0.2, 0.2) + i / 200
        x, y = x + v * 0.1 * math.cos(ang), y + v * 0.1 * math.sin(ang)
        if rng.random() < 0.004:
            x += 40
        pts.append((t, x, y))
    rows = [("s", "m", "p", "player", "a", i, tt, 1, xx, yy, xx, yy, True, None) for i, (tt, xx, yy) in enumerate(pts)]
    df = spark.createDataFrame(rows, "session_id string, match_id string, entity_id string, entity_type string, team_id string, seq bigint, "
                                     "t_ms bigint, period int, x_m double, y_m double, x_att double, y_att double, is_detected boolean, possession string")
    d = tracking.kinematics(df, cfg, ordered.by_number("seq", 300) if split else None).orderBy("seq").collect()
    want = _reference_walk(pts, cfg)
    assert sum(w[4] for w in want) > 3
    for r, (sx, sy, v, acc, entry) in zip(d, want):
        assert r["sx"] == pytest.approx(sx, abs=1e-9) and r["sy"] == pytest.approx(sy, abs=1e-9)
        assert (r["speed_mps"] is None) == (v is None) and (v is None or r["speed_mps"] == pytest.approx(v, abs=1e-7))
        assert (r["accel_mps2"] is None) == (acc is None) and (acc is None or r["accel_mps2"] == pytest.approx(acc, abs=1e-5))
        assert r["sprint_entry"] == entry


def test_basketball_frame(spark):
    """Regions of three attackers and the defender nearest to the ball."""
    rows = [("o1", "player", "off", 12.0, 0.0), ("o2", "player", "off", 13.0, 7.2), ("o3", "player", "off", 5.0, -3.0),
            ("d1", "player", "def", 1.0, 0.0), ("d2", "player", "def", 3.0, 4.0), ("ball", "ball", None, 0.0, 0.0)]
    pos = spark.createDataFrame([("s", "m", 0, *r, True) for r in rows],
                                "session_id string, match_id string, seq bigint, entity_id string, entity_type string, team_id string, x_m double, y_m double, is_detected boolean")
    pos = pos.withColumns({"x_att": F.col("x_m"), "y_att": F.col("y_m")})
    fr = spark.createDataFrame([("s", "m", 0, 0, 1, "off")], "session_id string, match_id string, seq bigint, t_ms bigint, period int, possession string")
    teams = spark.createDataFrame([("m", "off"), ("m", "def")], "match_id string, team_id string")
    gk = spark.createDataFrame([], "match_id string, entity_id string")
    r = {x["team_id"]: x for x in tracking.team_frames(pos, fr, gk, tracking.BASKETBALL, teams, hooks=[tracking.SPACING]).collect()}
    assert (r["off"]["paint_count"], r["off"]["corner_count"], r["off"]["offense"]) == (1, 1, True)
    assert r["def"]["nearest_def_to_ball_m"] == 1.0 and r["def"]["paint_count"] is None


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.35, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("chunked", [False, True])
def test_smoothing_for_every_alpha(spark, alpha, chunked):
    """Against the recurrence, over long segments and short ones."""
    from touchline.operators import ordered, tracking

    rows = [("a", i, i % 1700 == 0 or i in (1800, 1803), 1000.0 + 50 * math.sin(i / 7) + i % 13) for i in range(4000)]
    df = spark.createDataFrame(rows, "entity string, seq bigint, segment_start boolean, x double")
    chunk = ordered.by_number("seq", 1500) if chunked else None
    got = {r.seq: r.s for r in tracking.ema(df, alpha, ["entity"], "seq", {"x": "s"}, chunk=chunk).collect()}
    s = 0.0
    for _, i, start, x in rows:
        s = x if start else alpha * x + (1 - alpha) * s
        assert got[i] == pytest.approx(s, rel=1e-9), i


def test_hooks_are_callables(spark, circle):
    """A sport's own measure, registered without touching the engine."""
    high = tracking.Hook("reach", lambda: {"_far": F.max("x_att")}, lambda d, pos, key: d.withColumn("reach", F.col("_far") + 1.0))
    args = (circle["positions"], circle["frames"], circle["keepers"], tracking.SOCCER, circle["teams"])
    d = tracking.team_frames(*args, hooks=[high]).filter("n_outfield > 0")
    assert "_far" not in d.columns and "mel_ms" in d.columns and d.filter("reach is null").count() == 0
    try:
        tracking.register_hook("handball", high)
        tracking.register_hook("handball", high)
        assert tracking.HOOKS["handball"] == [high]
    finally:
        tracking.HOOKS.pop("handball", None)


def test_carry_backward_keeps_one_running_value(spark):
    """A frame to the last row is computed anew for every row; the carry must not need one, hot or not."""
    from touchline.operators import ordered

    rows = [("a", i, i if i % 4 == 3 else None) for i in range(50)] + [(None, 1, None), (None, 2, 7)]
    d = spark.createDataFrame(rows, "k string, i int, v int")
    for chunk in (None, F.floor(F.col("i") / 7)):
        out = ordered.carry_backward(d, "v", "next", ["k"], ["i"], chunk)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        want = {("a", i): next((j for j in range(i, 50) if j % 4 == 3), None) for i in range(50)} | {(None, 1): 7, (None, 2): 7}
        assert {(r.k, r.i): r.next for r in out.collect()} == want
