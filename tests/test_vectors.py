from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import changes, moments, sections, vectors


def brute(q, c, k):
    out = {}
    for i, v in enumerate(q):
        d = ((c - v) ** 2).sum(1)
        out[i] = [(int(j), math.sqrt(d[j])) for j in np.lexsort((np.arange(len(c)), d))[:k]]
    return out


@pytest.mark.parametrize("copies", [False, True])
def test_knn_join_is_exact(spark, copies):
    """Clustered data with pruning, small blocks; with a third of all rows being copies of one vector."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 10, (6, 8))
    c = np.concatenate([m + rng.normal(0, 0.5, (60, 8)) for m in centers])
    if copies:
        c[::3] = c[0]
    q = np.concatenate([c[5:40:7], rng.normal(0, 10, (5, 8))])
    mk = lambda a, n: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], f"{n} bigint, vec array<double>")
    got = vectors.knn_join(mk(q, "qid"), mk(c, "cid"), 7, cells=5, leaf=10, block_rows=20, query_rows=4).collect()
    want = brute(q, c, 7)
    for i in want:
        rows = sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])
        assert [r.cid for r in rows] == [w[0] for w in want[i]]
        assert [r.distance for r in rows] == pytest.approx([w[1] for w in want[i]], abs=1e-9)


def test_knn_join_fewer_rows_than_k_and_empty(spark):
    mk = lambda a, n: spark.createDataFrame(a, f"{n} bigint, vec array<double>")
    assert vectors.knn_join(mk([(1, [0.0])], "qid"), mk([(1, [1.0]), (2, [3.0])], "cid"), 5, cells=2, leaf=1).count() == 2
    assert vectors.knn_join(mk([(1, [0.0])], "qid"), mk([], "cid"), 5).count() == 0


def _clusters(spark, many=40, each=60):
    rng = np.random.default_rng(8)
    c = np.concatenate([m + rng.normal(0, 0.2, (each, 6)) for m in rng.normal(0, 30, (many, 6))])
    q = c[::37] + rng.normal(0, 0.05, (len(c[::37]), 6))
    mk = lambda a, n: spark.createDataFrame([("g", i, [float(x) for x in v]) for i, v in enumerate(a)], f"g string, {n} bigint, vec array<double>")
    return q, c, mk(q, "qid"), mk(c, "cid")


def test_a_query_reaches_only_what_its_bound_allows(spark):
    """On clusters nearly all blocks are ruled out, and no block's vectors are sent more than once for one search."""
    from touchline.operators import balls

    q, c, queries, corpus = _clusters(spark)
    index = balls.build(corpus, 5, cells=12, leaf=20, block_rows=30)
    assert index.points.count() == len(c) and index.blocks.agg({"n": "sum"}).first()[0] == len(c)
    blocks = index.blocks.count()
    assert blocks >= 80 and index.blocks.agg({"n": "max"}).first()[0] <= 30
    allowed = balls.routes(index, queries, 5).count()
    one, rest = balls.rounds(index, queries, 5)
    assert allowed <= 0.25 * blocks * len(q) and rest.count() <= 0.03 * blocks * len(q)
    assert one.groupBy("qid").count().agg({"count": "max"}).first()[0] == 5
    held, streamed = balls._sliced(index.points, queries.withColumns({"cell": F.lit(0), "sub": F.lit(1), "part": F.lit("0-0")}), balls.BLOCK, 20_000)
    assert held.count() <= 30
    want = brute(q, c, 5)
    got = balls.nearest(index, queries, 5).collect()
    assert {(r.qid, r["rank"], r.cid) for r in got} == {(i, n + 1, j) for i in want for n, (j, _) in enumerate(want[i])}


def test_a_query_is_sent_once_to_each_bin(spark):
    """Where bounds rule nothing out, what is moved grows with the bins, not with the blocks."""
    from touchline.operators import balls

    rng = np.random.default_rng(5)
    c = rng.normal(0, 1, (600, 16))
    mk = lambda n: spark.createDataFrame([("g", i, [float(x) for x in v]) for i, v in enumerate(c)], f"g string, {n} bigint, vec array<double>")
    index = balls.build(mk("cid"), 3, cells=4, leaf=10, block_rows=16, bin_rows=150)
    bins = index.blocks.select("bin").distinct().count()
    assert index.blocks.count() > 40 and 3 <= bins <= 5
    assert balls.routes(index, mk("qid"), 3).count() <= bins * len(c)
    want = brute(c, c, 3)
    got = balls.nearest(index, mk("qid"), 3).collect()
    assert {(r.qid, r["rank"], r.cid) for r in got} == {(i, n + 1, j) for i in want for n, (j, _) in enumerate(want[i])}


def test_plan_has_no_cross_join_and_no_copies(spark):
    from touchline.operators import balls

    _, _, queries, corpus = _clusters(spark, 6, 30)
    plan = vectors.knn_join(queries, corpus, 3, by="g", cells=4, leaf=10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="fewer than"):
        balls.nearest(balls.build(corpus, 2), queries, 3)


def test_copies_cost_one_vector(spark):
    """A third of all rows are one vector: it is kept once, with the smallest ids, and ties go by id."""
    from touchline.operators import balls

    rows = [("g", i, [0.0, 1.0] if i % 3 == 0 else [float(i), 2.0]) for i in range(900)]
    corpus = spark.createDataFrame(rows, "g string, cid bigint, vec array<double>")
    index = balls.build(corpus, 4, leaf=50, block_rows=60)
    assert index.points.count() == 601
    got = balls.nearest(index, spark.createDataFrame([(2**62 + 1, "g", [0.0, 1.0]), (2, "h", [0.0, 1.0])], "qid bigint, g string, vec array<double>"), 4).collect()
    assert [(r.qid, r.cid, r.distance) for r in sorted(got, key=lambda r: r["rank"])] == [(2**62 + 1, c, 0.0) for c in (0, 3, 6, 9)]


def test_bounds_hold_where_rounding_is_large():
    from touchline.operators import balls

    rng = np.random.default_rng(2)
    v = rng.normal(1e6, 1e-3, (40, 16))
    low, far = balls.gaps(v, v[:10])
    exact = np.sqrt(((v[:, None] - v[None, :10]) ** 2).sum(-1))
    assert (low <= exact).all() and (exact <= far).all()


def test_suppression_and_pool_bound(spark):
    rng = np.random.default_rng(1)
    cand = [(q, i, int(i // 200), (i % 200) * 2, float(rng.random())) for q in range(3) for i in range(400)]
    df = spark.createDataFrame(cand, "qid int, cid int, period int, sec int, distance double")
    got = vectors.suppress(df, ["qid"], "distance", "period", "sec", "cid", 5, 30).collect()
    for q in range(3):
        kept = []
        for _, cid, p, s, d in sorted((x for x in cand if x[0] == q), key=lambda x: x[4]):
            if len(kept) < 5 and not any(p == a and abs(s - b) < 30 for _, a, b in kept):
                kept.append((cid, p, s))
        assert [r.cid for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == [k[0] for k in kept]
    # the worst case for the pool: all nearest candidates crowd around k-1 places
    assert vectors.pool_size(5, 30, 2) == 29 * 5 + 1


def _seconds(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for period in (1, 2):
        for s in range(n):
            if s % 37 == 5:
                continue
            sec = (period - 1) * 1000 + s
            phase = (s // 40) % 2
            for team in ("a", "b"):
                mine = (team == "a") == (phase == 0)
                rows.append(("m", period, sec, team, sec * 1000, float(30 + 10 * mine + rng.normal()), float(20 + rng.normal()), 1.0 if mine else 0.0))
    return spark.createDataFrame(rows, "match_id string, period int, sec bigint, team_id string, t_ms bigint, width_m double, depth_m double, poss_share double"), rows


def test_moments_match_brute_force(spark):
    df, rows = _seconds(spark)
    idx = moments.build_index(df, ["match_id"], ["a", "b"], ["width_m", "depth_m"]).cache()
    # the same index in plain numpy
    data = {(p, s, t): (w, d, q) for _, p, s, t, _, w, d, q in rows}
    vecs, keys, labels = [], [], []
    for p in (1, 2):
        secs = sorted({s for pp, s, _ in data if pp == p})
        for a in range(secs[0] + 9, secs[-1] + 1, 2):
            w = [s for s in secs if a - 10 < s <= a]
            if len(w) < 8:
                continue
            v = []
            for t in ("a", "b"):
                for f in (0, 1):
                    x = [data[p, s, t][f] for s in w]
                    v += [np.mean(x), np.mean(x[-3:]) - np.mean(x[:3])]
            new = [s for s in w if s > max(w) - 3]
            labels.append(next((t for t in ("a", "b") if np.mean([data[p, s, t][2] for s in new]) >= 0.6), None))
            vecs.append(v)
            keys.append((p, a))
    X = np.array(vecs)
    X = (X - X.mean(0)) / X.std(0)
    got = {(r.period, r.anchor): r for r in idx.collect()}
    assert sorted(got) == sorted(keys)
    for k, v, l in zip(keys, X, labels):
        assert got[k].vec == pytest.approx(v.tolist(), abs=1e-9) and got[k].label == l

    def near(i, k):
        d = np.linalg.norm(X - X[i], axis=1)
        kept = []
        for j in np.argsort(d, kind="stable"):
            far = lambda m: keys[j][0] != keys[m][0] or abs(keys[j][1] - keys[m][1]) >= 30
            if len(kept) < k and far(i) and all(far(m) for m in kept):
                kept.append(int(j))
        return kept
    i = max(n for n, k in enumerate(keys) if k[0] == 1 and k[1] * 1000 <= 100_000)
    sim = moments.similar_moments(idx, {"match_id": "m"}, 100_000, 5).orderBy("rank").collect()
    want = near(i, 5)
    assert [(r.period, r.t_ms // 1000) for r in sim] == [keys[j] for j in want]
    scale = np.median(np.linalg.norm(X - X.mean(0), axis=1))
    assert [r.similarity for r in sim] == pytest.approx([math.exp(-np.linalg.norm(X[j] - X[i]) / scale) for j in want], abs=6e-4)
    assert moments.similar_moments(idx, {"match_id": "no such match"}, 100_000, 5).count() == 0
    hits = tot = 0
    lab = [n for n, l in enumerate(labels) if l]
    for n in lab:
        nb = [j for j in near(n, 9) if labels[j]][:3]
        hits, tot = hits + sum(labels[j] == labels[n] for j in nb), tot + len(nb)
    share = [sum(labels[n] == t for n in lab) / len(lab) for t in ("a", "b")]
    r = moments.lift(idx, 3).first()
    assert r.labelled == len(lab) and r.status == "ok"
    assert r.precision_same_possession == pytest.approx(hits / tot, abs=6e-4)
    assert r.lift == pytest.approx(hits / tot / sum(s * s for s in share), abs=2e-3)


def test_segmentation_is_optimal():
    """Against every possible segmentation of a short series."""
    rng = np.random.default_rng(0)
    for trial in range(6):
        z = np.concatenate([rng.normal(m, 1, (n, 2)) for m, n in ((0, 5), (4 * (trial % 2), 6), (0, 5))])
        n, pen = len(z), 3.0
        cost = lambda a, b: ((z[a:b] - z[a:b].mean(0)) ** 2).sum() + pen
        best = min((sum(cost(a, b) for a, b in zip((0, *cut), (*cut, n))), (*cut, n))
                   for r in range(4) for cut in itertools.combinations(range(4, n - 3), r)
                   if all(b - a >= 4 for a, b in zip((0, *cut), (*cut, n))))
        assert tuple(changes.segment(z, 4, pen)) == best[1]


def test_change_points(spark):
    rows = [("m", t, 1, s, s * 1000, (30.0 if s < 300 else 45.0) + (s % 7) * 0.1, 20.0 + (s % 5) * 0.1) for t in ("a", "b") for s in range(600) if not 100 <= s < 120]
    df = spark.createDataFrame(rows, "match_id string, team_id string, period int, sec bigint, t_ms bigint, width_m double, depth_m double")
    r = changes.change_points(df, ["match_id", "team_id", "period"], ["width_m", "depth_m"]).orderBy("team_id").collect()
    assert [(x.team_id, x.t_ms) for x in r] == [("a", 300_000), ("b", 300_000)]
    assert r[0].features[0] == "width_m" and r[0].deltas[0] == pytest.approx(15, abs=0.2) and r[0].after_to_ms == 600_000


def _sections_model(rms, frame_s=4.0):
    """Sequential model of the section rules."""
    e = list(rms)
    if len(e) >= 3:
        p = [0.0, *e, 0.0]
        e = [(p[i] + p[i + 1] + p[i + 2]) / 3 for i in range(len(e))]
    top = max(e)
    if top < 1e-10:
        return [("silence", 0.0, len(e) * frame_s, "low")]
    e = [x / top for x in e]
    cuts = [0]
    for i in range(1, len(e) - 1):
        if abs(e[i + 1] - e[i]) > 0.15 and i - cuts[-1] >= 2:
            cuts.append(i)
    cuts.append(len(e))
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        m, pos = sum(e[a:b]) / (b - a), i / max(len(cuts) - 2, 1)
        trend = e[b - 1] - e[a] if b - a >= 2 else 0
        lab = ("intro" if pos < 0.15 and m < 0.4 else "outro" if pos > 0.85 and m < 0.4 else "drop" if m >= 0.65 else "buildup" if trend > 0.1
               else "breakdown" if m < 0.4 and 0.2 < pos < 0.8 else "buildup" if m >= 0.4 else "breakdown")
        out.append((lab, a * frame_s, min(b * frame_s, len(e) * frame_s), "low" if m < 0.3 else "medium" if m < 0.65 else "high"))
    return out


@pytest.mark.parametrize("chunk_rows", [2, 3, 7, 4096])
def test_sections_match_model(spark, chunk_rows):
    rng = np.random.default_rng(9)
    tracks = {"club": [0.1] * 6 + [0.9] * 10 + [0.3] * 5 + [0.95] * 8 + [0.1] * 4, "silent": [0.0] * 5, "short": [0.5, 0.6], "noise": list(rng.random(60))}
    rows = [(k, i, float(v)) for k, x in tracks.items() for i, v in enumerate(x)]
    d = sections.sections(spark.createDataFrame(rows, "track_id string, frame_idx int, rms double"), chunk_rows=chunk_rows).collect()
    for k, x in tracks.items():
        got = [(r.label, r.start_sec, r.end_sec, r.energy_level) for r in sorted((r for r in d if r.track_id == k), key=lambda r: r.section)]
        assert got == _sections_model(x), k


def test_topk_threshold_and_rerank(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], [1.0, 0.0]), ("b", [0.8, 0.6], [0.0, 1.0]), ("c", [-1.0, 0.0], [1.0, 0.0]), ("z", [0.0, 0.0], [0.0, 0.0])],
                               "track_id string, audio array<float>, text_vec array<float>")
    assert [(r.track_id, round(r.score, 6)) for r in vectors.vector_topk(df, [2.0, 0.0], "audio").collect()] == [("a", 1.0), ("b", 0.8)]
    r = vectors.rerank(df, [1.0, 0.0], [0.0, 1.0], 2).collect()
    assert [x.track_id for x in r] == ["b", "a"]
    assert r[0].combined == pytest.approx(0.9 * (0.7 * 0.8 + 0.3) + 0.1 * 0.5)
