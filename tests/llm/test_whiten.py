"""Whitening against plain double and whole-number arithmetic."""
from __future__ import annotations

import math

import numpy as np
import pytest

from touchline.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def plain(rows, k=4):
    """(n, {row index: (deviation, projections up to sign)}, shares) the long way."""
    use = [(i, v) for i, v in rows if v is not None and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in use]
    fit = sorted(set(x))
    n = len(fit)
    s = [sum(v[j] for v in fit) for j in range(5)]
    f = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(f.T @ f / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), v in zip(use, x):
        dev = sum((n * v[j] - s[j]) ** 2 for j in range(5))
        out.append((i, dev, ((np.array(v) - np.array(s) / n) @ vectors[:, :k] / np.sqrt(values[:k])).tolist()))
    return n, out, (values / values.sum())[:k]


def rows_of(rng, n):
    spread = np.array([3.0, 2.0, 1.2, 0.7, 0.3])
    return [(i, (rng.normal(size=5) * spread + 1).astype(np.float32).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    made = rows_of(np.random.default_rng(4), 300)
    extra = [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0]), (302, [float("nan")] + [1.0] * 4), (303, [float("inf")] + [0.0] * 4),
             (304, [1.0, 2.0]), (305, []), (None, made[0][1]), (5, made[5][1]), (306, made[7][1]), (307, [-0.0, 0.0, -0.001, 0.001, 1.0])]
    return made + extra


def test_equals_plain_arithmetic(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "clash", 7) for i, v in rows], SCHEMA).repartition(5)
    got = whiten.whiten(df).collect()
    n, want, shares = plain(rows)
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} <= {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12
    signs = {}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    for i, dev, proj in want:
        for c in range(4):
            found = by[(i, dev)][c + 1]
            sign = signs.setdefault(c, math.copysign(1, found[0] * proj[c]) if abs(proj[c]) > 1e-6 else 1)
            assert all(math.isclose(w, sign * proj[c], rel_tol=1e-9, abs_tol=1e-9) for w in found)
    for r in got:
        assert math.isclose(r["explained"], shares[r["component"] - 1], rel_tol=1e-9)


def test_no_spread_no_rows_and_huge_entries(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out = whiten.whiten(same).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in out] == [(1, 0, None, None)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    out = whiten.whiten(line).collect()
    assert len(out) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in out)
    assert max(r["identity_error"] for r in out) < 1e-12
    huge = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [1e300, 0.0]), (4, [0.0, 5.0])], "vec_id long, embedding array<double>")
    out = whiten.whiten(huge).collect()
    assert {r["vec_id"] for r in out} == {1, 2, 4} and {r["n"] for r in out} == {3}
    assert [r["deviation"] for r in out if r["vec_id"] == 1] == [None, None]
    empty = whiten.whiten(huge.limit(0))
    assert empty.count() == 0 and empty.columns == whiten.whiten(huge).columns


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0], [3, 3 + 1e-9, 3 + 2e-9, 2, 1, 1e-12, 1e-12, 0], list(range(40)), [1] * 7, [1 + 1e-8 * i for i in range(12)]])
def test_clustered_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(len(values)).normal(size=(len(values),) * 2))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = ((a + a.T) / 2).astype(np.longdouble)
    e, x = whiten.refined_eigen(a)
    assert (np.diff(e) <= 1e-15 * max(values)).all()
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 2e-15
    assert float(np.abs(a @ x - x * e).max()) < 2e-15 * max(values)
    assert np.allclose(e, sorted(np.linalg.eigvalsh(a.astype(float)), reverse=True), rtol=0, atol=1e-13 * max(values))


def test_separated_by_the_sub_solves():
    """Two eigenvalues that 32 bits cannot tell apart still give their own vectors."""
    a = np.diag(np.array([2.0, 1 + 1e-10, 1.0, 0.5])).astype(np.longdouble)
    t = np.linalg.qr(np.random.default_rng(0).normal(size=(4, 4)))[0].astype(np.longdouble)
    for _ in range(3):                                  # orthogonal beyond double precision
        t = t @ (1.5 * np.eye(4) - t.T @ t / 2)
    e, x = whiten.refined_eigen(t @ a @ t.T)
    assert float(np.abs(np.abs(t.T @ x) - np.eye(4)).max()) < 1e-8
    plain32 = np.linalg.eigh((t @ a @ t.T).astype(np.float32))[1][:, ::-1]
    assert float(np.abs(np.abs(t.T @ plain32) - np.eye(4)).max()) > 1e-4


def test_products_are_exact_beyond_doubles():
    z = np.array([[2 ** 40, -3], [2 ** 30 + 1, 5], [7, 2 ** 52]], dtype=np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in z) for j in range(2)] for i in range(2)]
    assert whiten._exact_products(z).tolist() == want
