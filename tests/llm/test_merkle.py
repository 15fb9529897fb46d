"""The Merkle manifest against trees built one digest at a time."""
from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from touchline.llm import merkle

H = lambda *xs: sha256("".join(xs).encode()).hexdigest()


def code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(*map(code, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        out.append((run[:i % 8], run[i % 8 + 1:]))
        i //= 8
    return out


def plain(rows):
    lower = {ord(c): c.lower() for c in merkle.UPPER}
    of, langs = {}, sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        of[g] = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r) for r in rows if r["lang"] == g], key=lambda x: x[:3])
    trees = {g: levels([x[2] for x in of[g]]) for g in langs}
    forest = levels([trees[g][-1][0] for g in langs]) if langs else None
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, h, r) in enumerate(of[g]):
            steps = path(trees[g], i) + path(forest, k)
            f = h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                f = leaf(r, r["text"].translate(lower))
            for before, after in steps:
                f = H(*before, f, *after)
            proof = H(*[x for before, after in steps for x in before + after])
            out.append((r["doc_id"], h, trees[g][-1][0], forest[-1][0], proof, f, f == forest[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, h string, place string, r long, n long, path string"


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "x", "y", "z", 1, 2, "p") for r in rows], SCHEMA)


def made(sizes):
    """Languages with the given numbers of rows; ids are dealt among them, so ranks have gaps in the ids."""
    rows, i = [], 0
    for g, size in sizes.items():
        for _ in range(size):
            rows.append({"doc_id": (i * 7919) % 100_003, "source": [None, "a", ""][i % 3], "lang": g, "n_chars": i, "text": f"Text {i} Ünï" if i % 5 else None})
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {None: 7, "": 64, "en": 65, "é": 3},
                                   {"en": 1300, "de": 512, "fr": 513, None: 1}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_equals_plain_trees(spark, sizes):
    rows = made(sizes)
    got = merkle.tampered_proofs(frame(spark, rows))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(plain(rows), key=key)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [{"doc_id": d, "source": s, "lang": g, "n_chars": n, "text": t} for d, s, g, n, t in [
        (1, "a", "en", 1, "A"), (1, "a", "en", 1, "A"), (1, "b", "en", 1, "B"), (None, None, None, None, None), (None, "x", "en", 0, "Q"),
        (9, "a", "en", 5, ""), (3, "a", None, 2, "ABC abc"), (-4, "a", "en", 7, "Long " * 200_000)]]
    got = merkle.tampered_proofs(frame(spark, rows))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(plain(rows), key=key)
    empty = merkle.tampered_proofs(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_untouched_rows_verify(spark):
    rows = made({"en": 600})
    out = merkle.proofs(frame(spark, rows)).collect()
    assert len(out) == 600 and all(r["verified"] and r["folded_root"] == r["root"] for r in out)


def test_one_language_of_many_rows_is_dealt_out(spark):
    rows = made({"en": 3000})
    placed = merkle.numbered(frame(spark, rows).select("lang", "doc_id"), "lang", ["doc_id"])
    order = [r["doc_id"] for r in placed.orderBy("r").collect()]
    assert order == sorted(r["doc_id"] for r in rows) and placed.select("r").distinct().count() == 3000
    assert {r["n"] for r in placed.select("n").distinct().collect()} == {3000}


def test_no_join_but_with_the_counts(spark):
    """Digests and proofs come from grouping and exploding; the one join adds the counts of tasks to ranks."""
    out = merkle.tampered_proofs(frame(spark, made({"en": 700, "de": 10})))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" in plan
