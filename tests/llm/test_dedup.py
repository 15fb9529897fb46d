"""Copies: tries, fingerprints and lines against brute force."""
from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import exact, lines, simhash, simlong
from touchline.llm.components import components

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), st.one_of(st.none(), st.integers(0, 9)))),
       st.sampled_from([600, 2000, 1 << 20]))
def test_trie_equals_a_dictionary(rows, budget):
    trie, want = exact.Trie(budget), defaultdict(list)
    for data, i in rows:
        trie.insert(data, i)
        want[data].append(i)
        if trie.full():
            trie.spill()
    got = list(trie.items())
    assert len(got) == len(want)
    for data, best, n, ties in got:
        ids = [i for i in want[data] if i is not None]
        assert (best, n) == (min(ids) if ids else None, len(want[data]))
        assert ties == want[data].count(best)


def test_small_budgets_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(exact.owners(docs)) == key(exact.owners(docs, budget=20_000))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_near_pairs_meet_in_a_bucket(x, flips):
    y = x ^ sum(1 << b for b in flips)
    seg = simhash.segments()
    met = False
    for s, chain in enumerate(simhash.CHAINS):
        head = chain[1][0]
        looked = {(x & head) ^ f for f in [0, *(1 << b for b in seg[(s + 1) % len(seg)])]}
        if y & head in looked:
            met |= bool(simhash._near(np.array([x ^ y], np.uint64), s)[0])
    assert met


def plain_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def cluster(rng, n):
    """Texts that are near copies of one another, many with fingerprints of their own."""
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    out = []
    for _ in range(n):
        v = list(words)
        v[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(v))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(cluster(rng, 150) + cluster(rng, 60))]
    fps = [plain_fingerprint(t) for _, t in rows]
    sets, u = Sets(), np.array(fps, np.uint64)
    for i in range(len(rows)):
        sets.find(i)
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= 4):
            sets.join(i, i + 1 + int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[sets.find(i)] = min(d, least.get(sets.find(i), d))
    want = sorted((d, f"{f:016x}", least[sets.find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, simhash.classes(docs).collect())) == want


def test_chain_of_links_is_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(w):
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_similarity_recall_and_clean_texts(spark):
    """Edited copies of similarity 0.8 and more go (at least 0.9 of them, 0.97 from 0.85 on); unrelated texts stay."""
    rng = random.Random(5)
    rows, near = [], []
    for i in range(160):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((i, " ".join(w)))
        v = list(w)
        for _ in range(rng.randrange(1, 5)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
        a, b = shingles(w), shingles(v)
        j = len(a & b) / len(a | b)
        if j >= 0.8:
            near.append((1000 + i, j))
            rows.append((1000 + i, " ".join(v)))
    kept = {r["doc_id"] for r in simlong.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(160)) <= kept
    assert sum(i not in kept for i, _ in near) >= 0.9 * len(near)
    closer = [i for i, j in near if j >= 0.85]
    assert sum(i not in kept for i in closer) >= 0.97 * len(closer)


def test_full_buckets_link_what_pairs_do():
    """A third fingerprint under the key changes nothing: only the limit over all bits counts."""
    import pyarrow as pa

    rng, most = np.random.default_rng(9), simlong.most_differing(0.8)
    for differing in (12, 30, most, most + 1):
        bits = rng.integers(0, 2, (3, simlong.BITS), np.uint8)
        bits[1] = bits[0]
        bits[1, 16:16 + differing] ^= 1                 # right after the window of ring 0, start 0
        bits[2, :16] = bits[0, :16]
        fp = np.packbits(bits, axis=1, bitorder="little").view("<u8").view(np.int64)
        for n in (2, 3):
            batch = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array(range(n)), *(pa.array(np.ascontiguousarray(fp[:n, i])) for i in range(simlong.WORDS))],
                                               names=["key", "node", *simlong.FIELDS])
            got = [(r["a"], r["b"]) for out in simlong.bucket_links(most)(iter([batch])) for r in out.to_pylist()]
            assert got == ([(0, 1)] if differing <= most else [])


def test_chains_find_what_no_window_does(spark):
    """19 bits that fall into every window of every ring, so that no window agrees: some word differs in at most 4 of them."""
    rng = random.Random(12)
    places = [[{simlong.STEPS[r] * i % simlong.BITS for i in range(16 * s, 16 * s + 16)} for s in range(simlong.STARTS)] for r in range(4)]
    windows = [w for ring in places for w in ring]
    while True:
        hit, left = [], list(windows)
        while left and len(hit) < 20:
            often = [sum(b in w for w in left) if sum(x // 64 == b // 64 for x in hit) < 5 else 0 for b in range(simlong.BITS)]
            hit.append(rng.choice([b for b in range(simlong.BITS) if often[b] == max(often)]))
            left = [w for w in left if hit[-1] not in w]
        if not left and len(hit) <= 19:
            break
    bits = np.random.default_rng(2).integers(0, 2, (3, simlong.BITS), np.uint8)
    bits[1] = bits[0]
    bits[1, hit] ^= 1
    fp = np.packbits(bits, axis=1, bitorder="little").view("<u8").view(np.int64).tolist()
    prints = spark.createDataFrame([(i, *f) for i, f in enumerate(fp)], "node long, w0 long, w1 long, w2 long, w3 long")
    assert [tuple(r) for r in simlong.candidates(prints, simlong.most_differing(0.8)).collect()] == [(0, 1)]


def edited(rng, w, least, most):
    """A copy of the words of similarity ``least`` to ``most``, that similarity."""
    while True:
        v = list(w)
        while True:
            v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            a, b = shingles(w), shingles(v)
            j = len(a & b) / len(a | b)
            if j <= most:
                break
        if j >= least:
            return v


def test_only_similar_texts_go(spark):
    """Texts of similarity 0.68 to 0.78 all stay; of those from 0.8 to 0.86 at least 0.9 go."""
    rng, rows = random.Random(6), []
    for i in range(160):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(edited(rng, w, *((0.68, 0.78) if i % 2 else (0.8, 0.86)))))]
    kept = {r["doc_id"] for r in simlong.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i % 2} | set(range(160)) <= kept
    assert sum(1000 + i not in kept for i in range(0, 160, 2)) >= 0.9 * 80


def test_refused_links_hide_no_others(spark):
    """Many texts that are candidates of each other, in groups of similar ones: each group keeps one."""
    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    for g in range(12):
        w = edited(rng, base, 0.76, 0.79)
        for k in range(6):
            rows.append((10 * g + k, " ".join(edited(rng, w, 0.95, 0.99) if k else w)))
    sets, of = Sets(), {i: shingles(t.split(" ")) for i, t in rows}
    for a in of:
        sets.find(a)
        for b in of:
            if a < b and len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
                sets.join(a, b)
    kept = [r["doc_id"] for r in simlong.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted({sets.find(i) for i in of}) and len(kept) > 6


def plain_lines(rows, similarity=0.8):
    norm = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    place = {}
    for i, t in rows:
        for k, s in enumerate(t.split("\n")):
            if norm(s):
                place.setdefault(norm(s), (i, k))
    keys, sets = list(place), Sets()

    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    words = [k.split(" ") for k in keys]
    bags = [set(w) for w in words]
    for i, a in enumerate(words):
        sets.find(i)
        for j in range(i + 1, len(keys)):
            b, most = words[j], max(len(a), len(words[j])) * (1 - similarity) + 1e-9
            # lines that differ in more words than edits are not worth the table
            if abs(len(a) - len(b)) <= most and max(len(bags[i] - bags[j]), len(bags[j] - bags[i])) <= most and edits(a, b) <= most:
                sets.join(i, j)
    first = {}
    for i, k in enumerate(keys):
        first[sets.find(i)] = min(place[k], first.get(sets.find(i), place[k]))
    stay = set(first.values())
    return {i: "\n".join(s for k, s in enumerate(t.split("\n")) if not norm(s) or (i, k) in stay) for i, t in rows}


def test_lines_equal_brute_force(spark):
    """Every run filed: exactly the groups of all pairs. Chosen runs: what else stays is at most a few lines in a thousand."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(50)}" for _ in range(90)]
    rows = []
    for i in range(120):                        # many lines of one block, alike but for a word or two
        v = list(base)
        for _ in range(rng.randrange(0, 3)):
            v[rng.randrange(90)] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(v) + "\n\n--\nThe same line. " + "\n" + f"own line number {rng.randrange(40)} !"))
    rows += [(200 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), plain_lines(rows)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(docs, shared=0).collect()} == want
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    count = lambda texts: sum(bool(x.strip()) for t in texts.values() for x in t.split("\n"))
    gone = count(dict(rows)) - count(want)
    assert count(want) <= count(got) <= count(want) + 0.01 * gone


def test_lines_of_five_to_forty_words_are_compared_by_edits_alone(spark):
    """Every line within a fifth of its words goes, whatever its fingerprint; none beyond that does."""
    rng, rows = random.Random(11), []
    for i in range(130):
        n = rng.randrange(5, 41)
        w = [f"w{rng.randrange(200)}" for _ in range(n)]
        v = list(w)
        for _ in range(n // 5 + (i % 5 == 0)):          # some are one edit too far
            at = rng.randrange(len(v))
            v[at:at + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [f"x{rng.randrange(10**6)}", v[at]], []])
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_lines(rows)
    assert sum(not t for t in want.values()) > 80
    assert got == want


def test_long_lines_meet(spark):
    rng, rows = random.Random(12), []
    for i, n in enumerate([215, 420, 900, 2500]):
        w = [f"w{rng.randrange(3000)}" for _ in range(n)]
        v = [x if j % 5 else f"x{rng.randrange(10**6)}" for j, x in enumerate(w)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {r["doc_id"]: r["n_kept"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 - i % 2 for i in range(8)}


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9])
def test_some_segment_of_the_longer_line_is_a_run_of_the_shorter(similarity):
    """The lengths of runs that lines take part with: each pair within the edits shares one."""
    by = lines.run_lengths(similarity)
    part = lambda m: {k for k, lo, hi in by if m >= lo and (hi is None or m <= hi)}
    for n in range(1, 1500):
        t = lines.edits(n, similarity)
        if t:
            fits = [k for k in part(n) if k <= n // (t + 1)]
            assert all(set(fits) & part(m) for m in range(n - t, n + 1))


@pytest.mark.parametrize("text", ["", "a b", "one two three four five six " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_lines_with_edits_spread_evenly_meet(spark):
    """A fifth of the words replaced, every fifth one: no run of five stands in both lines, whatever their length."""
    line = lambda i, n, turned: " ".join(f"x{i}e{j}" if turned and j % 5 == 4 else f"w{i}n{j}" for j in range(n))
    rows = [(2 * i + t, line(i, n, t)) for i, n in enumerate((30, 60, 100, 150, 190)) for t in (0, 1)]
    got = {r["doc_id"]: r["n_kept"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 1 - d % 2 for d, _ in rows}


def test_written_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from touchline.llm.util import CLEANUP, written

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, old = files(), spark.conf.get(CLEANUP)
    out = written(spark.range(20000).groupBy((F.col("id") % 999).alias("k")).count(), "shuffled")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == old
    assert out.count() == 999


def test_runs_in_slices_are_all_runs(spark):
    """Each run is in one slice, equal ones in the same, and no slice has most of them."""
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 40))) for _ in range(3))) for i in range(30)]
    words = lines.line_words(lines._documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    cut = [[tuple(r) for r in lines.runs(words, 0.8, 0, i, 4).collect()] for i in range(4)]
    assert sorted(sum(cut, [])) == sorted(tuple(r) for r in lines.runs(words, 0.8, 0).collect())
    assert max(map(len, cut)) < 0.5 * sum(map(len, cut))
    keys = [{r[0] for r in c} for c in cut]
    assert len(set().union(*keys)) == sum(map(len, keys))
