"""SimHash near-duplicates at a similarity: long fingerprints around the same ring.

Sets of five-word shingles of Jaccard similarity 0.8 differ in about 15 % of SimHash bits (the angle between them is
acos(2 J / (1 + J))). In 64 bits that is too blurred to tell from less similar texts, so here a fingerprint has 256
bits, a ring of 64 segments of 4; it is a candidate with another if at most ``most_differing(0.8, SIGMAS)`` bits differ.
Candidates with differing fingerprints are linked only if the shingles of the first text of each have the similarity: it
is counted exactly. The bits are put
around the ring in four orders, so that chances of a start do not hang together. A pair is looked for where four
segments in a row agree, from any of 16 starts of each ring; then all bits are compared, however many fingerprints meet
there. Each of the four words is a fingerprint of 64 bits of its own, and is also looked for by chains of segments (``simhash``),
which find every word that differs in at most 4 bits: so a pair that differs in at most 19 bits, hence in at most 4 of some
word, is a candidate for certain, where windows alone promise 15. What four agreeing segments miss beyond is measured, not guessed: see ``tests/llm`` and
the README. Within a bucket only links that span it are tried first; where refused ones leave what candidates hold together in
parts, members are tried with the most typical ones around them, and then every pair of parts that can be similar is looked
for by a prefix filter on the sets, so that no refused link hides another. Only wide windows keep buckets small as the corpus grows: ``head`` is a parameter.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import simhash
from touchline.llm.components import components
from touchline.llm.util import drop_written, text_of, written

WORDS = 4
BITS = 64 * WORDS
SEGMENT = 4
RING = BITS // SEGMENT                          # segments around a ring
HEAD = 4                                        # agreeing segments that make a bucket
STARTS = RING // HEAD                           # of each ring
STEPS = (1, 37, 73, 151)                        # odd, so each step meets every bit once: the rings' orders
HASHES = 4                                      # orders of shingles under which texts that stay apart meet
SIGMAS = 3.0                                    # standard deviations of the bits of a pair that is just similar enough
# odd multipliers that spread one shingle hash over four words
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def most_differing(similarity: float, sigmas: float = 1.5) -> int:
    """Bits that may differ: what a pair of that Jaccard similarity is expected to, and some standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * p + sigmas * math.sqrt(BITS * p * (1 - p)))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles; a text of fewer words is one shingle. No word: none."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = [(0, len(joined))] if len(words) <= width else zip(starts, ends[width - 1:])
    return np.array(list({digest(joined[a:b]) for a, b in spans}), np.uint64)


def fingerprint(text: str, width: int = 5) -> np.ndarray:
    """Four words; a bit is set if it is in over half of the distinct shingles' hashes. No word: all zero."""
    hashes, counts = shingles(text, width), np.zeros(BITS, np.int64)
    if not hashes.size:
        return np.zeros(WORDS, np.uint64)
    for i in range(0, hashes.size, 1 << 13):
        h = hashes[i:i + (1 << 13), None] * SPREAD
        h ^= h >> np.uint64(29)
        h *= SPREAD[::-1]
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > hashes.size, bitorder="little").view("<u8")


FIELDS = [f"w{i}" for i in range(WORDS)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, text_hash, w0..w3 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(WORDS))],
                                             names=["doc_id", "text_hash", *FIELDS])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                      text_of(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id long, text_hash long, {', '.join(f'{f} long' for f in FIELDS)}")


def _bits_of(fp: np.ndarray, at: int, n: int) -> np.ndarray:
    """``n`` bits (at most 64) of each fingerprint from bit ``at`` on, going around the ring."""
    w, r = (at // 64) % WORDS, np.uint64(at % 64)
    low = fp[:, w] >> r
    if at % 64 + n > 64:
        low = low | fp[:, (w + 1) % WORDS] << np.uint64(64 - at % 64)
    return low & np.uint64((1 << n) - 1) if n < 64 else low


def on_ring(fp: np.ndarray, ring: int) -> np.ndarray:
    """The fingerprints with their bits in a ring's order."""
    bits = np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
    order = np.arange(BITS) * STEPS[ring] % BITS
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u8").reshape(-1, WORDS)


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under each of its windows: key = ring, start and the window's bits."""
    for b in batches:
        fp = np.stack([b.column(f).to_numpy().view(np.uint64) for f in FIELDS], axis=1)
        for r in range(len(STEPS)):
            turned = on_ring(fp, r)
            for s in range(STARTS):
                key = (np.uint64(r * STARTS + s) << np.uint64(48) | _bits_of(turned, s * SEGMENT * HEAD, SEGMENT * HEAD)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", "node", *FIELDS])


def spanning_links(fp: np.ndarray, node: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, nodes): links that join what is linked within one bucket; each step takes out all that the current one reaches."""
    rest = np.arange(node.size)
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]).sum(axis=1, dtype=np.int64) <= most
            found = rest[near]
            if found.size:
                yield int(node[x]), node[found]
                queue += found.tolist()
                rest = rest[~near]


def bucket_links(most: int):
    """(a, b) from rows sorted by key: the links of each bucket. Holds one bucket and one batch at a time."""
    names = ["a", "b"]

    def links(key, node, fp):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, key.size])
        two = first[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1, dtype=np.int64) <= most]
        out = [(node[two], node[two + 1])]
        for i, n in zip(first[size > 2], size[size > 2]):
            for x, ys in spanning_links(fp[i:i + n], node[i:i + n], most):
                out.append((np.full(ys.size, x), ys))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WORDS), np.uint64))
        for b in batches:
            new = (b.column("key").to_numpy(), b.column("node").to_numpy(),
                   np.stack([b.column(f).to_numpy().view(np.uint64) for f in FIELDS], axis=1))
            rows = tuple(np.concatenate(x) for x in zip(held, new))
            if not rows[0].size:
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))        # the last bucket may go on
            if cut:
                yield links(*(r[:cut] for r in rows))
            held = tuple(r[cut:] for r in rows)
        if held[0].size:
            yield links(*held)

    return run


def chain_links(prints: DataFrame, word: str) -> DataFrame:
    """(a, b): links that join all (node, w0..w3) whose ``word`` differs in few enough bits, found by chains of segments around its ring."""
    reps = written(prints.groupBy(F.col(word).alias("fp")).agg(F.min("node").alias("rep")), "simlong-words")
    near = simhash.links(reps.select("fp")).distinct()
    near = near.join(reps.toDF("a", "rep_a"), "a").join(reps.toDF("b", "rep_b"), "b").select("rep_a", "rep_b")
    equal = prints.join(reps, F.col(word) == F.col("fp")).filter("node <> rep").select("rep", "node")
    out = written(near.union(equal).toDF("a", "b"), "simlong-chains")
    drop_written(reps)
    return out


def candidates(prints: DataFrame, most: int) -> DataFrame:
    """(a, b), the smaller first: links between distinct (node, w0..w3) that share a window and differ in at most ``most`` bits, or
    whose words' chains meet."""
    rows = prints.mapInArrow(keyed, f"key long, node long, {', '.join(f'{f} long' for f in FIELDS)}")
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
        bucket_links(most), "a long, b long")
    chains = [chain_links(prints, f) for f in FIELDS]
    found = reduce(DataFrame.union, chains, found)
    out = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simlong-tried")
    for done in chains:
        drop_written(done)
    return out


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles): the distinct shingles' hashes of the first text of each given (node, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in b.column("text")]
            ends = np.cumsum([0, *(s.size for s in sets)])
            values = pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["node", "shingles"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    at = nodes.select("node", F.col("place.doc_id").alias("p_id"), F.col("place.text_hash").alias("p_hash"))
    src = src.join(at, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_hash"))).select("node", "text")
    return src.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) whose sets of shingles are at least that similar."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both, of_a, of_b = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a"), F.size("of_b")
    return pairs.join(a, "a").join(b, "b").filter(F.least(of_a, of_b) >= similarity * F.greatest(of_a, of_b) - 1e-9) \
        .filter(both >= similarity * (of_a + of_b - both) - 1e-9).select("a", "b")


def _apart(of_candidates: DataFrame, root: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of what candidate links hold together and verified ones do not: of_candidates and root are components (node, root)."""
    with_both = nodes.join(of_candidates.toDF("node", "cluster"), "node", "left").join(root, "node", "left") \
        .select("node", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("root", "node").alias("root"))
    apart = with_both.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cluster")
    return with_both.join(apart, "cluster").select("node", "root")


def _central(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with the most typical ones around it, whose shingles most others have: what copies were made from.

    Members meet under the least of their shingles in each of ``HASHES`` orders, as sets of similarity 0.8 do in four of five.
    """
    members = sets.join(apart, "node").filter("size(shingles) > 0")
    rows = members.select("node", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    typical = rows.join(often, "s").groupBy("node").agg(F.avg("df").alias("typical"))
    least = [F.struct(F.lit(i).alias("i"), F.array_min(F.transform("shingles", lambda x, i=i: F.xxhash64(x, F.lit(i)))).alias("h")) for i in range(HASHES)]
    met = members.select("node", "root", F.explode(F.array(*least)).alias("x")).select("node", "root", "x.*").join(typical, "node")
    middle = met.groupBy("i", "h").agg(F.max(F.struct("typical", F.col("node").alias("m"), F.col("root").alias("m_root"))).alias("x"), F.count(F.lit(1)).alias("c"))
    pairs = met.join(middle.filter("c > 1").select("i", "h", "x.m", "x.m_root"), ["i", "h"]).filter("root <> m_root")
    return pairs.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def _overlap(n: str, other: str, similarity: float) -> str:
    """Shingles that a set of ``n`` must share with one of ``other`` to be that similar."""
    return f"cast(ceil(({n} + {other}) * {similarity / (1 + similarity)!r}D - 1e-9D) as int)"


def _across(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different components among (node, root) that may be similar: a prefix filter on the exact sets.

    Shingles are put in order, the rarest first. Of two sets that must share o shingles, each has one of them among its
    first n - o + 1, so those are enough to meet on. How many that are depends on both sizes; sizes are put in classes, a
    set is filed for each class that a partner can have, and what meets must keep the bound of its very sizes. Texts that
    share a common passage but are otherwise their own meet on nothing. The largest component under a shingle is not
    compared with itself.
    """
    step = similarity ** -0.5                      # a partner's class is at most two away
    members = sets.join(nodes, "node").withColumn("n", F.size("shingles")).filter("n > 0")
    rows = members.select("node", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # a shingle of one set only comes first in it, and no one else looks for it: it only takes up places
    shared = rows.join(often, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("of"))
    members = members.select("node", "root", "n").join(shared, "node").withColumn("alone", F.expr("n - size(of)"))
    members = members.withColumn("cls", F.expr(f"cast(floor(ln(n) / {math.log(step)!r}D + 1e-9D) as int)"))
    filed = members.select("*", F.explode(F.expr("sequence(cls - 2, cls + 2)")).alias("other"))
    least = f"greatest(cast(ceil(pow({step!r}D, other) - 1e-6D) as int), cast(ceil(n * {similarity!r}D - 1e-9D) as int), 1)"
    filed = filed.withColumn("first", F.expr(f"n - {_overlap('n', least, similarity)} + 1 - alone")).filter("first > 0")
    key = ["s", "lo", "hi"]
    filed = filed.select("node", "root", "n", "cls", "alone", F.least("cls", "other").alias("lo"), F.greatest("cls", "other").alias("hi"),
                         F.posexplode(F.expr("slice(of, 1, first)")).alias("at", "x"))
    filed = filed.select("node", "root", "n", "cls", "lo", "hi", (F.col("alone") + F.col("at")).alias("at"), F.col("x.s").alias("s"))
    per_root = filed.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("rows"))
    largest = per_root.groupBy(*key).agg(F.max(F.struct("rows", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    filed = filed.join(largest.select(*key, F.col("m.root").alias("largest")), key).select("*", (F.col("root") != F.col("largest")).alias("minor")).drop("largest")
    filed = written(filed, "simlong-filed")
    fields = ["node", "root", "n", "cls", "minor", "at"]
    right = filed.select(*[F.col(c).alias(f"o_{c}") for c in [*key, *fields]])
    same = (F.col("s") == F.col("o_s")) & (F.col("lo") == F.col("o_lo")) & (F.col("hi") == F.col("o_hi"))
    once = ~F.col("o_minor") | (F.col("node") < F.col("o_node"))
    share = _overlap("n", "o_n", similarity)
    alike = F.expr(f"least(n, o_n) >= {similarity!r}D * greatest(n, o_n) - 1e-9D and n - at >= {share} and o_n - o_at >= {share}")
    found = filed.filter("minor").join(right, same & (F.col("root") != F.col("o_root")) & once & alike
                                       & ((F.col("lo") == F.col("hi")) | (F.col("cls") != F.col("o_cls"))))
    out = written(found.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct(), "simlong-across")
    drop_written(filed)
    return out


def _joined(tried: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) over the verified links among ``tried`` and, where candidates stay apart, among what else can be similar."""
    root, clusters = components(verified(tried, sets, similarity)), components(tried)
    nodes = sets.select("node")
    for look in (lambda apart: _central(apart, sets), lambda apart: _across(apart, sets, similarity)):
        apart = written(_apart(clusters, root, nodes), "simlong-apart")
        if apart.isEmpty():
            drop_written(apart)
            break
        pairs = written(look(apart).join(tried, ["a", "b"], "left_anti"), "simlong-others")
        wider = components(verified(pairs, sets, similarity).union(root.toDF("a", "b")))
        for done in (apart, root, pairs):
            drop_written(done)
        root = wider
    drop_written(clusters)
    return root


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with the input's columns: that of the smallest id (null ids last), then of
    the least text hash; of rows that repeat both, any one.

    Null and empty texts, and texts without a word, are one group. Texts of fewer than ``width`` words are one shingle; of
    very long ones every shingle counts. Extra columns of any name are carried along. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simlong")
    node = F.xxhash64(*FIELDS)
    tried = candidates(prints.select(node.alias("node"), *FIELDS).distinct(), most_differing(similarity, SIGMAS))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    of = prints.select(node.alias("n"), place.alias("place")).groupBy("n").agg(F.min("place").alias("place"))
    wanted = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    sets = written(shingle_sets(docs, wanted.join(of, F.col("node") == F.col("n")).select("node", "place"), id_col, text_col, width), "simlong-sets")
    root = _joined(tried, sets, similarity)
    for done in (tried, sets):
        drop_written(done)
    of = of.join(root, F.col("n") == F.col("node"), "left").groupBy(F.coalesce("root", "n").alias("root")).agg(F.min("place").alias("k"))
    keep = of.select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    full = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    full = full.join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_hash")))
    if not prints.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        full = full.groupBy("k_id", "k_hash").agg(F.first("row").alias("row"))
    return full.select("row.*")
