"""SimHash near-duplicates, with candidates pruned by chains of segments around a ring (pigeonring).

Fingerprints of 64 bits are cut into five segments. If two differ in at most 4 bits, then going around the ring of
segments from a well chosen one, the first l segments together differ in at most 4 l / 5 bits, for every l: none in
the first, 1 in the first two, 2 in three, 3 in four. (Were there no such start, the chains that break their budget
would go round the ring and sum to more than 4.) So a fingerprint is filed, for each start, under its first two
segments, and looked up under these and each change of one bit of the second: 26 bits must meet, instead of the 13
that a plain pigeonhole would ask for. What meets must keep the chain's budgets, and then 4 bits in all.

Rows of equal fingerprint are folded before the search. Within a bucket the links are followed from one fingerprint
to the next, taking out what was reached; a bucket of mutually near copies is done in about one step per copy, and
never writes more links than it has members. Components come from alternating stars over those links.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.util import text_of, written

BITS, NEAR, WIDTHS = 64, 4, (13, 13, 13, 13, 12)


def segments() -> list[list[int]]:
    """Bit positions of each segment."""
    ends = list(accumulate(WIDTHS))
    return [list(range(e - w, e)) for w, e in zip(WIDTHS, ends)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def chains() -> list[list[tuple[int, int]]]:
    """Per start: (mask of the first l segments, most differing bits) for l = 1 to all."""
    seg, m = segments(), len(WIDTHS)
    out = []
    for i in range(m):
        bits, steps = [], []
        for n in range(1, m + 1):
            bits += seg[(i + n - 1) % m]
            steps.append((_mask(bits), NEAR * n // m))
        out.append(steps)
    return out


CHAINS = chains()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; repeats count. No word: 0."""
    import xxhash

    words = text.encode("utf-8").lower().split()          # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts, ends[width - 1:]))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), 1 << 15):
        h = np.array([digest(joined[a:b], seed) for a, b in spans[i:i + (1 << 15)]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a signed long) of every row. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"),
                      text_of(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _near(d: np.ndarray, start: int) -> np.ndarray:
    """Which differences keep every budget of the chain from ``start``, the last one being all bits."""
    ok = np.ones(d.shape, bool)
    for mask, most in CHAINS[start]:
        ok[ok] = np.bitwise_count(d[ok] & np.uint64(mask)) <= most
    return ok


def spanning_links(fps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is linked within one bucket: each step takes out all that the current one reaches."""
    out, rest = [], fps
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            hit = _near(rest ^ x, start)
            if hit.any():
                y = rest[hit]
                out.append((np.full(y.size, x), y))
                queue += list(y)
                rest = rest[~hit]
    return out


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (start, key, fp) sorted by start and key. Holds one bucket and one batch at a time."""

    def links(start, key, fp):
        first = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[first, start.size])
        filed = fp & HEAD[start] == key
        live = (size > 1) & np.logical_or.reduceat(filed, first)
        pairs = first[live & (size == 2)]
        found = []
        for s in range(len(CHAINS)):
            p = pairs[start[pairs] == s]
            hit = p[_near(fp[p] ^ fp[p + 1], s)]
            found.append((fp[hit], fp[hit + 1]))
        for a, n in zip(first[live & (size > 2)], size[live & (size > 2)]):
            found += spanning_links(fp[a:a + n], int(start[a]))
        a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    HEAD = np.array([c[1][0] for c in CHAINS], np.uint64)
    held = [np.empty(0, t) for t in (np.int64, np.uint64, np.uint64)]
    for batch in batches:
        new = [batch.column(0).to_numpy().astype(np.int64), *(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))]
        rows = [np.concatenate(x) for x in zip(held, new)]
        if not rows[0].size:
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0      # the last bucket may go on
        if cut:
            yield links(*(r[:cut] for r in rows))
        held = [r[cut:] for r in rows]
    if held[0].size:
        yield links(*held)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: near pairs that join everything that is linked."""
    seg, m = segments(), len(WIDTHS)
    looked = [(s, CHAINS[s][1][0], f) for s in range(m) for f in [0, *(1 << b for b in seg[(s + 1) % m])]]
    table = F.array(*[F.struct(F.lit(s).cast("byte").alias("start"), F.lit(signed(h)).cast("long").alias("head"),
                               F.lit(signed(f)).cast("long").alias("flip")) for s, h, f in looked])
    rows = fps.select("fp", F.explode(table).alias("x")).select(
        F.col("x.start").alias("start"), F.col("fp").bitwiseAND(F.col("x.head")).bitwiseXOR(F.col("x.flip")).alias("key"), "fp")
    return (rows.repartition("start", "key").sortWithinPartitions("start", "key")
            .mapInArrow(bucket_links, "a long, b long"))


def grouped(prints: DataFrame) -> DataFrame:
    """(c_fp, root, component_id) per distinct fingerprint; component_id is the smallest id of all rows connected to it."""
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    root = components(links(reps.select("fp")))
    reps = reps.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    return reps.select("fp", "root").join(ids, "root").select(F.col("fp").alias("c_fp"), "root", "component_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other. Null ids are
    passed over when the smallest is taken; a component of null ids only has a null one. Repeated rows each give a row. Of very
    long texts every shingle counts.
    Other columns are not read, whatever their names; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    out = prints.join(grouped(prints), F.col("fp") == F.col("c_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row of each component, with the input's columns: that of the smallest id (null ids last), then of the least
    text hash; of rows that repeat both, any one.

    Null, empty and wordless texts are one component's if their fingerprint is. Very long texts count whole; columns of any name are
    carried along; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = prints.join(grouped(prints), F.col("fp") == F.col("c_fp")).groupBy("root").agg(F.min(place).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    rows = rows.join(keep, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_hash")))
    if not prints.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("k_id", "k_hash").agg(F.first("row").alias("row"))
    return rows.select("row.*")
