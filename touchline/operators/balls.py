"""A ball index over vectors, kept as tables, and the exact nearest-neighbour search that reads it.

Equal vectors are folded first (a query wants at most k of them, those of the smallest ids). The rest is divided into cells
around centres taken from the data, and each cell into sub-cells around centres of its own: about as many sub-cells in a
cell as there are cells, so finding a vector's sub-cell costs about twice the square root of their number. Sub-cells of
more than ``block_rows`` vectors are kept in several blocks. Every block has a centre, a radius and a size.

Blocks that lie beside one another are kept in bins of about ``bin_rows`` vectors, and a query is sent to bins: at most once to each that
holds a block its bound allows, so what is moved grows with queries times bins however small the blocks are. The bound comes from the
blocks (some hold k vectors within that distance, and the triangle inequality shows others to be farther); the bin of its nearest block is
searched first, which tightens it. Inside a bin only blocks are measured that the bound of some query at hand allows. Vectors
of a bin are read once and the queries stream by; no bin is repeated for its queries, except where over
``query_rows`` ask for one, which is then split among as many tasks.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import ordered
from touchline.session import materialize

LEAF = 2048              # vectors that a sub-cell should hold
BLOCK_ROWS = 4096        # vectors of a block
BIN_ROWS = 32_768        # vectors held together in one task: those of whole blocks
CHUNK_CELLS = 1 << 22    # distances computed at once
QUERY_ROWS = 20_000      # queries that stream by one block in one task
MOST_CENTRES = 16_384    # cells; they grow with the root of the corpus, so this is met at some 5 * 10^11 vectors

BLOCK = ["g", "cell", "sub", "part"]
BIN = ["g", "bin"]


@dataclass(frozen=True)
class BallIndex:
    """centres: one row per cell (sent with the tasks). cells: g, cell, n, radius. blocks: BLOCK, centre, n, radius, bin.
    points: BLOCK, bin, cids (at most ``k``, ascending), vec."""

    k: int
    centres: np.ndarray
    cells: DataFrame
    blocks: DataFrame
    points: DataFrame


def _matrix(vecs) -> np.ndarray:
    return np.asarray(vecs.tolist() if hasattr(vecs, "tolist") else vecs, dtype=np.float64)


def gaps(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the rows of ``v`` and of ``c``, rounding included."""
    size = (v * v).sum(1)[:, None] + (c * c).sum(1)[None]
    d2, slack = size - 2 * v @ c.T, (v.shape[1] + 8) * 4.5e-16 * size
    return np.sqrt(np.maximum(d2 - slack, 0)), np.sqrt(np.maximum(d2, 0) + slack)


def beside(held: DataFrame, streamed: DataFrame, key: list[str], prepare: Callable, use: Callable, schema: str) -> DataFrame:
    """For each key, ``use(prepare(held rows), streamed rows)``: the held rows come first, the others pass by in batches."""
    # a number one side lacks is 0, not null: pandas would make the other side's ids floats
    kinds = {f.name: f.dataType for d in (held, streamed) for f in d.schema.fields}
    filled = lambda d: d.withColumns({c: (F.lit(0) if isinstance(t, T.NumericType) else F.lit(None)).cast(t) for c, t in kinds.items() if c not in d.columns})
    both = filled(held).withColumn("_kind", F.lit(0)).unionByName(filled(streamed).withColumn("_kind", F.lit(1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rows, ready = None, [], None
        for pdf in batches:
            keys = pdf[key]
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                part, this = pdf.iloc[a:b], tuple(keys.iloc[a])
                if this != current:
                    current, rows, ready = this, [], None
                first = (part["_kind"] == 0).to_numpy()
                if first.any():
                    rows.append(part[first])
                if not first.all() and rows:
                    ready = prepare(pd.concat(rows)) if ready is None else ready
                    yield from use(ready, part[~first], current)

    return both.repartition(*key).sortWithinPartitions(*key, "_kind").mapInPandas(run, schema)


def _folded(corpus: DataFrame, k: int) -> DataFrame:
    """g, vec and the ``k`` smallest ids of each distinct vector."""
    least = ordered.top_k(corpus.select("g", "vec", "cid"), ["g", "vec"], [F.asc("cid")], k)
    return least.groupBy("g", "vec").agg(F.array_sort(F.collect_list("cid")).alias("cids"))


def build(corpus: DataFrame, k: int, cells: int | None = None, leaf: int = LEAF, block_rows: int = BLOCK_ROWS,
          bin_rows: int = BIN_ROWS) -> BallIndex | None:
    """Index of corpus (g, cid, vec) for searches of up to ``k`` neighbours; None if it is empty."""
    c = materialize(_folded(corpus, k), "balls-folded")
    n = c.count()
    if not n:
        return None
    wanted = min(MOST_CENTRES, max(1, cells or math.ceil(math.sqrt(n / leaf))))
    rank = F.xxhash64("vec")
    seed = c.select("vec").orderBy(rank, "vec").limit(wanted).collect()         # at most MOST_CENTRES rows
    centres = np.unique(_matrix([r[0] for r in seed]), axis=0)

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                _, far = gaps(_matrix(pdf["vec"]), centres)
                yield pdf.assign(cell=far.argmin(1).astype("int32"), reach=far.min(1))

    c = materialize(c.mapInPandas(nearest, "g string, vec array<double>, cids array<bigint>, cell int, reach double"), "balls-cells")
    of_cell = materialize(c.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"), F.min_by("vec", rank).alias("one")), "balls-atlas")
    # sub-centres: one vector in ``leaf``, of large cells fewer, so that a cell has at most about twice as many as there are cells
    each = F.greatest(F.lit(leaf), F.ceil(F.col("n") / (2 * max(len(centres), 2))))
    of_size = of_cell.select("g", "cell", "n")
    some = c.join(of_size, ["g", "cell"]).filter((F.col("n") > leaf) & (F.pmod(F.xxhash64(F.lit(1), "vec"), each) == 0)).select("g", "cell", "vec")
    subs = some.union(of_cell.select("g", "cell", F.col("one").alias("vec"))).distinct()
    subs = subs.withColumn("sub", F.row_number().over(Window.partitionBy("g", "cell").orderBy("vec")))
    slices = F.ceil(F.col("n") / (16 * block_rows)).cast("int")
    held = subs.join(of_size, ["g", "cell"]).select("g", "cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "sub", "vec")
    streamed = c.join(of_size, ["g", "cell"]).select("g", "cell", F.pmod(F.xxhash64(F.lit(2), "vec"), slices).cast("int").alias("slice"), "vec", "cids")

    def prepare(rows):
        rows = rows.sort_values("sub")
        return rows["sub"].to_numpy().astype("int64"), _matrix(rows["vec"]), {}

    def place(ready, rows, key):
        sub, at, seen = ready
        _, far = gaps(_matrix(rows["vec"]), at)
        best = far.argmin(1)
        place = np.empty(len(rows), np.int64)                   # how many of its sub-cell this task has met before
        for b in np.unique(best):
            mine = np.flatnonzero(best == b)
            place[mine] = seen.get(b, 0) + np.arange(len(mine))
            seen[b] = seen.get(b, 0) + len(mine)
        yield pd.DataFrame({"g": key[0], "cell": np.int32(key[1]), "sub": sub[best].astype("int32"),
                            "part": [f"{key[2]}-{p}" for p in place // block_rows], "cids": rows["cids"], "vec": rows["vec"],
                            "centre": list(at[best]), "reach": far[np.arange(len(rows)), best]})

    points = beside(held, streamed, ["g", "cell", "slice"], prepare, place,
                    "g string, cell int, sub int, part string, cids array<bigint>, vec array<double>, centre array<double>, reach double")
    points = materialize(points, "balls-points")
    blocks = points.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"), F.first("centre").alias("centre"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("cell", "sub", "part").rowsBetween(Window.unboundedPreceding, -1))
    blocks = materialize(blocks.withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) / bin_rows).cast("int")), "balls-blocks")
    points = points.select(*BLOCK, "cids", "vec").join(blocks.select(*BLOCK, "bin"), BLOCK)
    return BallIndex(k, centres, of_cell.drop("one"), blocks, points)


def _enough(far: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per query a distance within which the balls surely hold k vectors; infinity if all hold fewer."""
    order = np.argsort(far, axis=1)
    held = np.cumsum(n[order], axis=1)
    at = (held < k).sum(axis=1)
    out = np.full(len(far), np.inf)
    ok = at < far.shape[1]
    out[ok] = far[ok, order[ok, at[ok]]]
    return out


def _sliced(held: DataFrame, streamed: DataFrame, key: list[str], query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a slice: a key that over ``query_rows`` rows ask for is split; held rows nobody asks for are left out."""
    asked = streamed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_s"))
    held = held.join(asked, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    return held, streamed.join(asked, key).withColumn("slice", F.pmod(F.xxhash64("qid"), F.col("_s")).cast("int")).drop("_s")


def _chunks(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose distances to ``width`` others are held at once."""
    step = max(1, CHUNK_CELLS // max(1, width))
    for i in range(0, n, step):
        yield slice(i, i + step)


def routes(index: BallIndex, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qid, BIN, least, bound, first): the bins a query's bound allows, with a lower bound of the distances there; ``first`` is the bin of
    its nearest block. Queries of a group the index does not have give no rows."""

    def block_of(rows):
        rows = rows.sort_values("bin")
        bins, starts = np.unique(rows["bin"].to_numpy(), return_index=True)
        return bins.astype("int32"), starts, rows["n"].to_numpy().astype("int64"), rows["radius"].to_numpy(), _matrix(rows["centre"])

    def to_bins(ready, rows, key):
        bins, starts, n, radius, at = ready
        for part in _chunks(len(rows), len(at)):
            some = rows.iloc[part]
            low, far = gaps(_matrix(some["vec"]), at)
            bound = _enough(far + radius, n, k)
            least = np.minimum.reduceat(low - radius, starts, axis=1)
            home = np.searchsorted(starts, far.argmin(1), side="right") - 1
            allowed = least <= bound[:, None]
            allowed[np.arange(len(some)), home] = True
            q, b = np.nonzero(allowed)
            yield pd.DataFrame({"qid": some["qid"].to_numpy()[q], "g": key[0], "bin": bins[b], "least": least[q, b], "bound": bound[q], "first": home[q] == b})

    held, streamed = _sliced(index.blocks.select("g", "bin", "n", "radius", "centre"), queries.select("qid", "g", "vec"), ["g"], query_rows)
    return beside(held, streamed, ["g", "slice"], block_of, to_bins, "qid bigint, g string, bin int, least double, bound double, first boolean")


def search(index: BallIndex, queries: DataFrame, sent: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qid, cid, d2): the ``k`` nearest of every bin that a query is sent to (qid, BIN and bound: none farther is asked for)."""
    asked = sent.select("qid", *BIN, "bound").join(queries.select("qid", "vec"), "qid")

    def prepare(rows):
        rows = rows.sort_values(BLOCK[1:])
        c, of = _matrix(rows["vec"]), rows[BLOCK[1:]]
        starts = np.flatnonzero((of != of.shift()).any(axis=1).to_numpy())
        n = np.diff(np.r_[starts, len(c)])
        centre = np.add.reduceat(c, starts, axis=0) / n[:, None]
        # per block: its farthest vector
        reach = np.concatenate([gaps(c[a:a + m], centre[i:i + 1])[1][:, 0] for i, (a, m) in enumerate(zip(starts, n))])
        return c, (c * c).sum(1), rows["cids"].to_numpy(), n, centre, np.maximum.reduceat(reach, starts)

    def best(ready, rows, key):
        c, cc, cids, n, centre, radius = ready
        v, qids = _matrix(rows["vec"]), rows["qid"].to_numpy()
        bound, home, need = rows["bound"].to_numpy().copy(), np.empty(len(v), np.int64), np.empty((len(v), len(n)), bool)
        for part in _chunks(len(v), len(n)):
            low, far = gaps(v[part], centre)
            limit = np.minimum(bound[part] * (1 + 1e-12), _enough(far + radius, n, k))
            home[part], need[part] = far.argmin(1), low - radius <= limit[:, None]
        order = np.argsort(home, kind="stable")                 # queries that are near one another ask for the same blocks
        for part in _chunks(len(order), len(c)):
            mine = order[part]
            wanted = need[mine].any(axis=0)
            if not wanted.any():
                continue
            at = np.flatnonzero(np.repeat(wanted, n)) if not wanted.all() else np.arange(len(c))
            here, hh, take = (c[at], cc[at], min(k, len(at))) if len(at) < len(c) else (c, cc, min(k, len(c)))
            q = v[mine]
            qq = (q * q).sum(1)
            rough = qq[:, None] + hh[None, :] - 2.0 * q @ here.T
            # everything within rounding of the k-th rough distance is measured again
            limit = np.partition(rough, take - 1, axis=1)[:, take - 1] + 1e-9 * (qq + hh.max()) + 1e-12
            out = []
            for j, qid in enumerate(qids[mine]):
                near = np.flatnonzero(rough[j] <= limit[j])
                d2 = ((here[near] - q[j]) ** 2).sum(1)
                own = [cids[x] for x in at[near]]
                ids, d2 = np.concatenate(own), np.repeat(d2, [len(x) for x in own])
                first = np.lexsort((ids, d2))[:k]
                out.append((np.full(len(first), qid), ids[first], d2[first]))
            qid, cid, d2 = (np.concatenate(a) for a in zip(*out))
            yield pd.DataFrame({"qid": qid, "cid": cid, "d2": d2})

    held, streamed = _sliced(index.points, asked, BIN, query_rows)
    return beside(held, streamed, [*BIN, "slice"], prepare, best, "qid bigint, cid bigint, d2 double")


def _top(found: DataFrame, k: int) -> DataFrame:
    return ordered.top_k(found, ["qid"], [F.asc("d2"), F.asc("cid")], k)


def rounds(index: BallIndex, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the k best of each query's first bin: qid, cid, d2; the other bins (qid, BIN, bound) that may hold one as near)."""
    found = materialize(routes(index, queries, k, query_rows), "balls-routes")
    one = materialize(_top(search(index, queries, found.filter("first"), k, query_rows), k).drop("rank"), "balls-first")
    so_far = one.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).alias("so_far"))
    rest = found.filter("not first").join(so_far, "qid", "left").withColumn("bound", F.least("bound", "so_far"))
    return one, rest.filter(F.col("least") <= F.col("bound") * (1 + 1e-12)).select("qid", *BIN, "bound")


def nearest(index: BallIndex, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact ``k`` nearest of the index per query (qid, g, vec): qid, cid, distance, rank; ties go to the smaller id."""
    if k > index.k:
        raise ValueError(f"the index keeps {index.k} ids of equal vectors, fewer than {k}")
    if not index.blocks.filter("bin > 0").limit(1).count():                     # one bin a group
        sent = queries.join(index.blocks.select("g").distinct(), "g").select("qid", "g", F.lit(0).alias("bin"), F.lit(math.inf).alias("bound"))
        found = search(index, queries, sent, k, query_rows)
    else:
        one, rest = rounds(index, queries, k, query_rows)
        found = one.unionByName(search(index, queries, rest, k, query_rows))
    return _top(found, k).select("qid", "cid", F.sqrt("d2").alias("distance"), "rank")
