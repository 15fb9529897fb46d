"""Embedding whitening: principal components of all vectors by mixed-precision refinement.

Entries become whole numbers first, so the sums and the products about an integer centre are exact whatever the order
in which tasks finish. The covariance is summed by Spark, one small matrix a task, dealt out by matrix cell; only its
d x d totals reach the driver. There, eigenvectors found in 32 bits are corrected by matrix-multiplication iterations
(Ogita and Aishima) in 64 and then in extended precision. Eigenvalues too close for a correction to separate form
clusters; each is solved again as a small problem of its own, shifted by its mean, and the iterations go on.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import drop_written, written

MOST = 2.0 ** 53                 # whole numbers up to here are exact as doubles
ROUNDS = 40


@dataclass(frozen=True)
class Model:
    """What whitening needs: count, integer centre, remainder sums (S = n * centre + rest), eigenvalues and vectors."""

    n: int
    centre: list[int]
    rest: list[int]
    values: np.ndarray           # of the components asked for, falling
    vectors: np.ndarray          # d x components
    trace: float
    identity_error: float

    @property
    def usable(self) -> np.ndarray:
        """Components within the covariance's rank; those beyond it have no spread to divide by."""
        if not len(self.values):
            return np.zeros(0, bool)
        return self.values > max(self.values[0], 0.0) * len(self.centre) * np.finfo(float).eps


# ---- small dense algebra ------------------------------------------------------------------------------------------

def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(float), 2)) if a.size else 0.0


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """One correction: (better vectors, eigenvalues, largest correction of separated pairs, pairs too close)."""
    one = np.eye(len(a), dtype=x.dtype)
    r = one - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2                # equal on both sides, so that near eigenvalues do not blow rounding up into skewness
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    near = 2 * (_norm(off) + _norm(a) * _norm(r))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= near
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    np.fill_diagonal(close, False)
    return x + x @ e, values, float(np.abs(e).max()), close


def _clusters(values: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring eigenvalues that are too close to each other, two or more in a run."""
    order = np.argsort(values.astype(float))
    runs, run = [], [order[0]]
    for a, b in zip(order, order[1:]):
        if close[a, b]:
            run.append(b)
        else:
            runs.append(run)
            run = [b]
    return [np.array(r) for r in [*runs, run] if len(r) > 1]


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Turn the vectors of each cluster inside their own space: the shifted small problem shows differences the whole one hides."""
    x = x.copy()
    for run in _clusters(values, close):
        part = x[:, run]
        mean = values[run].mean()
        small = part.T @ (a @ part - mean * part)
        small = (small + small.T) / 2
        scale = np.abs(small).max()
        if scale > 0:
            _, turn = np.linalg.eigh((small / scale).astype(float))
            x[:, run] = part @ turn.astype(x.dtype)
    return x


def refined_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix given in extended precision."""
    scale = np.abs(a).max() if a.size else 0
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    values = np.diag(a)
    for kind, enough in ((np.float64, 1e-13), (np.longdouble, 64 * float(np.finfo(np.longdouble).eps))):
        b, x, last = a.astype(kind), x.astype(kind), np.inf
        for _ in range(ROUNDS):
            x, values, change, close = _step(b, x)
            if close.any():
                x = _solve_clusters(b, x, values, close)
            if change <= enough or last / 2 <= change < 1e-6:
                break
            last = change
    order = np.argsort(-values.astype(float), kind="stable")
    x = (x / np.sqrt((x * x).sum(axis=0)))[:, order]
    return (values[order] * scale).astype(float), x.astype(float)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    """The upper triangle as rows (i, j, v), v in decimal."""
    i, j = np.triu_indices(len(total))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total[i, j]], pa.string())],
                                      names=["i", "j", "v"])


def _exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers as Python integers: matrix products of 64-bit floats over as many rows as stay exact."""
    most = float(np.abs(z).max()) if z.size else 0.0
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    rows = len(z) if most == 0 else int(MOST // (most * most))
    if rows < 1:
        wide = z.astype(object)
        return wide.T @ wide
    for at in range(0, len(z), rows):
        part = z[at:at + rows].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


# ---- columns --------------------------------------------------------------------------------------------------------

def _unpack(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def dimension(vectors: DataFrame, vec_col: str = "embedding") -> int:
    """The length most vectors have (of equally frequent ones the larger); 0 without any."""
    n = F.size(F.col(vec_col))
    row = vectors.where(n > 0).groupBy(n.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def whole_numbers(vectors: DataFrame, d: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id and x = floor(scale * c) of each entry, as little-endian 64-bit integers, for the usable rows.

    Not usable: null vectors, vectors of another length than ``d``, and those with an entry that is null, not finite,
    or at least 2**53 when multiplied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("c").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(c * scale)
                good = (np.isfinite(x) & (np.abs(x) < MOST)).all(axis=1)
            data = np.ascontiguousarray(x[good].astype("<i8"))
            ends = np.arange(len(data) + 1, dtype=np.int64) * (8 * d)
            packed = pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(good)), packed.cast(pa.binary())], names=["vec_id", "x"])

    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    return src.where(F.size("c") == d).mapInArrow(run, "vec_id long, x binary")


def _summed(df: DataFrame, run, kind: str) -> list:
    """Sum cells (i, j, v) that every task gives once; at most d x d totals come back."""
    cells = df.mapInArrow(run, "i int, j int, v string")
    return cells.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()


def fit(x: DataFrame, d: int, components: int = 4) -> Model:
    """The model of a table of distinct packed vectors (column x), read four times: sums, products, and the check."""

    def sums(batches):
        total, n = np.zeros(d, dtype=object), 0
        for b in batches:
            part = _unpack(b.column("x"), d)
            # a batch of fewer than 2**9 rows cannot leave 64 bits; larger ones are added in pieces
            for at in range(0, len(part), 512):
                total += part[at:at + 512].sum(axis=0).astype(object)
            n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, d), pa.int32()), pa.array([0] * (d + 1), pa.int32()), pa.array([str(v) for v in [n, *total]], pa.string())],
                names=["i", "j", "v"])

    found = {r["i"]: int(r["v"]) for r in _summed(x, sums, "decimal(38,0)")}
    n = found.get(-1, 0)
    if not n:
        return Model(0, [0] * d, [0] * d, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    centre = [(2 * found[i] + n) // (2 * n) for i in range(d)]
    rest = [found[i] - n * centre[i] for i in range(d)]
    middle = np.array(centre, dtype=np.int64)

    def products(batches):
        total, any_ = np.zeros((d, d), dtype=object), False
        for b in batches:
            if b.num_rows:
                total += _exact_products(_unpack(b.column("x"), d) - middle)
                any_ = True
        if any_:
            yield _cells(total)

    wide = np.zeros((d, d), dtype=np.longdouble)
    for r in _summed(x, products, "decimal(38,0)"):
        exact = n * int(r["v"]) - rest[r["i"]] * rest[r["j"]]
        wide[r["i"], r["j"]] = wide[r["j"], r["i"]] = np.longdouble(str(exact))
    wide /= np.longdouble(n) * np.longdouble(n)
    values, vectors = refined_eigen(wide)
    k = min(components, d)
    model = Model(n, centre, rest, values[:k], vectors[:, :k], float(np.trace(wide)), 0.0)
    return Model(n, centre, rest, values[:k], vectors[:, :k], float(np.trace(wide)), _identity_error(x, d, model))


def _projected(z: np.ndarray, model: Model) -> np.ndarray:
    """(x - S/n) on the usable components, over the root of the eigenvalue; z is x less the integer centre."""
    shift = np.array([r / model.n for r in model.rest])
    return (z.astype(float) - shift) @ (model.vectors[:, model.usable] / np.sqrt(model.values[model.usable]))


def _identity_error(x: DataFrame, d: int, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over the usable components."""
    k, middle, n = int(model.usable.sum()), np.array(model.centre, dtype=np.int64), model.n
    if not k:
        return 0.0

    def moment(mean):
        def run(batches):
            total, any_ = np.zeros((k, k)) if mean is not None else np.zeros((1, k)), False
            for b in batches:
                if b.num_rows:
                    w, any_ = _projected(_unpack(b.column("x"), d) - middle, model), True
                    total += w.sum(axis=0, keepdims=True) if mean is None else (w - mean).T @ (w - mean)
            if any_:
                i, j = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                                  pa.array([repr(float(v)) for v in total.ravel()], pa.string())], names=["i", "j", "v"])
        return run

    mean = np.zeros(k)
    for r in _summed(x, moment(None), "double"):
        mean[r["j"]] = r["v"] / n
    cov = np.zeros((k, k))
    for r in _summed(x, moment(mean), "double"):
        cov[r["i"], r["j"]] = r["v"] / n
    return float(np.abs(cov - np.eye(k)).max())


def transform(numbers: DataFrame, d: int, model: Model) -> DataFrame:
    """Each row of ``whole_numbers`` on each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    middle, rest, n, k = np.array(model.centre, dtype=np.int64), model.rest, model.n, len(model.values)
    usable = model.usable
    share = [float(v) / model.trace if model.trace else None for v in model.values]

    def deviations(z: np.ndarray) -> list[int | None]:
        most = n * int(np.abs(z).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * d < 2 ** 63:
            y = z * n - np.array(rest, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        y = z.astype(object) * n - np.array(rest, dtype=object)
        return [v if v < 2 ** 63 else None for v in (y * y).sum(axis=1).tolist()]

    def run(batches):
        for b in batches:
            z = _unpack(b.column("x"), d) - middle
            if not len(z):
                continue
            w = np.full((len(z), k), np.nan)
            w[:, usable] = _projected(z, model)
            m = len(z) * k
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(np.repeat(np.arange(len(z)), k))), pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()),
                 pa.array(np.full(m, n), pa.int64()), pa.array([v for v in deviations(z) for _ in range(k)], pa.int64()),
                 pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())), pa.array(share * len(z), pa.float64()),
                 pa.array(np.full(m, model.identity_error), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """One row per usable input row and component, of at most ``components`` (fewer where vectors are shorter).

    Null vectors, vectors with null or non-finite entries or entries over 2**53 / ``scale``, empty vectors and vectors
    of another length than most give no rows. A null id stays null; repeated rows each give their rows, but count once
    in the fit list, as do all vectors of equal whole numbers. Components beyond the covariance's rank (a single
    distinct vector, constant entries) have a null ``whitened`` and do not count in ``identity_error``; with a trace of
    zero ``explained`` is null. ``deviation`` is null where it would leave 64 bits. Equal eigenvalues leave the choice of
    axes within their space open; it is the same for all rows. Texts of other columns, of any length, and columns of
    clashing names are not read. An empty table gives an empty result.
    """
    d = dimension(vectors, vec_col)
    if not d:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    numbers = whole_numbers(vectors, d, id_col, vec_col, scale)
    distinct = written(numbers.select("x").distinct(), "whiten-fit")
    model = fit(distinct, d, components)
    drop_written(distinct)
    return transform(numbers, d, model)
