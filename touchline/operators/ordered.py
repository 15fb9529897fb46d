"""Ordered (window) operators that do not put one whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to a single task. When one key holds a
large share of the data that task never ends. Here each key's rows are first cut into *chunks* by a
column that never decreases along the order (an hour, a block of sequence numbers, ...). The window
runs inside ``(key, chunk)``; one summary row per chunk is scanned along the key; the summary of the
earlier (or later) chunks is joined back. Results equal the plain window exactly.

``chunk=None`` means every key is known to have few rows (seasons of a player, periods of a match) and the
plain window, one shuffle for all of them, is used. ``split_if_hot`` makes that choice from a row count per
key, the same way a broadcast is chosen from a checked size.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, SCOPE = "_chunk", "_scope"
# rows of one key that a single task sorts without trouble
HOT_ROWS = 2_000_000


def split_if_hot(df: DataFrame, by: Sequence[str], chunk: Column, limit: int | None = None) -> Column | None:
    """``chunk`` when some key has more than ``limit`` rows, else None (plain window).

    One counting job over the key columns only; the counts are combined before the shuffle.
    """
    limit = HOT_ROWS if limit is None else limit
    n = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return chunk if n is not None and n > limit else None


def by_time(col, seconds: int) -> Column:
    """Chunk key for a timestamp column: whole multiples of ``seconds``."""
    return F.floor(F.unix_seconds(F.col(col).cast("timestamp")) / F.lit(seconds))


def by_number(col, width: int) -> Column:
    """Chunk key for a numeric column."""
    return F.floor(F.col(col) / F.lit(width))


def _cols(names: Sequence) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _pos(order: Sequence) -> Column:
    """Position of a row as a comparable struct (ascending order columns only)."""
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_cols(order))])


def two_level(df: DataFrame, by: Sequence[str], chunk: Column, local: dict, summary: dict, carry: dict) -> DataFrame:
    """Add ``local`` window columns and ``carry`` columns computed from per-chunk ``summary`` rows.

    ``local``: name -> function(window spec base without order) giving a column inside (key, chunk);
    ``summary``: name -> aggregate column per (key, chunk); ``carry``: name -> function(window over the
    key's chunks) giving the value handed to every row of the chunk.

    The rows' window and the join share one key, a struct, in which null fields are equal: the rows are shuffled once.
    """
    base = df.withColumn(CHUNK, chunk)
    inside = Window.partitionBy(SCOPE)
    rows = base.withColumn(SCOPE, F.struct(*by, CHUNK)).withColumns({n: f(inside) for n, f in local.items()})
    sums = base.groupBy(*by, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    along = Window.partitionBy(*by).orderBy(CHUNK)
    handed = sums.select(F.struct(*by, CHUNK).alias("_handed"), *[f(along).alias(n) for n, f in carry.items()])
    return rows.join(handed, F.col(SCOPE) == F.col("_handed"), "left").drop(SCOPE, "_handed")


def _shift(df, cols, by, order, chunk, forward: bool):
    """Previous (or next) value of every column in ``cols``: {source: new name}."""
    o = _cols(order)
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*o)
        f = F.lead if forward else F.lag
        return df.withColumns({new: f(old).over(w) for old, new in cols.items()})
    vals = F.struct(*[F.col(c) for c in cols])
    edge = F.min_by(vals, _pos(order)) if forward else F.max_by(vals, _pos(order))
    shift = F.lead if forward else F.lag
    out = two_level(
        df, by, chunk,
        local={"_in": lambda p: shift(vals).over(p.orderBy(*o))},
        summary={"_edge": edge},
        carry={"_from": lambda w: shift("_edge").over(w)})
    # a null struct means "first (last) row of the chunk": only then look at the neighbour chunk
    pick = F.coalesce(F.col("_in"), F.col("_from"))
    return (out.withColumn("_pick", pick)
            .withColumns({new: F.col(f"_pick.{old}") for old, new in cols.items()})
            .drop("_in", "_from", "_pick", CHUNK))


def with_lag(df: DataFrame, cols: dict[str, str], by, order, chunk: Column | None = None) -> DataFrame:
    return _shift(df, cols, by, order, chunk, forward=False)


def with_lead(df: DataFrame, cols: dict[str, str], by, order, chunk: Column | None = None) -> DataFrame:
    return _shift(df, cols, by, order, chunk, forward=True)


def with_delta(df: DataFrame, cols: dict[str, str], by, order, chunk: Column | None = None) -> DataFrame:
    """``x - previous x`` for every column."""
    tmp = {c: f"_prev_{c}" for c in cols}
    out = with_lag(df, tmp, by, order, chunk)
    return out.withColumns({new: F.col(c) - F.col(tmp[c]) for c, new in cols.items()}).drop(*tmp.values())


def carry_forward(df: DataFrame, col: str, out: str, by, order, chunk: Column | None = None) -> DataFrame:
    """Last non-null value at or before the row."""
    o = _cols(order)
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(col, ignorenulls=True).over(w))
    seen = F.when(F.col(col).isNotNull(), _pos(order))
    r = two_level(
        df, by, chunk,
        local={"_in": lambda p: F.last(col, ignorenulls=True).over(
            p.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))},
        summary={"_last": F.max_by(col, seen)},
        carry={"_from": lambda w: F.last("_last", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1))})
    return r.withColumn(out, F.coalesce("_in", "_from")).drop("_in", "_from", CHUNK)


def carry_backward(df: DataFrame, col: str, out: str, by, order, chunk: Column | None = None) -> DataFrame:
    """First non-null value at or after the row.

    The order is turned round: a frame that ends at the last row is computed anew for every row.
    """
    o = _cols(order)
    back = [c.desc_nulls_last() for c in o]
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(col, ignorenulls=True).over(w))
    seen = F.when(F.col(col).isNotNull(), _pos(order))
    later = Window.partitionBy(*by).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    r = two_level(
        df, by, chunk,
        local={"_in": lambda p: F.last(col, ignorenulls=True).over(
            p.orderBy(*back).rowsBetween(Window.unboundedPreceding, 0))},
        summary={"_first": F.min_by(col, seen)},
        carry={"_from": lambda w: F.last("_first", ignorenulls=True).over(later)})
    return r.withColumn(out, F.coalesce("_in", "_from")).drop("_in", "_from", CHUNK)


def _running(df, col, out, by, order, chunk, agg, join, last: int):
    o = _cols(order)
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumn(out, agg(col).over(w))
    r = two_level(
        df, by, chunk,
        local={"_in": lambda p: agg(col).over(p.orderBy(*o).rowsBetween(Window.unboundedPreceding, last))},
        summary={"_all": agg(col)},
        carry={"_from": lambda w: agg("_all").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return r.withColumn(out, join(F.col("_in"), F.col("_from"))).drop("_in", "_from", CHUNK)


def _plus(a, b):
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def running_max(df: DataFrame, col: str, out: str, by, order, chunk: Column | None = None,
                include_current: bool = True) -> DataFrame:
    return _running(df, col, out, by, order, chunk, F.max, F.greatest, 0 if include_current else -1)


def running_sum(df: DataFrame, col: str, out: str, by, order, chunk: Column | None = None,
                include_current: bool = True) -> DataFrame:
    return _running(df, col, out, by, order, chunk, F.sum, _plus, 0 if include_current else -1)


def sums_and_lasts(df: DataFrame, sums: dict[str, str], lasts: dict[str, str], by, order, chunk: Column | None = None) -> DataFrame:
    """``running_sum`` and ``carry_forward`` of several columns ({source: new name}); with a chunk they share one shuffle."""
    if chunk is None:
        for c, out in sums.items():
            df = running_sum(df, c, out, by, order)
        for c, out in lasts.items():
            df = carry_forward(df, c, out, by, order)
        return df
    o = _cols(order)
    upto = lambda p: p.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True)
    r = two_level(
        df, by, chunk,
        local={**{f"_in_{n}": lambda p, c=c: F.sum(c).over(upto(p)) for c, n in sums.items()},
               **{f"_in_{n}": lambda p, c=c: last(c).over(upto(p)) for c, n in lasts.items()}},
        summary={**{f"_all_{n}": F.sum(c) for c, n in sums.items()},
                 **{f"_all_{n}": F.max_by(c, F.when(F.col(c).isNotNull(), _pos(order))) for c, n in lasts.items()}},
        carry={**{f"_from_{n}": lambda w, n=n: F.sum(f"_all_{n}").over(earlier(w)) for n in sums.values()},
               **{f"_from_{n}": lambda w, n=n: last(f"_all_{n}").over(earlier(w)) for n in lasts.values()}})
    names = [*sums.values(), *lasts.values()]
    return r.withColumns({**{n: _plus(F.col(f"_in_{n}"), F.col(f"_from_{n}")) for n in sums.values()},
                          **{n: F.coalesce(f"_in_{n}", f"_from_{n}") for n in lasts.values()}}) \
        .drop(CHUNK, *[f"_in_{n}" for n in names], *[f"_from_{n}" for n in names])


def with_sequence(df: DataFrame, out: str, by, order, chunk: Column | None = None, start: int = 0) -> DataFrame:
    """Gapless number per key, counting from ``start``."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), "_one", out, by, order, chunk) \
        .withColumn(out, (F.col(out) - 1 + start).cast("bigint")).drop("_one")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Row with the greatest ``order`` per key. An aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), _pos(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Row with the smallest ``order`` per key (deterministic "keep first")."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), _pos(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, by, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each group to ``k`` before the shuffle (window group limit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def last_n(df: DataFrame, by, order: Sequence[Column], n: int, rank: str = "from_end") -> DataFrame:
    """Last ``n`` rows per group; ``order`` is given ascending, newest row has rank 1."""
    return top_k(df, by, [F.desc(c) if isinstance(c, str) else c.desc() for c in order], n, rank)


def global_rank(df: DataFrame, score: str, tie: str, out: str = "rank", buckets: int = 64) -> DataFrame:
    """1..n by ``score`` descending (nulls last), ties by ``tie`` ascending, without a one-task global sort.

    Score boundaries come from one approximate-percentile job; they only decide how rows are spread, the
    numbers are exact. A score so common that it is a boundary gets a bucket of its own, which is spread again
    by the tie column, so one popular score cannot fill one task. Text ties are ordered by the number at their
    end first (``P9`` before ``P10``).
    """
    numeric = dict(df.dtypes)[tie] != "string"
    t = F.col(tie).cast("double") if numeric else \
        F.regexp_extract(tie, r"(\d{1,15})$", 1).try_cast("double")
    d = df.withColumns({"_s": -F.col(score).cast("double"), "_t": t})
    steps = F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])
    b = d.agg(F.percentile_approx("_s", steps, 10000).alias("s"), F.percentile_approx("_t", steps, 10000).alias("t")).first()
    cuts, tcuts = sorted(set(b["s"] or [])), sorted(set(b["t"] or []))
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<double>")
    below = F.size(F.filter(arr(cuts), lambda c: c < F.col("_s")))
    is_cut = F.array_contains(arr(cuts), F.col("_s"))
    part = F.when(F.col("_t").isNull(), len(tcuts) + 1).otherwise(F.size(F.filter(arr(tcuts), lambda c: c < F.col("_t"))))
    wide = len(tcuts) + 2
    # 2 * below is the open interval before a cut, 2 * below + 1 the cut itself
    chunk = (2 * below + F.when(is_cut, 1).otherwise(0)) * wide + F.when(is_cut, part).otherwise(0)
    chunk = F.when(F.col("_s").isNull(), F.lit((2 * len(cuts) + 2) * wide) + part).otherwise(chunk)
    o = [F.col("_s").asc_nulls_last(), F.col("_t").asc_nulls_last(), F.col(tie).asc()]
    r = two_level(
        d, [], chunk.cast("bigint"),
        local={"_in": lambda p: F.row_number().over(p.orderBy(*o))},
        summary={"_n": F.count(F.lit(1))},
        carry={"_from": lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return r.withColumn(out, (F.col("_in") + F.col("_from")).cast("bigint")).drop("_in", "_from", "_s", "_t", CHUNK)
