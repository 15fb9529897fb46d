"""Vector search: cosine top-k, exact k-nearest-neighbour join, rerank, suppression."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import music
from touchline.operators import balls


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_of(df: DataFrame, key: str, value, col: str) -> list[float] | None:
    """One vector by id (a point lookup of a single row)."""
    row = df.filter(F.col(key) == F.lit(value)).select(col).first()
    return None if row is None else [float(v) for v in row[0]]


def vector_topk(df: DataFrame, query: Sequence[float], col: str, k: int = 5, min_score: float = 0.3,
                key: str = "track_id") -> DataFrame:
    """Top ``k`` rows by cosine, at least ``min_score``. Each task keeps its own top k before the merge."""
    q = [float(v) for v in query]
    n = float(np.linalg.norm(q))
    score = F.try_divide(music.dot(col, literal_vector(q)), music.norm(col) * F.lit(n)) if n else F.lit(None).cast("double")
    return df.withColumn("score", score).filter(F.col("score") >= min_score).orderBy(F.desc("score"), F.asc(key)).limit(k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, by: str | None = None, cells: int | None = None,
             leaf: int = balls.LEAF, block_rows: int = balls.BLOCK_ROWS, query_rows: int = balls.QUERY_ROWS) -> DataFrame:
    """Exact ``k`` nearest corpus rows (Euclidean) per query: qid, cid, distance, rank. For unit vectors the order equals cosine order.

    queries: qid, vec (and ``by``); corpus: cid, vec (and ``by``). Rows without a vector or a group take no part. The corpus is
    indexed once (``balls``), and queries are sent only to the bins that their bound allows, once to each; pairs are never emitted. Keep a
    ``balls.build`` to ask several times.
    """
    group = (F.col(by) if by else F.lit(0)).cast("string").alias("g")
    q = queries.select("qid", group, F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and g is not null")
    c = corpus.select("cid", group, F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and g is not null")
    index = balls.build(c, k, cells, leaf, block_rows)
    if index is None:
        return queries.sparkSession.createDataFrame([], "qid bigint, cid bigint, distance double, rank int")
    return balls.nearest(index, q, k, query_rows)


def rerank(df: DataFrame, audio: Sequence[float], text: Sequence[float], k: int = 5, key: str = "track_id",
           audio_col: str = "audio", text_col: str = "text_vec") -> DataFrame:
    """Audio pool of max(3k, 15), then 0.9 * (0.7 audio + 0.3 text) + 0.1 * rank share. The pool is a few rows."""
    from pyspark.sql import Window

    pool = vector_topk(df, audio, audio_col, max(k * 3, 15), 0.2, key)
    # the pool has at most max(3k, 15) rows, so one window over all of it is small
    order = Window.orderBy(F.desc("score"), F.asc(key))
    pool = pool.withColumns({"_pos": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    text_sim = music.dot(text_col, literal_vector(text))
    combined = F.lit(0.9) * (F.lit(0.7) * F.col("score") + F.lit(0.3) * text_sim) \
        + F.lit(0.1) * (F.lit(1.0) - F.col("_pos") / F.col("_n"))
    return pool.withColumn("combined", combined).orderBy(F.desc("combined"), F.asc(key)).limit(k).drop("_pos", "_n")


def suppress(candidates: DataFrame, by: Sequence[str], distance: str, period: str, sec: str, cid: str, k: int,
             gap_s: int) -> DataFrame:
    """Greedy choice, nearest first; a candidate within ``gap_s`` of a chosen one in the same period is skipped.

    Input groups hold at most the candidate pool (see ``pool_size``), so each group is a short array that is
    folded inside its row.
    """
    item = F.struct(F.col(distance).alias("d"), F.col(cid).alias("cid"), F.col(period).alias("period"), F.col(sec).alias("sec"))
    arr = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("a"))
    none = F.slice(F.col("a"), 1, 0)
    step = lambda kept, x: F.when(
        (F.size(kept) < k) & ~F.exists(kept, lambda m: (m["period"] == x["period"]) & (F.abs(m["sec"] - x["sec"]) < gap_s)),
        F.concat(kept, F.array(x))).otherwise(kept)
    return (arr.select(*by, F.posexplode(F.aggregate("a", none, step)).alias("pos", "x"))
            .select(*by, (F.col("pos") + 1).alias("rank"), F.col("x.cid").alias(cid), F.col("x.d").alias(distance),
                    F.col("x.period").alias(period), F.col("x.sec").alias(sec)))


def pool_size(k: int, gap_s: int, step_s: int) -> int:
    """Candidates that always suffice for ``k`` choices after suppression, the query's own surroundings included.

    Anchors are ``step_s`` apart, so one place rules out at most 2 * ceil(gap / step) - 1 of them.
    """
    each = 2 * -(-gap_s // step_s) - 1
    return each * k + 1
