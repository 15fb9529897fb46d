"""Connected components of an edge table by alternating stars.

Each round is two joins on the edge table: every node hands its smallest neighbour to its larger neighbours, then to
its smaller ones. Nothing is collected; each round is written to the shared folder, and the one before is removed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import drop_written, written


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return (both.join(least, F.col("a") == F.col("n")).filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    moved = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) whose component has a smaller node; a component's root is its smallest node.

    Nulls, self-links and repeats in the edges are ignored. Nodes without links and the roots themselves have no row.
    """
    e = written(edges.toDF("a", "b").filter("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(e)
    while True:
        new = written(_small(_large(e)), "links")
        drop_written(e)
        e, old, state = new, state, _state(new)
        if state == old:
            out = e.toDF("node", "root")
            out._written = e._written                   # for drop_written, when nothing reads it any more
            return out
