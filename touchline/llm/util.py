"""Small helpers the operators share: text normalisation, scratch tables, checked broadcasts."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# white space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(col: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without one (tests) gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.environ.get("TOUCHLINE_LOCAL_DIR") or tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, is computed once, survives executors.

    What the write shuffled goes from the executors' disks at its end; nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    old = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_written", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join a table of a few narrow rows: broadcast while it has at most ``most`` rows, else an ordinary join."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)
