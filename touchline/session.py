"""Session factory and the shared folder used for state that must outlive an executor."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution and skew handling; cluster settings win where already given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # windows over one entity keep this many rows in memory before they use the spillable buffer
        "spark.sql.windowExec.buffer.in.memory.threshold": "65536",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is missing *and* the master is local, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = os.environ.get("TOUCHLINE_LOCAL_DIR") or tempfile.mkdtemp(prefix="touchline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/materialized/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
