"""Tables: create, append, conform, export, metadata, idempotent commits, upserts, quarantine, fan-out."""
from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import ordered
from touchline.operators.reshape import cast_void, conform


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Lake:
    """Parquet tables ``<root>/<layer>.<name>`` with known schemas.

    Batches are written to ``batch_id=<n>`` folders with dynamic partition overwrite: a retried batch replaces
    its own files and never adds rows twice. ``partitions`` names the columns a table is divided by above that, such as
    the match, so that reading one match opens no other's files.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None, partitions: dict[str, Sequence[str]] | None = None):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions or {}
        self.schemas = {n: T._parse_datatype_string(s) if isinstance(s, str) else s for n, s in (schemas or {}).items()}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        if _exists(self.spark, self.path(name)):
            return True
        self.recover(name)
        return _exists(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        r = self.spark.read
        if name in self.schemas:
            if not self.exists(name):
                return self.spark.createDataFrame([], self.schemas[name])
            r = r.schema(self.schemas[name])
        else:
            self.exists(name)
        return r.parquet(self.path(name))

    def safe(self, name: str) -> DataFrame | None:
        """The table, or None when it is missing or empty (one row is enough to know)."""
        if not self.exists(name):
            return None
        df = self.read(name)
        return None if df.isEmpty() else df

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _beside(self, name: str, kind: str) -> list[str]:
        """Versions written beside a table (``next``) or moved out of its way (``old``), oldest first."""
        root, fs = self._hadoop(self.root)
        found = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(f"{self.root}/{n}" for n in found if n.startswith(f"{name}.{kind}-"))

    def recover(self, name: str) -> None:
        """Finish a replacement that stopped half way: a table is never missing for longer than until it is next asked for."""
        target, fs = self._hadoop(self.path(name))
        if fs.exists(target):
            return
        whole = [p for p in self._beside(name, "next") if _exists(self.spark, f"{p}/_SUCCESS")]
        for p in [*whole[::-1], *self._beside(name, "old")[::-1]]:
            fs.rename(self._hadoop(p)[0], target)
            return

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> int:
        """Create or replace; returns the row count, observed during the write itself.

        A new version is written beside the old one first, so reading the old version while replacing it is safe. Then the old one
        moves aside, the new one takes its name, and the old one goes. Whatever step is the last one done, one whole version is there.
        """
        self.recover(name)
        seen = Observation()
        df = cast_void(df).observe(seen, F.count(F.lit(1)).alias("n"))
        stamp = time.time_ns()
        stale = [*self._beside(name, "next"), *self._beside(name, "old")]
        new, fs = self._hadoop(f"{self.path(name)}.next-{stamp}")
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(new.toString())
        old, _ = self._hadoop(self.path(name))
        aside, _ = self._hadoop(f"{self.path(name)}.old-{stamp}")
        if fs.exists(old):
            fs.rename(old, aside)
        fs.rename(new, old)
        for p in [*stale, aside.toString()]:
            fs.delete(self._hadoop(p)[0], True)
        return seen.get["n"]

    def append(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> int:
        seen = Observation()
        df = cast_void(df).observe(seen, F.count(F.lit(1)).alias("n"))
        df.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(self.path(name))
        return seen.get["n"]

    def commit(self, df: DataFrame, name: str, batch_id: int) -> int:
        """Write one micro-batch; the same batch written again replaces itself."""
        if name in self.schemas:
            df = conform(df, T.StructType([f for f in self.schemas[name].fields if f.name != "batch_id"]))
        seen = Observation()
        df = df.drop("batch_id").withColumn("batch_id", F.lit(batch_id).cast("bigint")) \
            .observe(seen, F.count(F.lit(1)).alias("n"))
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy(*self.partitions.get(name, ()), "batch_id").parquet(self.path(name)))
        return seen.get["n"]


    def prune(self, name: str, before: int) -> None:
        """Remove the folders of batches below ``before`` of a table written by ``commit``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            for f in fs.listStatus(path):
                kind, _, batch = f.getPath().getName().partition("=")
                if kind == "batch_id" and int(batch) < before:
                    fs.delete(f.getPath(), True)


class CommitLog:
    """Which (query, batch, table) writes are done; a retried batch skips tables that already have it."""

    def __init__(self, lake: Lake, query: str):
        self.lake, self.query = lake, query

    def _mine(self) -> DataFrame | None:
        if not self.lake.exists("ops.sink_ledger"):
            return None
        return self.lake.read("ops.sink_ledger").filter(F.col("query_name") == self.query)

    def done(self, batch_id: int) -> set[str]:
        """Tables this batch has reached (a handful of names)."""
        led = self._mine()
        return set() if led is None else {r[0] for r in led.filter(F.col("batch_id") == batch_id).select("sink").collect()}

    def last(self, table: str, before: int) -> int | None:
        """Newest finished batch below ``before``."""
        led = self._mine()
        return None if led is None else led.filter((F.col("sink") == table) & (F.col("batch_id") < before)).agg(F.max("batch_id")).first()[0]

    def append(self, df: DataFrame, table: str, batch_id: int) -> bool:
        return bool(self.append_all({table: df}, batch_id))

    def append_all(self, frames: dict[str, DataFrame], batch_id: int) -> list[str]:
        """Write several tables of one batch at the same time, then record them in one ledger file.

        A failed write fails the call before the ledger is touched; the retry then writes every table again, and
        the batch folders make that a replacement.
        """
        done = self.done(batch_id)
        todo = {n: d for n, d in frames.items() if n not in done}

        def one(item):
            t0 = time.time()
            n = self.lake.commit(item[1], item[0], batch_id)
            return (self.query, batch_id, item[0], int(n), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), int((time.time() - t0) * 1000))

        if not todo:
            return []
        with ThreadPoolExecutor(min(6, len(todo))) as pool:
            rows = list(pool.map(inheritable_thread_target(self.lake.spark)(one), todo.items()))
        self.lake.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(self.lake.path("ops.sink_ledger"))
        return list(todo)


LEDGER = "query_name string, batch_id bigint, sink string, rows bigint, committed_at timestamp, duration_ms bigint"


def ensure_tables(spark: SparkSession, ddl: dict[str, tuple[str, Sequence[str]]]) -> None:
    """Namespaces and partitioned catalog tables: name -> (columns, partition columns)."""
    for name, (columns, parts) in ddl.items():
        if "." in name:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.split('.')[0]}")
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by}")


def safe_table(spark: SparkSession, name: str) -> DataFrame | None:
    if not spark.catalog.tableExists(name):
        return None
    df = spark.table(name)
    return None if df.isEmpty() else df


def write_table(df: DataFrame, name: str) -> None:
    cast_void(df).write.mode("overwrite").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    cast_void(df).write.mode("append").saveAsTable(name)


def add_metadata(df: DataFrame, source: str, batch_id: str, file: str | None = None) -> DataFrame:
    """Ingestion time, source, batch and file; without ``file`` the name comes from the scan."""
    if file is None:
        name = F.col("_metadata.file_name") if _has_metadata(df) else F.lit("")
    else:
        name = F.lit(file)
    return df.withColumns({"ingestion_ts": F.current_timestamp(), "source_name": F.lit(source),
                           "batch_id": F.lit(batch_id), "raw_file_name": name})


def _has_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_name")
        return True
    except Exception:
        return False


def merge_insert_only(new: DataFrame, target: DataFrame | None, keys: Sequence[str], null_safe: dict | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``target``, one per key.

    A key column with a null makes the row distinct from every other row, unless ``null_safe`` gives the value
    that stands for null in that column.
    """
    null_safe = null_safe or {}
    expr = {k: F.coalesce(F.col(k), F.lit(null_safe[k])) if k in null_safe else F.col(k) for k in keys}
    n = new.withColumns({f"_k_{k}": e for k, e in expr.items()})
    kk = [f"_k_{k}" for k in keys]
    hasnull = F.lit(False)
    for k in kk:
        hasnull = hasnull | F.col(k).isNull()
    solid = n.filter(~hasnull).dropDuplicates(kk)
    if target is not None:
        t = target.select(*[e.alias(f"_k_{k}") for k, e in expr.items()])
        solid = solid.join(t, kk, "left_anti")
    return solid.unionByName(n.filter(hasnull)).drop(*kk)


def upsert(new: DataFrame, target: DataFrame | None, keys: Sequence[str], order: str) -> DataFrame:
    """Target after last-write-wins by key; rows of ``new`` beat equal versions of the target.

    Rows are spread by key first: wide rows are then sorted by many tasks, however few read the input.
    """
    both = new.withColumn("_new", F.lit(1))
    if target is not None:
        both = both.unionByName(target.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return ordered.latest_by(both.repartition(*keys), keys, [order, "_new"]).drop("_new")


def quarantine(bad: DataFrame, value: str = "value", key_note: str = "attributed_by_key") -> DataFrame:
    """Rejected rows with reason, detail and the whole raw value."""
    detail = F.concat(F.lit("offset="), F.col("kafka_offset").cast("string"),
                      F.when(F.col(key_note), F.lit(" session_from=kafka_key")).otherwise(F.lit("")))
    return bad.select(
        F.current_timestamp().alias("detected_at"), F.col("session_id"), F.col("match_id"), F.col("sequence").alias("seq"),
        F.col("invalid_reason").alias("reason"), detail.alias("detail"), F.col(value).alias("raw_value"),
        "kafka_partition", "kafka_offset")


def fan_out(batch: DataFrame, routes: dict[str, tuple[str, T.StructType | str, dict[str, str]]],
            write: Callable[[DataFrame, str], object], keys: Sequence[str] = ("session_id", "match_id")) -> None:
    """One frame of (keys, kind, payload JSON) to one table per kind, each with its own schema and renames."""
    batch = batch.persist()
    try:
        for kind, (table, schema, renames) in routes.items():
            d = batch.filter(F.col("kind") == kind).select(*keys, F.from_json("payload", schema).alias("p")).select(*keys, "p.*")
            write(d.withColumnsRenamed(renames), table)
    finally:
        batch.unpersist()


def export_gold(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        cast_void(df).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_normalized(frames: DataFrame, positions: DataFrame, folder: str) -> dict[str, int]:
    """Frames and positions as zstd Parquet; row counts are observed while writing."""
    out = {}
    for name, df, label in (("frames", frames, "frames"), ("tracking", positions, "position_rows")):
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd") \
            .parquet(f"{folder}/{name}")
        out[label] = seen.get["n"]
    return out


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest row per key of an append-only table (the serving view)."""
    return ordered.latest_by(df, keys, [version])


def start_console(stream: DataFrame, name: str = "latest", fmt: str = "memory"):
    return stream.writeStream.format(fmt).queryName(name).outputMode("append").start()
