"""File, JDBC, document and message sources."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.sets import union_drift


def read_parquet(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header. With a schema there is no extra pass over the data."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_partitioned_files(spark: SparkSession, glob: str, pattern: str, schema=None, season: str = "season") -> DataFrame:
    """Many per-season CSV files in one scan; the season is group 1 of ``pattern`` in the file name."""
    df = read_csv(spark, glob, schema)
    name = F.col("_metadata.file_name")
    return df.select("*", F.regexp_extract(name, pattern, 1).alias(season), name.alias("raw_file_name"))


def read_json(spark: SparkSession, path: str, multiline: bool = True, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_enveloped_json(spark: SparkSession, glob: str, key: str | None = None, all_string: bool = False) -> DataFrame:
    """Per-season ``{key: [rows]}`` files; the season is the file stem. Columns a season lacks become null.

    Without ``key`` each file uses its first non-empty list. One scan reads all files: the schema is the union.
    """
    raw = spark.read.option("multiLine", True).json(glob)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    lists = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType)
             and isinstance(f.dataType.elementType, T.StructType)]
    if key is not None:
        parts = [key] if key in lists else []
    else:
        parts = lists
    if not parts:
        return spark.createDataFrame([], "season string")
    raw = raw.select(stem.alias("season"), *parts)
    rows = []
    for i, p in enumerate(parts):
        empty_before = [F.coalesce(F.size(F.col(q)), F.lit(0)) <= 0 for q in parts[:i]]
        d = raw
        for e in empty_before:
            d = d.filter(e)
        d = d.filter(F.size(F.col(p)) > 0).select("season", F.explode(F.col(p)).alias("r")).select("r.*", "season")
        rows.append(d)
    out = union_drift(rows)
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns]) if all_string else out


def read_jdbc_or_csv(spark: SparkSession, table: str, csv: str, url: str | None = None, options: dict | None = None,
                     schema=None) -> DataFrame:
    """Database table read in parallel partitions when ``options`` name a partition column; CSV when it is absent.

    For large tables pass partitionColumn, lowerBound, upperBound, numPartitions: one connection reads it all
    otherwise. A database that cannot be read is an error; the exported file is read only where no URL is given.
    """
    if url:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    return read_csv(spark, csv, schema)


def stringify_nested(df: DataFrame) -> DataFrame:
    from touchline.functions.parsing import to_json_cols

    return to_json_cols(df)


def read_documents(spark: SparkSession, path: str, stringify: bool = True, multiline: bool = True) -> DataFrame:
    df = spark.read.option("multiLine", multiline).json(path)
    return stringify_nested(df) if stringify else df


def stream_source(spark: SparkSession, conf: dict) -> DataFrame:
    """Message stream with key, value, topic, kafka_partition, kafka_offset, kafka_ts.

    ``{"format": "kafka", "servers": ..., "topics": ..., "starting": "earliest", "per_trigger": n}`` or
    ``{"format": "json", "path": ..., "per_trigger": files}`` with the same columns in files.
    """
    if conf["format"] == "kafka":
        r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", conf["servers"])
             .option("subscribe", conf["topics"]).option("startingOffsets", conf.get("starting", "earliest")))
        if conf.get("per_trigger"):
            r = r.option("maxOffsetsPerTrigger", conf["per_trigger"])
        return r.load().select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic",
            F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
            F.col("timestamp").alias("kafka_ts"))
    schema = "key string, value string, topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp"
    r = spark.readStream.schema(schema)
    if conf.get("per_trigger"):
        r = r.option("maxFilesPerTrigger", conf["per_trigger"])
    return r.json(conf["path"])


def verify_assets(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """ok / mismatch / missing for every recorded file; files are hashed on the executors.

    manifest: path (relative), sha256 (recorded), expected_checksum and checksum_algo (from the publisher, or null).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.col("path"), "^(file:)?/*", "/").substr(len(root) + 2, 10000)
    have = files.select(rel.alias("path"), F.sha2("content", 256).alias("_sha"), F.md5("content").alias("_md5"),
                        F.sha1("content").alias("_sha1"))
    j = manifest.join(have, "path", "left")
    pub = F.when(F.col("checksum_algo") == "md5", F.col("_md5")).when(F.col("checksum_algo") == "sha1", F.col("_sha1")) \
        .otherwise(F.col("_sha"))
    pub_ok = F.col("expected_checksum").isNull() | F.col("checksum_algo").isNull() | (pub == F.col("expected_checksum"))
    status = (F.when(F.col("_sha").isNull(), "missing")
              .when((F.col("_sha") == F.col("sha256")) & pub_ok, "ok").otherwise("mismatch"))
    return j.select(*manifest.columns, status.alias("status"))
