"""Sources and sinks over the given tables: written to the shared folder in each format, ingested, and compared."""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from touchline.catalog.base import QUERIES, SQL, query, table
from touchline.plans import bronze, medallion
from touchline.session import shared_dir
from touchline.sinks import tables as sinks
from touchline.sources import files


def folder_query(name: str, sql: str | None = None):
    """A query that gets a new folder of its own below the shared one."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, lambda t, *cols: table(spark, sf_dir, t, *cols), f"{shared_dir(spark)}/ingest/{name}-{uuid.uuid4().hex}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


META = ["source_name", "batch_id"]


@folder_query("sc01_csv_scan", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, t, folder):
    t("customer", "c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(f"{folder}/csv")
    return files.read_csv(spark, f"{folder}/csv", "c_custkey bigint, c_name string, c_nationkey int")


@folder_query("sc05_database_or_export", "SELECT p_partkey, p_size FROM part")
def _(spark, t, folder):
    t("part", "p_partkey", "p_size").write.option("header", True).csv(f"{folder}/part")
    return files.read_jdbc_or_csv(spark, "part", f"{folder}/part", schema="p_partkey bigint, p_size int")


@folder_query("cp01_bronze_ingestion", """SELECT 'customers' AS tbl, count(*) AS n, 'csv' AS source_name, 'b1' AS batch_id, sum(c_custkey)::BIGINT AS ids FROM customer
UNION ALL SELECT 'orders', count(*), 'parquet', 'b1', sum(o_orderkey)::BIGINT FROM orders UNION ALL SELECT 'parts', count(*), 'database', 'b1', sum(p_partkey)::BIGINT FROM part
UNION ALL SELECT 'nations', count(*), 'api', 'b1', sum(n_nationkey)::BIGINT FROM nation""")
def _(spark, t, folder):
    t("customer", "c_custkey", "c_name").write.option("header", True).csv(f"{folder}/customer")
    t("part", "p_partkey", "p_name").write.option("header", True).csv(f"{folder}/part")
    t("orders").write.parquet(f"{folder}/orders")
    keys = {"customers": "c_custkey", "orders": "o_orderkey", "parts": "p_partkey", "nations": "n_nationkey"}
    sources = [bronze.csv("customers", f"{folder}/customer"), bronze.parquet("orders", f"{folder}/orders"),
               bronze.database("parts", "part", f"{folder}/part"), bronze.frame("nations", t("nation")),
               bronze.frame("absent", t("nation").limit(0))]
    report = bronze.ingest(spark, sources, "b1", lambda d, n: d.write.parquet(f"{folder}/{n}"))
    out = None
    for name, key in keys.items():
        assert report[name] == "written"
        d = spark.read.parquet(f"{folder}/bronze.{name}").groupBy(*META).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(key).cast("bigint")).alias("ids")).withColumn("tbl", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


@folder_query("sk12_gold_exports", "SELECT 'a' AS tbl, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'b', r_regionkey, r_name FROM region")
def _(spark, t, folder):
    sinks.export_gold({"a": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
                       "b": t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))}, folder)
    return spark.read.parquet(f"{folder}/a").withColumn("tbl", F.lit("a")).unionByName(spark.read.parquet(f"{folder}/b").withColumn("tbl", F.lit("b")))


@folder_query("sk14_ingestion_metadata", "SELECT s_suppkey, 'suppliers' AS source_name, 'b7' AS batch_id, true AS stamped, true AS filed FROM supplier")
def _(spark, t, folder):
    t("supplier").write.parquet(f"{folder}/supplier")
    d = sinks.add_metadata(spark.read.parquet(f"{folder}/supplier"), "suppliers", "b7")
    return d.select("s_suppkey", *META, F.col("ingestion_ts").isNotNull().alias("stamped"), F.col("raw_file_name").endswith(".parquet").alias("filed"))


@query("cp07_player_profiles", "SELECT c_custkey AS player_id, c_name AS name, CAST(NULL AS VARCHAR) AS note FROM customer")
def _(t):
    return medallion.fact_player_profiles(t("customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.lit(None).alias("note")))


IDS = "ids AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer)"


@query("cp02_unreadable_ids", f"""WITH {IDS} SELECT 'kept' AS outcome, id AS raw_id, c_name AS name FROM ids WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'unreadable_player_id', id, c_name FROM ids WHERE c_custkey % 7 = 0""")
def _(t):
    """Kept and quarantined players together are the input: none is lost."""
    key = F.col("c_custkey").cast("string")
    c = t("customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("PERSON_ID"), F.col("c_name").alias("DISPLAY_FIRST_LAST"),
                             F.lit("1995").alias("FROM_YEAR"), F.lit("2001").alias("TO_YEAR"))
    kept = medallion.dim_players(c, None).select(F.lit("kept").alias("outcome"), F.col("nba_api_player_id").alias("raw_id"), F.col("player_name").alias("name"))
    bad = medallion.unreadable_ids({"players": (c, "PERSON_ID")})
    return kept.unionByName(bad.select(F.col("reason").alias("outcome"), "raw_id", F.get_json_object("row", "$.DISPLAY_FIRST_LAST").alias("name")))


@query("cp04_unreadable_ids", f"""WITH {IDS} SELECT CASE WHEN id LIKE 'x%' THEN 'quarantined' ELSE 'kept' END AS outcome, count(DISTINCT (c_custkey, year(o_orderdate))) AS n
FROM ids JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    key = F.col("o_custkey").cast("string")
    s = t("orders").select(F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("player_id"), F.year("o_orderdate").cast("string").alias("season")).distinct()
    kept = medallion.fact_player_season_stats(s).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("kept"))
    bad = medallion.unreadable_ids({"stats": (s, "player_id")}).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("quarantined"))
    return kept.unionByName(bad)
