"""Registry, table access and the shared views that several queries start from.

The driver tables stand in for sports data: a customer is a player, an order year a season, an event user a
moving entity. Money is summed in whole cents, so both engines get the same numbers.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(lambda t, *cols: table(spark, sf_dir, t, *cols))
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A driver table. Its schema is read from a footer once, later reads start no job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return df.select(*cols) if cols else df


# ------------------------------------------------------------------ player seasons
def season_text(year):
    return F.concat_ws("-", year.cast("string"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def raw_seasons(t) -> DataFrame:
    """PLAYER_ID, year and the sums of one season; one row per player and season."""
    o = t("orders").withColumns({"cents": F.round(F.col("o_totalprice") * 100).cast("bigint"), "year": F.year("o_orderdate")})
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.groupBy(F.col("o_custkey").alias("PLAYER_ID"), "year").agg(
        (F.count(F.lit(1)) * 15).alias("GP"), (F.sum("cents") / 4000000.0).alias("PTS"),
        (F.count_if(pr.isin("1-URGENT", "2-HIGH")) * 3.0).alias("REB"), (F.count_if(st == "F") * 2.0).alias("AST"),
        (F.count_if(st == "P") * 0.5).alias("STL"),
        F.when(F.count_if(pr == "5-LOW") > 0, F.count_if(pr == "5-LOW") * 0.25).alias("BLK"),
        (F.count_if(st == "O") * 1.0).alias("TOV"), (F.max("cents") / 1500000.0).alias("MIN"),
        ((F.sum("cents") % 1000) / 1000.0).alias("TS_PCT"))


RAW_SEASONS = """
raw_seasons AS (
  SELECT o_custkey AS PLAYER_ID, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(count(*) * 15 AS BIGINT) AS GP,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 4000000.0::DOUBLE AS PTS,
    count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) * 3.0::DOUBLE AS REB,
    count(*) FILTER (WHERE o_orderstatus = 'F') * 2.0::DOUBLE AS AST,
    count(*) FILTER (WHERE o_orderstatus = 'P') * 0.5::DOUBLE AS STL,
    CASE WHEN count(*) FILTER (WHERE o_orderpriority = '5-LOW') > 0
         THEN count(*) FILTER (WHERE o_orderpriority = '5-LOW') * 0.25::DOUBLE END AS BLK,
    count(*) FILTER (WHERE o_orderstatus = 'O') * 1.0::DOUBLE AS TOV,
    max(CAST(round(o_totalprice * 100) AS BIGINT)) / 1500000.0::DOUBLE AS MIN,
    (CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) % 1000) / 1000.0::DOUBLE AS TS_PCT
  FROM orders GROUP BY 1, 2)"""


def salary_of(year):
    return F.when((F.col("c_acctbal") > 0) & ((year + F.col("c_custkey")) % 2 == 0), F.col("c_acctbal") * 1000.0)


def seasons(t) -> DataFrame:
    """Player seasons with name, team, age, salary (often missing) and games missed."""
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = raw_seasons(t).join(c, F.col("PLAYER_ID") == F.col("c_custkey"))
    return d.select(
        "PLAYER_ID", season_text(F.col("year")).alias("SEASON"), F.col("c_name").alias("PLAYER_NAME"),
        F.col("n_name").alias("TEAM_ABBREVIATION"), (F.lit(19) + F.col("c_custkey") % 18).alias("AGE"), "GP", "MIN", "PTS", "REB",
        "AST", "STL", "BLK", "TOV", "TS_PCT", salary_of(F.col("year")).alias("salary"),
        ((F.col("c_custkey") * 7 + F.col("year")) % 45).cast("bigint").alias("total_games_missed"))


SEASONS = RAW_SEASONS + """,
seasons AS (
  SELECT PLAYER_ID, yr || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') AS SEASON, c_name AS PLAYER_NAME,
    n_name AS TEAM_ABBREVIATION, 19 + c_custkey % 18 AS AGE, GP, MIN, PTS, REB, AST, STL, BLK, TOV, TS_PCT,
    CASE WHEN c_acctbal > 0 AND (yr + c_custkey) % 2 = 0 THEN c_acctbal * 1000.0::DOUBLE END AS salary,
    CAST((c_custkey * 7 + yr) % 45 AS BIGINT) AS total_games_missed
  FROM raw_seasons JOIN customer ON PLAYER_ID = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# ------------------------------------------------------------------ moving entities
def events(t) -> DataFrame:
    return t("events").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("ts").cast("timestamp").alias("ts"))


EVENTS = """
ev AS (
  SELECT event_id, (epoch_us(ts) // 1000) AS t_ms, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts
  FROM events)"""

HOUR = 3_600_000
DAY = 24 * HOUR
