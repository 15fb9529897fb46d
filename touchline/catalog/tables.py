"""Scans and streams over the driver tables. Streams read the events table as a file source and run to its end."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.catalog.base import QUERIES, SQL, query, table
from touchline.session import shared_dir
from touchline.sinks.tables import Lake
from touchline.streaming import scores
from touchline.streaming.reorder import released
from touchline.streaming.validate import attributed, with_validation


def stream_query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with _stream_conf(spark):
                return fn(spark, sf_dir, f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


@contextmanager
def _stream_conf(spark: SparkSession):
    """UTC, RocksDB state, and no empty batches, so that "available now" ends with the input."""
    want = {"spark.sql.session.timeZone": "UTC", "spark.sql.streaming.noDataMicroBatches.enabled": "false",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if k != "spark.sql.session.timeZone":
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def _to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run the stream over all available input into a table written per batch, and read that table."""
    spark = stream.sparkSession
    lake = Lake(spark, f"{folder}/out")
    q = stream.writeStream.foreachBatch(lambda d, i: lake.commit(d, "rows", i)).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return lake.read("rows").drop("batch_id")


@query("sc08_parquet_scan", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t("lineitem", "l_orderkey", "l_shipdate", "l_quantity").filter("l_quantity > 45").drop("l_quantity")


SNAP = """g AS (SELECT event_id, event_type AS league, 'g' || user_id AS game_id, CAST(floor(value) AS INTEGER) % 5 AS h, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS a,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def _score_tables(spark, sf_dir, folder) -> Lake:
    """Every event as a snapshot of one game with two periods and up to two happenings, some without minute or player."""
    e = _events_stream(spark, sf_dir).withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "h": F.floor("value").cast("int") % 5})
    e = e.withColumn("a", F.col("k") % 3)
    side = lambda n, s: F.struct(F.lit(n).alias("teamName"), s.alias("score"))
    period = lambda n: F.struct(F.lit(n).alias("period"), (F.col("h") % n).alias("homeScore"), F.col("a").alias("awayScore"))
    none, text = F.lit(None).cast("string"), F.col("k").cast("string")
    goal = F.struct(F.lit("goal").alias("type"), F.when(F.col("k") % 4 != 0, F.col("k") % 45).alias("minute"), F.when(F.col("k") % 5 != 0, F.concat(F.lit("p"), text)).alias("player"),
                    none.alias("playerIn"), none.alias("playerOut"), F.lit("H").alias("team"))
    swap = F.struct(F.lit("substitution").alias("type"), F.lit(None).cast("int").alias("minute"), none.alias("player"), F.concat(F.lit("i"), text).alias("playerIn"),
                    F.concat(F.lit("o"), (F.col("k") % 7).cast("string")).alias("playerOut"), F.when(F.col("k") % 6 != 0, "A").alias("team"))
    game = F.struct(F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("gameId"), F.lit("live").alias("statusText"), side("H", F.col("h")).alias("homeTeam"),
                    side("A", F.col("a")).alias("awayTeam"), F.array(period(1), period(2)).alias("periods"), F.array(goal, swap).alias("events"))
    msg = e.select(F.to_json(F.struct(F.col("event_type").alias("league"), F.array(game).alias("games"))).alias("value"))
    lake = Lake(spark, f"{folder}/out", scores.SCHEMAS)
    scores.start_scores(msg, lake, f"{folder}/checkpoint", {"availableNow": True}, query=f"scores-{uuid.uuid4().hex}").awaitTermination()
    return lake


@stream_query("st01_score_stream", f"WITH {SNAP} SELECT DISTINCT league, game_id, h AS home_score, a AS away_score, 'live' AS status_text FROM g")
def _(spark, sf_dir, folder):
    return _score_tables(spark, sf_dir, folder).read("game_scores").select("league", "game_id", "home_score", "away_score", "status_text")


@stream_query("cp13_period_scores", f"WITH {SNAP} SELECT DISTINCT league, game_id, p AS period_number, h % p AS home_score, a AS away_score FROM g, (SELECT unnest([1, 2]) AS p)")
def _(spark, sf_dir, folder):
    return _score_tables(spark, sf_dir, folder).read("period_scores").select("league", "game_id", "period_number", "home_score", "away_score")


@stream_query("cp13_match_events", f"""WITH {SNAP}, m AS (
 SELECT event_id, league, game_id, 'goal' AS event_type, CASE WHEN k % 4 <> 0 THEN k % 45 END AS minute, CASE WHEN k % 5 <> 0 THEN 'p' || k END AS player_name, CAST(NULL AS VARCHAR) AS player_out, 'H' AS team FROM g
 UNION ALL SELECT event_id, league, game_id, 'substitution', NULL, NULL, 'o' || k % 7, CASE WHEN k % 6 <> 0 THEN 'A' END FROM g)
SELECT DISTINCT league, game_id, event_type, minute, player_name, player_out, team FROM m WHERE team IS NOT NULL UNION ALL SELECT league, game_id, event_type, minute, player_name, player_out, team FROM m WHERE team IS NULL""")
def _(spark, sf_dir, folder):
    """A row without a team has no whole key, so each of them is inserted."""
    return _score_tables(spark, sf_dir, folder).read("match_events").select("league", "game_id", "event_type", "minute", "player_name", "player_out", "team")


def _tracking_message(e: DataFrame, seq=None, attempt=0, flags=None, end=None) -> DataFrame:
    """key, value and kafka_offset of a tracking message per event; a match per event type, the event id as sequence."""
    seq = F.col("event_id") if seq is None else seq
    body = F.to_json(F.struct(
        F.lit("1.0.0").alias("schema_version"), F.lit("tracking_frame").alias("record_type"), F.col("event_type").alias("match_id"), F.lit("s").alias("replay_session_id"),
        seq.alias("sequence"), seq.alias("physical_time_ms"), F.lit(1).alias("period"), F.lit(attempt).alias("attempt"),
        (F.array().cast("array<string>") if flags is None else flags).alias("quality_flags"), (F.lit(False) if end is None else end).alias("end_of_stream")))
    return e.select(F.concat_ws("|", F.lit("s"), F.col("event_type")).alias("key"), body.alias("value"), F.col("event_id").alias("kafka_offset"))


def _valid(messages: DataFrame) -> DataFrame:
    return attributed(with_validation(messages)).filter(F.col("invalid_reason").isNull())


REORDERED = "WITH m AS (SELECT *, max(event_id) OVER (PARTITION BY event_type) AS hwm FROM events) SELECT event_type AS match_id, event_id AS seq FROM m WHERE hwm - event_id >= 20"


@stream_query("st04_reorder_stream", REORDERED)
def _(spark, sf_dir, folder):
    out = _to_table(released(_valid(_tracking_message(_events_stream(spark, sf_dir))), 20, 600_000), folder)
    return out.filter("kind = 'frame'").select("match_id", "seq")


def _in_files(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> DataFrame:
    """A stream over a folder into which tables are put one after the other. It runs to its end after each, so the files of one are one batch."""
    rows.write.mode("append").parquet(f"{folder}/{name}")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")


@stream_query("st06_restarted_stream", REORDERED)
def _(spark, sf_dir, folder):
    """Half of the events, a stop, the other half from the checkpoint: rows that waited at the stop come out of the state."""
    e = table(spark, sf_dir, "events")
    middle = e.agg(F.floor(F.avg("event_id"))).first()[0]
    for half in (F.col("event_id") <= middle, F.col("event_id") > middle):
        stream = _in_files(spark, e.filter(half), folder, "in")
        out = _to_table(released(_valid(_tracking_message(stream)), 20, 600_000), folder)
    return out.filter("kind = 'frame'").select("match_id", "seq")


@stream_query("st05_late_rows", """WITH m AS (SELECT event_type AS match_id, event_id AS seq, max(event_id) OVER (PARTITION BY event_type) AS hwm FROM events), x AS (SELECT *, max(CASE WHEN hwm - seq >= 20 THEN seq END) OVER (PARTITION BY match_id) AS upto FROM m),
 second AS (SELECT match_id, seq, CASE WHEN seq % 3 = 0 THEN CASE WHEN seq <= upto THEN 'late_correction' END ELSE NULL END AS r FROM x WHERE seq % 5 = 0),
 third AS (SELECT match_id, seq, 'after_end_of_stream' AS r FROM x WHERE seq % 7 = 0)
SELECT match_id, seq, r AS reason FROM second WHERE r IS NOT NULL UNION ALL SELECT match_id, seq, r FROM third""")
def _(spark, sf_dir, folder):
    """Batch 1: all events. Batch 2: every fifth again, every third of those as a correction, then the end. Batch 3: every seventh again, after the end."""
    e = table(spark, sf_dir, "events")
    plain = F.array().cast("array<string>")
    fixed = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("injected_correction"))).otherwise(plain)
    ends = e.groupBy("event_type").agg(F.max("event_id").alias("event_id"))
    batches = [_tracking_message(e), _tracking_message(e.filter("event_id % 5 = 0"), attempt=1, flags=fixed).unionByName(
        _tracking_message(ends, seq=F.col("event_id") + 1, end=F.lit(True))), _tracking_message(e.filter("event_id % 7 = 0"), attempt=2)]
    for b in batches:
        out = _to_table(released(_valid(_in_files(spark, b, folder, "in")), 20, 600_000), folder)
    note = F.from_json("payload", "reason string")
    return out.filter("kind = 'late'").select("match_id", "seq", note["reason"].alias("reason"))


@stream_query("st07_changes_only_stream", "WITH l AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events) SELECT event_id, event_type FROM l WHERE o IS NULL OR o <> event_type")
def _(spark, sf_dir, folder):
    e = _events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("fp"), F.lit("").alias("value"))
    return _to_table(scores.changes_only_stream(e), folder).select(F.col("ord").alias("event_id"), F.col("fp").alias("event_type"))


@stream_query("st03_bronze_stream", """SELECT CASE WHEN event_id % 10 = 0 THEN 'unparseable_or_missing_match_id' WHEN event_id % 10 = 1 THEN 'unsupported_schema_version' WHEN event_id % 10 = 2 THEN 'bad_sequence' END AS reason, count(*) AS n FROM events WHERE event_id % 10 < 3 GROUP BY 1""")
def _(spark, sf_dir, folder):
    from touchline.streaming.tracking import open_lake, start_bronze
    n = F.col("event_id") % 10
    body = F.to_json(F.struct(F.when(n == 1, "9.0").otherwise("1.0.0").alias("schema_version"), F.lit("tracking_frame").alias("record_type"), F.col("event_type").alias("match_id"), F.lit("s").alias("replay_session_id"),
                              F.when(n == 2, -1).otherwise(F.col("event_id")).alias("sequence"), F.col("event_id").alias("physical_time_ms")))
    m = _events_stream(spark, sf_dir).select(F.concat_ws("|", F.lit("s"), F.col("event_type")).alias("key"), F.when(n == 0, "{broken").otherwise(body).alias("value"), F.lit("t").alias("topic"),
                                             F.lit(0).alias("kafka_partition"), F.col("event_id").alias("kafka_offset"), F.col("ts").cast("timestamp").alias("kafka_ts"))
    lake = open_lake(spark, f"{folder}/out")
    start_bronze(m, lake, f"{folder}/checkpoint", {"availableNow": True}, query=f"bronze-{uuid.uuid4().hex}").awaitTermination()
    return lake.read("ops.quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


