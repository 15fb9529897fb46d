"""Score snapshot stream -> scores, period scores and match events, each inserted once by keys kept as stream state."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.reshape import event_columns, explode_nonempty
from touchline.sinks.tables import CommitLog, Lake

PAYLOAD = ("league string, games array<struct<gameId: string, statusText: string, "
           "homeTeam: struct<teamName: string, score: int>, awayTeam: struct<teamName: string, score: int>, "
           "periods: array<struct<period: int, homeScore: int, awayScore: int>>, "
           "events: array<struct<type: string, minute: int, player: string, playerIn: string, playerOut: string, team: string>>>>")

# table -> (key columns, value that stands for null per column). A key column without one keeps null rows apart.
KEYS = {
    "game_scores": (["league", "game_id", "home_score", "away_score", "status_text"], {}),
    "period_scores": (["league", "game_id", "period_number", "home_score", "away_score"], {}),
    "match_events": (["league", "game_id", "event_type", "minute", "player_name", "player_out", "team"],
                     {"minute": -1, "player_name": "", "player_out": ""}),
}
SCHEMAS = {
    "game_scores": "league string, game_id string, home_team string, home_score int, away_team string, away_score int, "
                   "status_text string, ingested_at timestamp, batch_id bigint",
    "period_scores": "league string, game_id string, period_number int, home_score int, away_score int, ingested_at timestamp, batch_id bigint",
    "match_events": "league string, game_id string, event_type string, minute int, player_name string, player_in string, "
                    "player_out string, team string, ingested_at timestamp, batch_id bigint",
}


def games(src: DataFrame, value: str = "value") -> DataFrame:
    """One row per league and game; works on a stream or a table."""
    d = src.select(F.from_json(F.col(value), PAYLOAD).alias("d"))
    return d.select(F.col("d.league").alias("league"), F.explode("d.games").alias("game"))


def _ids() -> dict:
    return {"league": F.col("league"), "game_id": F.col("game.gameId")}


def _score() -> dict:
    return {**_ids(), "home_team": F.col("game.homeTeam.teamName"), "home_score": F.col("game.homeTeam.score"),
            "away_team": F.col("game.awayTeam.teamName"), "away_score": F.col("game.awayTeam.score"), "status_text": F.col("game.statusText"),
            "ingested_at": F.current_timestamp()}


def _period(p: str = "p") -> dict:
    return {"period_number": F.col(f"{p}.period"), "home_score": F.col(f"{p}.homeScore"), "away_score": F.col(f"{p}.awayScore"),
            "ingested_at": F.current_timestamp()}


def _named(columns: dict) -> list:
    return [c.alias(n) for n, c in columns.items()]


def scores(g: DataFrame) -> DataFrame:
    return g.select(*_named(_score()))


def period_scores(g: DataFrame) -> DataFrame:
    p = explode_nonempty(g, "game.periods", "p", _named(_ids()))
    return p.select("league", "game_id", *_named(_period()))


def match_events(g: DataFrame) -> DataFrame:
    e = explode_nonempty(g, "game.events", "e", _named(_ids()))
    return event_columns(e).withColumn("ingested_at", F.current_timestamp())


BUILDERS = {"game_scores": scores, "period_scores": period_scores, "match_events": match_events}


def all_rows(g: DataFrame) -> DataFrame:
    """The rows that ``BUILDERS`` make, as (table, key, row, whole) with key and row in JSON, from one reading of the games.

    ``whole`` is false where a key column is null that ``KEYS`` names no value for.
    """
    types = {f.name: f.dataType for f in g.schema["game"].dataType}
    kinds = {"p": types["periods"].elementType, "e": types["events"].elementType}

    def part(table: str, **given):
        return F.struct(F.lit(table).alias("table"), *[given.get(n, F.lit(None).cast(t)).alias(n) for n, t in kinds.items()])

    def each(array: str, one):
        return F.transform(F.coalesce(f"game.{array}", F.array().cast(types[array])), one)

    parts = F.concat(F.array(part("game_scores")), each("periods", lambda p: part("period_scores", p=p)),
                     each("events", lambda e: part("match_events", e=e)))
    d = event_columns(g.select("league", "game", F.explode(parts).alias("x")).select("league", "game", "x.*"))
    event = {c: F.col(c) for c in ("event_type", "minute", "player_name", "player_in", "player_out", "team")}
    columns = {"game_scores": _score(), "period_scores": {**_ids(), **_period()},
               "match_events": {**_ids(), **event, "ingested_at": F.current_timestamp()}}
    of = lambda one: F.coalesce(*[F.when(F.col("table") == n, one(n, c)) for n, c in columns.items()])
    return d.select("table", of(_key).alias("key"), of(lambda n, c: F.to_json(F.struct(*_named(c)))).alias("row"), of(_whole).alias("whole"))


def _key_parts(table: str, columns: dict) -> dict:
    keys, null_safe = KEYS[table]
    return {k: F.coalesce(columns[k], F.lit(null_safe[k])) if k in null_safe else columns[k] for k in keys}


def _key(table: str, columns: dict):
    return F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in _key_parts(table, columns).items()]))


def _whole(table: str, columns: dict):
    return reduce(and_, [c.isNotNull() for c in _key_parts(table, columns).values()])


def inserted_once(rows: DataFrame, remember: str | None = None, at: str = "ingested_at") -> DataFrame:
    """Stream of (table, key, row) from ``all_rows``: of rows with equal keys only the first that ever came.

    The keys seen live in the state store, so a batch costs what it holds and never reads the tables. They are kept for good, or, with
    ``remember``, for that long after the watermark of the time column ``at``. Rows with a null in a key column all pass, unless ``KEYS``
    names a value that stands for it.
    """
    solid, rest = rows.filter("whole").drop("whole"), rows.filter("not whole").drop("whole")
    if remember is None:
        return solid.dropDuplicates(["table", "key"]).unionByName(rest)
    timed = solid.withColumn("_at", F.to_timestamp(F.get_json_object("row", f"$.{at}"))).withWatermark("_at", remember)
    return timed.dropDuplicatesWithinWatermark(["table", "key"]).drop("_at").unionByName(rest)


def write_batch(lake: Lake, log: CommitLog):
    """foreachBatch writer. A failing table fails the batch, which is then retried; nothing is skipped."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            log.append_all({name: batch.filter(F.col("table") == name).select(F.from_json("row", SCHEMAS[name]).alias("r")).select("r.*").drop("batch_id")
                            for name in BUILDERS}, batch_id)
        finally:
            batch.unpersist()
    return run


def start_scores(src: DataFrame, lake: Lake, checkpoint: str, trigger: dict | None = None, query: str = "scores", remember: str | None = None):
    rows = inserted_once(all_rows(games(src)), remember)
    return (rows.writeStream.queryName(query).foreachBatch(write_batch(lake, CommitLog(lake, query)))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start())


class LastSeen(StatefulProcessor):
    """Keeps the last fingerprint per key and passes rows on only when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fp string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows)).sort_values("ord", kind="stable")
        before = d["fp"].shift()
        if self.last.exists():
            before.iloc[0] = self.last.get()[0]
        self.last.update((d["fp"].iloc[-1],))
        yield d[d["fp"] != before][["key", "ord", "fp", "value"]]

    def close(self) -> None:
        pass


def changes_only_stream(stream: DataFrame) -> DataFrame:
    """stream: key, ord (order within the key), fp (fingerprint), value."""
    return stream.select("key", "ord", "fp", "value").groupBy("key").transformWithStateInPandas(
        statefulProcessor=LastSeen(), outputStructType="key string, ord bigint, fp string, value string",
        outputMode="Append", timeMode="None")


def fingerprint(game: str = "game"):
    """Text that changes whenever a viewer would see a change."""
    g = lambda p: F.coalesce(F.col(f"{game}.{p}").cast("string"), F.lit(""))
    return F.concat_ws("_", g("gameId"), g("homeTeam.score"), g("awayTeam.score"), g("statusText"),
                       F.greatest(F.size(f"{game}.events"), F.lit(0)).cast("string"))
