"""Read views over the lake: frames, heatmap, players, team metrics, health, sessions, catalog."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import aggregates as agg
from touchline.operators import ordered
from touchline.operators.reshape import every_nth, redistributable_only


def frames(positions: DataFrame, start: int, limit: int = 300, by_time: bool = False,
           key: Sequence[str] = ("session_id", "match_id")) -> DataFrame:
    """A page of whole frames from a cursor on. Frame numbers are chosen first, so only their rows are nested."""
    col = "t_ms" if by_time else "seq"
    d = positions.filter(F.col(col) >= start)
    page = d.select(*key, "seq").distinct().orderBy("seq", *key).limit(limit)
    d = d.join(page, [*key, "seq"], "left_semi")
    ent = F.struct("entity_id", "entity_type", F.coalesce("team_id", F.lit("")).alias("team_id"), F.round("x_m", 2).alias("x"),
                   F.round("y_m", 2).alias("y"), F.coalesce("is_detected", F.lit(False)).alias("is_detected"),
                   F.round(F.coalesce("speed_mps", F.lit(-1.0)), 2).alias("speed"))
    return d.groupBy(*key, "seq").agg(F.min("t_ms").alias("t"), F.min("period").alias("period"),
                                      F.array_sort(F.collect_list(ent)).alias("ents")).orderBy("seq", *key)


def heatmap(dwell: DataFrame, windows: DataFrame, entity: str | None = None, team: str | None = None, period: int | None = None):
    """Cells with dwell time, and the totals they must add up to."""
    def keep(d):
        for c, v in (("entity_id", entity), ("team_id", team)):
            d = d if v is None else d.filter(F.col(c) == v)
        return d if period is None else d.filter(F.floor(F.col("window") / 10000) == period)
    w = keep(windows)
    return agg.heatmap(keep(dwell)), w.agg(F.sum("active_ms").alias("active_ms"), F.sum("no_cell_ms").alias("no_cell_ms"),
                                           F.sum("excluded_gap_ms").alias("excluded_ms"))


def players(windows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Player table of a match (one team sheet long), most distance first."""
    t = agg.rates(agg.player_totals(windows))
    if meta is not None:
        t = t.join(meta, "entity_id", "left")
    return t.orderBy(F.desc("distance_m"), "entity_id")


def team_series(team_frames: DataFrame, step: int = 10) -> DataFrame:
    return every_nth(team_frames, "seq", step)


def latency(frames_table: DataFrame, by: Sequence[str] = ("session_id", "match_id")) -> DataFrame:
    lag = F.unix_millis("processed_at") - F.unix_millis("produced_at")
    q = agg.exact_quantiles(frames_table.withColumn("lag_ms", lag), "lag_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, by)
    n = frames_table.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.max("seq").alias("max_seq"),
                                      F.max("processed_at").alias("last_processed"))
    return n.join(q, list(by), "left")


def sinks(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("query_name").agg(
        F.count_distinct("batch_id").alias("batches"), F.max("committed_at").alias("last_commit"),
        F.avg("duration_ms").alias("avg_ms"), F.sum("rows").alias("rows"))


def sessions(registry: DataFrame, match_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest state per session, newest first."""
    d = ordered.latest_by(registry, ["session_id"], ["updated_at"])
    if match_id is not None:
        d = d.filter(F.col("match_id") == match_id)
    return d.orderBy(F.desc("updated_at"), "session_id").limit(limit)


def catalog(matches: DataFrame, licenses: DataFrame, quality: DataFrame, public: bool = False) -> DataFrame:
    d = matches.join(licenses, "source", "left").join(quality, "match_id", "left")
    return redistributable_only(d, licenses, "source") if public else d
