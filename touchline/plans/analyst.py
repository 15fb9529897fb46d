"""Analyst tools over window tables. Each takes scope arguments and returns facts with evidence ids."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.parsing import clock_from_ms
from touchline.operators import aggregates as agg
from touchline.operators import changes, moments, quality
from touchline.operators.reshape import scoped
from touchline.operators.windows import top_n

TEAM_METRICS = ["width_m", "depth_m", "hull_area_m2", "def_line_height_m", "centroid_x"]
PLAYER_METRICS = ["distance_m", "hi_distance_m", "sprints", "max_speed_mps", "distance_per_active_min_m"]


def _allowed(value: str, options: Sequence[str], what: str) -> None:
    if value not in options:
        raise ValueError(f"{what} {value!r} is not allowed")


def _within(value: int, low: int, high: int, what: str) -> int:
    if not low <= int(value) <= high:
        raise ValueError(f"{what} must be from {low} to {high}, not {value}")
    return int(value)


def team_shape_trend(team_windows: DataFrame, scope: dict, metric: str = "width_m", bucket_min: int = 10,
                     team_id: str | None = None, teams: Sequence[str] | None = None) -> DataFrame:
    """First and last bucket mean of a shape metric per team, and the difference."""
    _allowed(metric, TEAM_METRICS, "metric")
    if team_id is not None and teams is not None:
        _allowed(team_id, teams, "team_id")
    width = _within(bucket_min, 1, 45, "bucket_min") * 60000
    d = scoped(team_windows, {"session_id": scope.get("session_id"), "match_id": scope.get("match_id"), "team_id": team_id},
               scope.get("as_of_ms")).filter(F.col("n_sufficient") > 0)
    t = agg.bucket_trend(d, ["team_id"], "window_start_ms", f"mean_{metric}", width)
    ev = lambda c: F.format_string("team_windows:%s:t=%d", "team_id", F.col(c).cast("bigint"))
    return t.withColumns({"value": F.round("delta", 2), "first_clock": clock_from_ms("first_t"), "last_clock": clock_from_ms("last_t"),
                          "evidence_ids": F.array(ev("first_t"), ev("last_t"))})


def top_players(player_windows: DataFrame, scope: dict, metric: str = "distance_m", n: int = 5, team_id: str | None = None,
                teams: Sequence[str] | None = None, meta: DataFrame | None = None) -> DataFrame:
    """Ranking of players; per-minute ranking needs ten active minutes."""
    _allowed(metric, PLAYER_METRICS, "metric")
    if team_id is not None and teams is not None:
        _allowed(team_id, teams, "team_id")
    d = scoped(player_windows, {"session_id": scope.get("session_id"), "match_id": scope.get("match_id"), "team_id": team_id}, scope.get("as_of_ms"))
    t = agg.player_totals(d).withColumn("distance_per_active_min_m", F.col("distance_m") / (F.col("active_ms") / 60000))
    if metric == "distance_per_active_min_m":
        t = t.filter(F.col("active_ms") >= 10 * 60000)
    t = top_n(t, metric, _within(n, 1, 10, "n"), ["entity_id"])
    if meta is not None:
        t = t.join(meta, "entity_id", "left")
    return t.withColumns({"value": F.round(F.col(metric).cast("double"), 2),
                          "evidence_id": F.concat(F.lit("player_windows:"), F.col("entity_id"))})


def quality_gaps(quarantine: DataFrame, team_windows: DataFrame, player_windows: DataFrame, scope: dict) -> DataFrame:
    eq = {"session_id": scope.get("session_id"), "match_id": scope.get("match_id")}
    cut = scope.get("as_of_ms")
    return quality.quality_gaps(scoped(quarantine, eq), scoped(team_windows, eq, cut), scoped(player_windows, eq, cut))


def shape_changes(team_seconds: DataFrame, by: Sequence[str], features: Sequence[str], as_of_ms: int | None = None,
                  team_id: str | None = None, top: int = 5, bin_s: int = changes.BIN_S) -> DataFrame:
    """Largest detected shifts before the cutoff, in time order."""
    d = team_seconds if as_of_ms is None else team_seconds.filter(F.col("t_ms") <= as_of_ms)
    c = changes.change_points(d, by, features, bin_s)
    if as_of_ms is not None:
        c = c.filter(F.col("t_ms") <= as_of_ms)
    if team_id is not None:
        c = c.filter(F.col("team_id") == team_id)
    c = top_n(c, "magnitude_z", _within(top, 1, 10, "top"), [F.asc("t_ms"), *by])
    return changes.evidence(c, "change", *by, "t_ms").orderBy("t_ms", *by)


def similar_moments(index: DataFrame, at: dict, t_ms: int, as_of_ms: int, k: int = 5) -> DataFrame:
    m = index.filter(F.col("t_ms") <= as_of_ms)
    return moments.similar_moments(m, at, min(t_ms, as_of_ms), _within(k, 1, 10, "k")).withColumn(
        "evidence_id", F.concat(F.lit("moment:t="), F.col("t_ms").cast("string")))
