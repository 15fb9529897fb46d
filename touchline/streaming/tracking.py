"""Tracking stream: bronze with quarantine, then released frames -> observations, windows, dwell and shape.

Entities keep their movement, open windows and cells in the state store (``streaming.windows``), spread by entity. Each micro-batch
writes what came out of it in one commit per table and batch id, so a retried batch replaces its own output. Team shape is a plan over
the batch's positions; of a team only the sums of its open windows go from batch to batch, in a table whose old batches are removed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.parsing import safe_round
from touchline.operators import ordered, tracking
from touchline.sinks.tables import CommitLog, Lake, quarantine
from touchline.streaming.reorder import released
from touchline.streaming.validate import attributed, with_validation
from touchline.streaming.windows import entity_rows

# fixed values: names and order of the tables' columns are what readers of the lake expect
OBS = ("session_id string, match_id string, seq bigint, t_ms bigint, mel_ms bigint, period int, entity_id string, "
       "entity_type string, team_id string, x_m double, y_m double, z_m double, x_att double, y_att double, "
       "is_detected boolean, position_source string, speed_mps double, accel_mps2 double, dist_raw_m double, dist_m double, "
       "segment_start boolean, gap_ms bigint, implausible boolean, cell_x int, cell_y int, feature_version string, batch_id bigint")
PLAYER_WINDOW = ("session_id string, match_id string, entity_id string, team_id string, window bigint, window_start_ms bigint, "
                 "window_end_ms bigint, is_final boolean, distance_m double, distance_raw_m double, active_ms bigint, "
                 "detected_ms bigint, hi_ms bigint, sprint_ms bigint, hi_distance_m double, sprint_count bigint, "
                 "accel_count bigint, decel_count bigint, max_speed_mps double, in_poss_ms bigint, out_poss_ms bigint, "
                 "poss_unknown_ms bigint, n_intervals bigint, excluded_gap_ms bigint, no_cell_ms bigint, version bigint, "
                 "feature_version string, batch_id bigint")
TEAM_WINDOW = ("session_id string, match_id string, team_id string, window bigint, window_start_ms bigint, window_end_ms bigint, "
               "is_final boolean, n_frames bigint, n_sufficient bigint, in_possession_frames bigint, mean_centroid_x double, "
               "mean_width_m double, mean_depth_m double, mean_hull_area_m2 double, mean_def_line_height_m double, "
               "version bigint, feature_version string, batch_id bigint")
DWELL = ("session_id string, match_id string, entity_id string, team_id string, window bigint, cell_x int, cell_y int, "
         "dwell_ms bigint, is_final boolean, version bigint, feature_version string, batch_id bigint")
TEAM_FRAME = ("session_id string, match_id string, seq bigint, t_ms bigint, mel_ms bigint, period int, team_id string, n_outfield bigint, "
              "n_detected bigint, sufficient boolean, in_possession boolean, centroid_x double, centroid_y double, width_m double, "
              "depth_m double, hull_area_m2 double, def_line_height_m double, spacing_hull_m2 double, mean_pairwise_m double, "
              "paint_count bigint, corner_count bigint, nearest_def_to_ball_m double, offense boolean, feature_version string, batch_id bigint")
FRAME = ("session_id string, match_id string, seq bigint, source_frame_id bigint, t_ms bigint, mel_ms bigint, period int, clock string, "
         "poss_team string, n_players int, n_detected int, has_ball boolean, flags string, attempt int, replay_event_time timestamp, "
         "produced_at timestamp, processed_at timestamp, feature_version string, batch_id bigint")
BRONZE = ("topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp, key string, value string, "
          "replay_session_id string, match_id string, sequence bigint, valid boolean, invalid_reason string, ingested_at timestamp, batch_id bigint")
QUARANTINE = ("detected_at timestamp, session_id string, match_id string, seq bigint, reason string, detail string, "
              "raw_value string, kafka_partition int, kafka_offset bigint, batch_id bigint")
STATS = "session_id string, match_id string, emitted_at timestamp, stats string, batch_id bigint"
_SHAPES = ", ".join(f"sum_{c} double, cnt_{c} bigint" for c in tracking.SHAPE)
OPEN_TEAM = ("session_id string, match_id string, team_id string, window bigint, offset_ms bigint, n_frames bigint, "
             f"n_sufficient bigint, in_possession_frames bigint, {_SHAPES}, part bigint, batch_id bigint")

SCHEMAS = {
    "bronze.tracking_raw": BRONZE, "silver.tracking_frames": FRAME, "silver.tracking_positions": OBS,
    "gold.team_frame_metrics": TEAM_FRAME, "gold.player_windows": PLAYER_WINDOW, "gold.team_windows": TEAM_WINDOW,
    "gold.spatial_dwell": DWELL, "ops.quarantine": QUARANTINE, "ops.late": QUARANTINE, "ops.stream_stats": STATS,
    "state.team_windows": OPEN_TEAM,
}


def open_lake(spark: SparkSession, root: str) -> Lake:
    """Tables of the stream; what is read by match is divided by match."""
    by_match = [n for n, s in SCHEMAS.items() if n.startswith(("silver.", "gold.")) and "match_id string" in s]
    return Lake(spark, root, SCHEMAS, {n: ["match_id"] for n in by_match})


def start_bronze(messages: DataFrame, lake: Lake, checkpoint: str, trigger: dict | None = None, query: str = "bronze"):
    """Every message with its verdict, and the rejected ones in quarantine."""
    log = CommitLog(lake, query)

    def write(batch: DataFrame, batch_id: int) -> None:
        d = attributed(with_validation(batch)).persist()
        try:
            raw = d.select(
                "topic", "kafka_partition", "kafka_offset", "kafka_ts", "key", "value",
                F.col("session_id").alias("replay_session_id"), "match_id", "sequence",
                F.col("invalid_reason").isNull().alias("valid"), "invalid_reason",
                F.current_timestamp().alias("ingested_at"))
            bad = quarantine(d.filter(F.col("invalid_reason").isNotNull()))
            log.append_all({"bronze.tracking_raw": raw, "ops.quarantine": bad}, batch_id)
        finally:
            d.unpersist()

    return (messages.writeStream.queryName(query).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


# what a frame row of ``windows.units`` carries besides its columns
NOTE = ("source_frame_id bigint, clock string, n_players int, n_detected int, has_ball boolean, flags string, attempt int, "
        "replay_event_time string, produced_at string")
LATE = "seq bigint, reason string, t bigint, attempt int"
KEY = ["session_id", "match_id"]



class Engine:
    """Writes the rows of one micro-batch (``windows.entity_rows``) into the silver and gold tables."""

    def __init__(self, lake: Lake, cfg: tracking.Sport, periods: DataFrame, teams: DataFrame, keepers: DataFrame,
                 query: str = "engine"):
        self.lake, self.cfg, self.periods, self.teams, self.keepers = lake, cfg, periods, teams, keepers
        self.log = CommitLog(lake, query)
        self.version = f"{cfg.name}-{cfg.version}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():            # a timer tick without output leaves state as it is
                return
            last = self.log.last("state.team_windows", batch_id)
            before = self.lake.read("state.team_windows").filter(F.col("batch_id") == (-1 if last is None else last)).drop("batch_id")
            self.log.append_all(self.tables(batch, before, batch_id), batch_id)
            if last is not None:
                self.lake.prune("state.team_windows", last)         # a retry of this batch reads ``last`` again
        finally:
            batch.unpersist()

    def tables(self, batch: DataFrame, open_teams: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        """Table -> rows of this batch."""
        cfg, version = self.cfg, {"feature_version": F.lit(self.version)}
        of = lambda *kinds: batch.filter(F.col("kind").isin(*kinds))
        late = of("late").withColumn("p", F.from_json("payload", LATE))
        fr = of("frame").withColumn("p", F.from_json("payload", NOTE))
        pos = of("position", "unusable")
        window = of("window").select(*KEY, F.from_json("payload", PLAYER_WINDOW).alias("p")).select(*KEY, *[f"p.{c}" for c in _payload_of(PLAYER_WINDOW)])
        cells = of("dwell").select(*KEY, F.from_json("payload", DWELL).alias("p")).select(*KEY, *[f"p.{c}" for c in _payload_of(DWELL)])
        tf = tracking.team_frames(pos, fr.drop("p"), self.keepers, cfg, self.teams, hooks=tracking.HOOKS[cfg.name])
        done, still = self._team_windows(batch, fr, tf, open_teams, batch_id)
        return {
            "ops.late": late.select(
                F.current_timestamp().alias("detected_at"), *KEY, "seq", F.col("p.reason").alias("reason"),
                F.concat(F.lit("t_ms="), F.coalesce(F.col("p.t").cast("string"), F.lit("")), F.lit(" attempt="),
                         F.col("p.attempt").cast("string")).alias("detail"), F.lit("").alias("raw_value")),
            "ops.stream_stats": of("stats").select(*KEY, F.current_timestamp().alias("emitted_at"), F.col("payload").alias("stats")),
            "silver.tracking_frames": fr.select(
                *KEY, "seq", "p.source_frame_id", "t_ms", "mel_ms", "period", "p.clock", F.col("possession").alias("poss_team"), "p.n_players",
                "p.n_detected", "p.has_ball", "p.flags", "p.attempt", F.to_timestamp("p.replay_event_time").alias("replay_event_time"),
                F.to_timestamp("p.produced_at").alias("produced_at"), F.current_timestamp().alias("processed_at")).withColumns(version),
            "silver.tracking_positions": of("position").withColumns(
                {**{c: safe_round(c) for c in ("x_m", "y_m", "z_m", "x_att", "y_att", "speed_mps", "accel_mps2", "dist_raw_m", "dist_m")}, **version}),
            "gold.player_windows": window.withColumns({**{c: safe_round(c) for c in ("distance_m", "distance_raw_m", "hi_distance_m", "max_speed_mps")}, **version}),
            "gold.spatial_dwell": cells.withColumns(version),
            "gold.team_frame_metrics": tf.withColumns(
                {**{c: safe_round(c) for c in ("centroid_x", "centroid_y", "width_m", "depth_m", "hull_area_m2", "def_line_height_m")}, **version}),
            "gold.team_windows": done.withColumns(version), "state.team_windows": still}

    def _team_windows(self, batch: DataFrame, fr: DataFrame, tf: DataFrame, open_teams: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(windows that closed as final and open ones that changed as partial; sums of the open ones)."""
        cfg = self.cfg
        mine = tracking.team_windows(tf, self.periods, cfg).withColumn("part", F.lit(batch_id).cast("bigint"))
        rows = tracking.add_up_team_windows(open_teams.unionByName(mine))
        now = fr.filter(F.col("t_ms").isNotNull()).groupBy(*KEY).agg(F.max_by(F.struct("t_ms", "period"), "seq").alias("n"))
        # matches without rows in this batch stay as they are
        c = batch.groupBy(*KEY).agg(F.max("released_upto").alias("c_upto"), (F.count_if(F.col("kind") == "end") > 0).alias("c_ended")) \
            .join(now, KEY, "left").select(*KEY, "c_upto", "c_ended", F.col("n.t_ms").alias("c_t"), F.col("n.period").alias("c_period"))
        d = rows.join(c, KEY, "left")
        # a team window closes with the first frame of a later window
        now_w = F.col("c_period") * 10000 + F.floor(F.greatest(F.col("c_t") - F.col("offset_ms"), F.lit(0)) / cfg.window_ms)
        closed = F.col("c_ended") | (F.floor(F.col("window") / 10000) != F.col("c_period")) | (F.col("window") < now_w)
        d = d.withColumn("is_final", F.coalesce(closed, F.lit(False)))
        out = tracking.with_bounds(tracking.team_means(d.filter(F.col("is_final") | (F.col("part") == batch_id))), cfg)
        out = out.withColumns({"version": F.col("c_upto") * 2 + F.col("is_final").cast("int"), **{f"mean_{c}": safe_round(f"mean_{c}") for c in tracking.SHAPE}})
        return out, d.filter(~F.col("is_final"))


def _payload_of(table: str) -> list[str]:
    """The columns of a table that its rows' payload holds."""
    names = [c.split()[0] for c in table.split(", ")]
    return [c for c in names if c not in (*KEY, "feature_version", "batch_id")]


def start_engine(messages: DataFrame, engine: Engine, checkpoint: str, trigger: dict | None = None, query: str = "engine"):
    valid = attributed(with_validation(messages)).filter(F.col("invalid_reason").isNull())
    rows = entity_rows(released(valid, engine.cfg.reorder_frames, engine.cfg.idle_ms), engine.periods, engine.cfg)
    return (rows.writeStream.queryName(query).foreachBatch(engine).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def final_rows(df: DataFrame, keys) -> DataFrame:
    """Serving view: newest version per key, final rows only."""
    return ordered.latest_by(df, keys, ["version"]).filter("is_final")


def processing_lag(frames: DataFrame) -> DataFrame:
    return frames.withColumn("lag_ms", F.unix_millis("processed_at") - F.unix_millis("produced_at"))


