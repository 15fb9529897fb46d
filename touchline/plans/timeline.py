"""Score timeline of a match on tracking time."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import parsing as ps
from touchline.operators import joins


def scoring_events(rows: DataFrame) -> DataFrame:
    """Scoring rows of a play-by-play table with both scores and elapsed game time.

    Rows whose score and margin disagree get ``conflict`` and no place on the timeline; the caller quarantines
    them.
    """
    d = rows.withColumn("s", ps.parse_score("SCORE", "SCOREMARGIN")).filter(F.col("s.home").isNotNull())
    period = F.col("PERIOD").cast("int")
    clock = ps.parse_clock("PCTIMESTRING", "mmss")
    return d.select("GAME_ID", F.col("EVENTNUM").cast("int").alias("event_num"), period.alias("period"),
                    F.col("PCTIMESTRING").alias("clock"), ps.elapsed_game_ms(period, clock).alias("mel_ms"),
                    F.col("s.home").alias("home"), F.col("s.away").alias("away"), F.col("s.conflict").alias("conflict"))


def place(events: DataFrame, frames: DataFrame, by=("match_id", "period"), hot_rows: int | None = None) -> DataFrame:
    """events: by columns + mel_ms; frames: by columns + mel_ms, t_ms."""
    f = frames.withColumnRenamed("t_ms", "frame_t")
    return joins.place_on_frames(events, f, list(by), "mel_ms", "mel_ms", "frame_t", hot_rows=hot_rows)
