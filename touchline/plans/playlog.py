"""Play log -> hits, score, accuracy, grade, leaderboard."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scoring
from touchline.operators import aggregates as agg
from touchline.operators import joins, ordered
from touchline.operators.windows import streak_score

# Fixed values
PERFECT, GOOD, GOOD_WINDOW_MS, BOARD = 100, 50, 200, 10


def score_plays(notes: DataFrame, presses: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Every note of every play with quality, streak and points. A miss counts when its window has passed."""
    h = joins.hit_match(notes, presses, hot_rows=hot_rows)
    h = h.withColumn("at_ms", F.coalesce("press_ms", F.col("time_ms") + GOOD_WINDOW_MS))
    chunk = ordered.split_if_hot(h, ["play_id"], ordered.by_number("at_ms", 60_000), hot_rows)
    base = F.when(F.col("quality") == "PERFECT", PERFECT).otherwise(GOOD)
    return streak_score(h, ["play_id"], ["at_ms", "time_ms", "note_id"], F.col("quality") != "MISS", base, chunk)


def results(scored: DataFrame) -> DataFrame:
    d = agg.play_summary(scored)
    return d.withColumns({"grade": scoring.grade("accuracy"), "stars": scoring.stars("accuracy")})


def leaderboard(plays: DataFrame, song: str = "song_id", k: int = BOARD) -> DataFrame:
    return ordered.top_k(plays, [song], [F.desc("score"), F.asc("play_id")], k)
