"""Test match with known motion: 22 players on circles at constant speed, two periods, one tracking gap."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_MS, RADIUS = 100, 8.0


def speed(j: int) -> float:
    return 1.5 + 0.5 * (j % 6)


def build(spark: SparkSession, period_s: int = 150, match: str = "test:m1", session: str = "s1") -> dict[str, DataFrame]:
    per = period_s * 1000 // FRAME_MS
    f = spark.range(2 * per).select(
        F.lit(session).alias("session_id"), F.lit(match).alias("match_id"), F.col("id").alias("seq"),
        F.col("id").alias("source_frame_id"), (F.floor(F.col("id") / per) + 1).cast("int").alias("period"),
        (F.col("id") * FRAME_MS).alias("t_ms"), (F.col("id") * FRAME_MS).alias("mel_ms"))
    home, away = "team:home", "team:away"
    f = f.withColumn("possession", F.when(F.floor(F.col("t_ms") / 10000) % 2 == 0, home).otherwise(away))
    pel = F.col("t_ms") % (period_s * 1000)
    j = F.col("j")
    e = f.withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(21))))
    e = e.filter(~((j == 0) & (F.col("period") == 1) & (pel >= 40000) & (pel < 43000)))
    v = 1.5 + 0.5 * (j % 6)
    a = v / RADIUS * F.col("t_ms") / 1000.0
    cx, cy = -30.0 + (j % 11) * 6.0, F.when(j < 11, -20.0).otherwise(20.0)
    ball = j == -1
    e = e.withColumns({
        "entity_type": F.when(ball, "ball").otherwise("player"),
        "entity_id": F.when(ball, "ball").otherwise(F.concat(F.lit("player:"), j.cast("string"))),
        "team_id": F.when(j < 0, None).when(j < 11, home).otherwise(away),
        "x_m": F.when(ball, 0.0).otherwise(cx + RADIUS * F.cos(a)), "y_m": F.when(ball, 0.0).otherwise(cy + RADIUS * F.sin(a)),
        "is_detected": (j % 3 != 0) | ball})
    side = F.coalesce("team_id", "possession") == home
    sign = F.when(side == (F.col("period") == 1), 1.0).otherwise(-1.0)
    e = e.withColumns({"x_att": F.col("x_m") * sign, "y_att": F.col("y_m") * sign, "z_m": F.lit(None).cast("double"),
                       "position_source": F.when(F.col("is_detected"), "observed").otherwise("provider_extrapolated")})
    frames = f.withColumns({"frame_quality_flags": F.lit(""), "possession_team_id": F.col("possession")})
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "frames": frames, "positions": e.drop("j"),
        "periods": mk([(match, 1, 0), (match, 2, period_s * 1000)], "match_id string, period int, offset_ms bigint"),
        "teams": mk([(match, home), (match, away)], "match_id string, team_id string"),
        "keepers": mk([(match, "player:0"), (match, "player:11")], "match_id string, entity_id string")}
