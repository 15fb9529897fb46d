"""Parsing and validation of tracking messages, all in native columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.reshape import attribute_by_key, first_failing

ENTITY = ("struct<entity_type: string, canonical_player_id: string, team_id: string, x_m: double, y_m: double, z_m: double, "
          "x_att: double, y_att: double, is_detected: boolean, position_source: string>")
ENVELOPE = (
    "schema_version string, record_type string, source string, source_revision string, sport string, match_id string, "
    "record_id string, source_frame_id bigint, period int, physical_time_ms bigint, match_elapsed_ms bigint, "
    "source_clock string, possession_team_id string, replay_session_id string, replay_event_time string, "
    "produced_at string, sequence bigint, attempt int, end_of_stream boolean, quality_flags array<string>, "
    f"ball {ENTITY}, players array<{ENTITY}>")
MAX_ENTITIES = 40


def with_validation(df: DataFrame) -> DataFrame:
    """Adds the parsed message ``e`` and ``invalid_reason`` (null when valid). The first failing rule names it."""
    e = lambda n: F.col(f"e.{n}")
    d = df.withColumn("e", F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"}))
    end = F.coalesce(e("end_of_stream"), F.lit(False))
    full_key = F.concat_ws("|", e("replay_session_id"), e("match_id"))
    rules = [
        ("unparseable_or_missing_match_id", F.col("e").isNull() | e("match_id").isNull()),
        ("missing_replay_session_id", e("replay_session_id").isNull()),
        ("unsupported_schema_version", ~F.coalesce(e("schema_version"), F.lit("")).startswith("1.")),
        ("wrong_record_type", e("record_type") != "tracking_frame"),
        ("bad_sequence", e("sequence").isNull() | (e("sequence") < 0)),
        ("missing_physical_time", ~end & e("physical_time_ms").isNull()),
        ("negative_physical_time", ~end & (e("physical_time_ms") < 0)),
        ("too_many_entities", F.coalesce(F.size(e("players")), F.lit(0)) > MAX_ENTITIES),
        ("key_envelope_mismatch", F.col("key").isNotNull() & (F.col("key") != full_key)),
    ]
    return d.withColumn("invalid_reason", first_failing(rules))


def attributed(df: DataFrame) -> DataFrame:
    """Session and match ids, taken from the message key where the message cannot be read."""
    d = df.withColumns({"_s": F.col("e.replay_session_id"), "_m": F.col("e.match_id"), "sequence": F.col("e.sequence")})
    return attribute_by_key(d, "key", "session_id", "match_id", "_s", "_m").drop("_s", "_m")
