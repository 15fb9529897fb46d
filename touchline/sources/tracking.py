"""Tracking data of three providers -> one normalized form (frames, positions, periods, players, quality).

Normalized positions: match_id, seq, source_frame_id, period, t_ms, mel_ms, entity_type, entity_id, team_id,
x_m, y_m, x_att, y_att, is_detected, position_source, possession, flags. Frames: the frame columns with counts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.functions.identity import ns_id
from touchline.functions.parsing import clock_mm_ss_cc, elapsed_game_ms, join_flags
from touchline.operators import aggregates as agg
from touchline.operators import joins, ordered, windows
from touchline.operators.reshape import unpivot_tracking


# ---------------------------------------------------------------- provider A: JSON lines, one frame per line
FRAME_LINE = ("frame bigint, period int, timestamp string, possession struct<player_id bigint, `group` string>, "
              "ball_data struct<x double, y double, z double, is_detected boolean>, "
              "player_data array<struct<player_id bigint, x double, y double, is_detected boolean>>")


def read_frames_jsonl(spark: SparkSession, path: str, schema: str = FRAME_LINE) -> DataFrame:
    """One JSON frame per line, read with a fixed schema (no inference pass). ``line`` grows along the file."""
    return spark.read.schema(schema).json(path).withColumn("line", F.monotonically_increasing_id())


def normalize_frame_lines(lines: DataFrame, match: DataFrame, players: DataFrame, source: str = "skillcorner",
                          frame_ms: int = 100, hot_rows: int | None = None) -> dict[str, DataFrame]:
    """lines: match_id + frame columns. match: match_id, home_id, away_id, period, start_frame, end_frame, home_side.
    players: match_id, player_id, team_id."""
    known = lines.join(match.select("match_id", "period"), ["match_id", "period"], "left_semi")
    dropped = lines.groupBy("match_id").agg(F.count(F.lit(1)).alias("_all")).join(
        known.groupBy("match_id").agg(F.count(F.lit(1)).alias("_known")), "match_id", "left")
    # period offsets: the later of the metadata end and the last frame seen
    seen = known.groupBy("match_id", "period").agg(F.max("frame").alias("_seen_end"))
    p = match.join(seen, ["match_id", "period"], "left")
    end = F.greatest(F.col("end_frame"), F.coalesce("_seen_end", F.lit(0)))
    p = p.withColumn("duration_ms", (end - F.col("start_frame") + 1) * frame_ms)
    p = windows.period_offsets(p, ["match_id"], "period", "duration_ms")
    # frames that repeat or go back in the file are the ones not above the running maximum
    by_line = ordered.split_if_hot(known, ["match_id"], ordered.by_number("line", 100_000), hot_rows)
    kept = joins.monotonic_only(known, "frame", ["match_id"], ["line"], by_line)
    chunk = None if by_line is None else ordered.by_number("frame", 10_000)
    kept = ordered.with_sequence(kept, "seq", ["match_id"], ["frame"], chunk)
    f = kept.join(p.select("match_id", "period", "start_frame", "offset_ms", "home_id", "away_id"), ["match_id", "period"])
    group = F.col("possession.group")
    poss = F.when(group == "home team", ns_id(source, "team", "home_id")).when(group == "away team", ns_id(source, "team", "away_id"))
    n = F.when(F.col("player_data").isNull(), 0).otherwise(F.size("player_data"))
    det = F.size(F.filter("player_data", lambda e: F.coalesce(e["is_detected"], F.lit(False))))
    ball = F.col("ball_data.x").isNotNull() & F.col("ball_data.y").isNotNull()
    f = f.withColumns({
        "period_elapsed_ms": (F.col("frame") - F.col("start_frame")) * frame_ms,
        "n_players": n, "n_players_detected": F.when(n > 0, det).otherwise(0), "has_ball": ball, "possession_team_id": poss,
        "possession_player_id": ns_id(source, "player", "possession.player_id")})
    f = f.withColumns({
        "t_ms": F.col("offset_ms") + F.col("period_elapsed_ms"),
        "frame_quality_flags": join_flags(
            no_ball=~F.col("has_ball"), no_entities=F.col("n_players") == 0,
            provider_extrapolated=(F.col("n_players") > 0) & (F.col("n_players_detected") < F.col("n_players")))})
    frames = f.select("match_id", "seq", F.col("frame").alias("source_frame_id"), "period", F.col("timestamp").alias("source_clock"),
                      "period_elapsed_ms", F.col("t_ms").alias("mel_ms"), "t_ms", "n_players", "n_players_detected",
                      "has_ball", "possession_team_id", "possession_player_id", "frame_quality_flags")
    key = ["match_id", "seq", F.col("frame").alias("source_frame_id"), "period", "t_ms", "possession_team_id", "frame_quality_flags"]
    b = f.filter("has_ball").select(*key, F.lit("ball").alias("entity_type"), F.lit(None).cast("bigint").alias("player_id"),
                                    F.lit(f"{source}:ball").alias("entity_id"), F.col("ball_data.x").alias("x_m"),
                                    F.col("ball_data.y").alias("y_m"), F.col("ball_data.is_detected").alias("is_detected"))
    e = f.select(*key, F.explode("player_data").alias("e")).select(
        "match_id", "seq", "source_frame_id", "period", "t_ms", "possession_team_id", "frame_quality_flags",
        F.lit("player").alias("entity_type"), F.col("e.player_id").alias("player_id"),
        ns_id(source, "player", "e.player_id").alias("entity_id"), F.col("e.x").alias("x_m"), F.col("e.y").alias("y_m"),
        F.col("e.is_detected").alias("is_detected"))
    roster = players.select("match_id", "player_id", ns_id(source, "team", "team_id").alias("team_id"),
                            ns_id(source, "player", "player_id").alias("entity_id"))
    pos = b.unionByName(e).join(roster.select("match_id", "player_id", "team_id"), ["match_id", "player_id"], "left")
    side = F.when(F.col("home_side") == "left_to_right", 1.0).otherwise(-1.0)
    sign = match.select("match_id", "period", ns_id(source, "team", "home_id").alias("team_id"), side.alias("sign")).unionByName(
        match.select("match_id", "period", ns_id(source, "team", "away_id").alias("team_id"), (-side).alias("sign")))
    pos = joins.attack_normalize(pos, sign)
    pos = pos.withColumn("position_source", F.when(F.col("is_detected").isNull(), "unknown")
                         .when(F.col("is_detected"), "observed").otherwise("provider_extrapolated")).drop("player_id")
    quality = agg.match_quality(frames, pos, roster)
    quality = quality.join(dropped, "match_id", "left").withColumns({
        "dropped_no_period": F.col("_all") - F.coalesce("_known", F.lit(0)),
        "non_monotonic": F.coalesce("_known", F.lit(0)) - F.col("frames")}).drop("_all", "_known")
    gaps = windows.gap_segments(frames.withColumn("has", F.col("n_players") > 0), ["match_id"], "t_ms", "has", 5000, frame_ms)
    return {"frames": frames, "positions": pos, "periods": p.select("match_id", "period", "offset_ms", "duration_ms"),
            "direction": sign, "quality": quality, "gaps": gaps}


def direction_agreement(phases: DataFrame, match: DataFrame) -> DataFrame:
    """Provider phase labels against the declared sides: validated above 0.99 agreement."""
    d = phases.join(match.select("match_id", "period", "home_id", "home_side"), ["match_id", "period"])
    other = F.when(F.col("home_side") == "left_to_right", "right_to_left").otherwise("left_to_right")
    want = F.when(F.col("team_in_possession_id") == F.col("home_id"), F.col("home_side")).otherwise(other)
    return agg.agreement(d, ["match_id"], F.coalesce(F.col("attacking_side") == want, F.lit(False)), 0.99)


def events_on_frames(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Event time from the frame it starts on (null when that frame is unknown)."""
    look = frames.select("match_id", F.col("source_frame_id").alias("frame_start"), F.col("mel_ms").alias("match_elapsed_ms"))
    return events.join(look, ["match_id", "frame_start"], "left")


# ---------------------------------------------------------------- provider B: wide CSV with three header lines
def read_wide_tracking(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Wide tracking CSV: the third line names the entities, each label covers an x and a y column.

    Only the header line comes to the driver.
    """
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").rlike(r"^\s*Period,")).first()[0].strip().split(",")
    labels = [head[i] for i in range(3, len(head), 2) if head[i]]
    names = [("period", "int"), ("frame", "bigint"), ("time_s", "double")] + \
        [(f"{l}_{a}", "double") for l in labels for a in ("x", "y")]
    body = lines.filter(F.col("value").rlike(r"^\s*\d+,"))
    parts = F.split("value", ",")
    cols = [F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).try_cast(t).alias(n) for i, (n, t) in enumerate(names)]
    return body.select(*cols), labels


def normalize_wide(home: tuple[DataFrame, list[str]], away: tuple[DataFrame, list[str]], match: str,
                   source: str = "metrica", frame_ms: int = 40) -> dict[str, DataFrame]:
    """Two frame-aligned wide tables of one match."""
    sides = {"Home": home, "Away": away}
    frames = home[0].filter(F.col("period").isNotNull()).select("period", "frame")
    misaligned = home[0].select("frame").exceptAll(away[0].select("frame"))
    if not misaligned.isEmpty() or not away[0].select("frame").exceptAll(home[0].select("frame")).isEmpty():
        raise ValueError("home and away tracking files are not frame-aligned")
    long, keepers = [], []
    for side, (wide, labels) in sides.items():
        w = wide.filter(F.col("period").isNotNull()).withColumn("match_id", F.lit(f"{source}:{match}"))
        use = labels if side == "Home" else [l for l in labels if l != "Ball"]
        one = unpivot_tracking(w, ["match_id", "period", "frame"], use).withColumn(
            "side", F.when(F.col("label") != "Ball", F.lit(side)))
        long.append(one)
        keepers.append(agg.infer_keeper(one.filter(F.col("label") != "Ball"), ["match_id", "side", "period"], "label", "x", "frame"))
    pos, keep = long[0].unionByName(long[1]), keepers[0].unionByName(keepers[1])
    team = F.when(F.col("side").isNotNull(), F.concat(F.lit(f"{source}:team:{match}."), F.lower("side")))
    number = F.regexp_replace("label", "Player", "")
    entity = F.when(F.col("side").isNull(), F.lit(f"{source}:ball")).otherwise(
        F.concat(F.lit(f"{source}:player:{match}."), F.lower("side"), F.lit("."), number))
    fr = ordered.with_sequence(frames.withColumn("match_id", F.lit(f"{source}:{match}")), "seq", ["match_id"], ["frame"])
    first = frames.agg(F.min("frame").alias("f0")).first()["f0"]
    fr = fr.withColumn("t_ms", (F.col("frame") - F.lit(first)) * frame_ms)
    per = fr.groupBy("match_id", "period").agg(F.min("t_ms").alias("offset_ms"),
                                               (F.max("t_ms") - F.min("t_ms") + frame_ms).alias("duration_ms"))
    x, y = geo.unit_to_metres("x", "y")
    pos = pos.withColumns({"team_id": team, "entity_id": entity, "x_m": x, "y_m": y, "possession_team_id": F.lit(None).cast("string"),
                           "entity_type": F.when(F.col("side").isNull(), "ball").otherwise("player")})
    sign = keep.select("match_id", "period", team.alias("team_id"), "sign")
    pos = joins.attack_normalize(pos, sign)
    counts = pos.groupBy("match_id", "frame").agg(
        F.count_if(F.col("entity_type") == "player").alias("n_players"), (F.count_if(F.col("entity_type") == "ball") > 0).alias("has_ball"))
    fr = fr.join(counts, ["match_id", "frame"], "left").fillna({"n_players": 0, "has_ball": False})
    fr = fr.withColumn("frame_quality_flags", join_flags(no_ball=~F.col("has_ball"), no_entities=F.col("n_players") == 0))
    pos = pos.join(fr.select("match_id", "frame", "seq", "t_ms"), ["match_id", "frame"])
    spans = agg.presence_span(pos, ["match_id", "entity_id"], "frame", "x", "y")
    gaps = windows.gap_segments(fr.withColumn("has", F.col("n_players") > 0), ["match_id"], "t_ms", "has", 5000, frame_ms)
    return {"frames": fr, "positions": pos, "periods": per, "direction": sign, "keepers": keep, "spans": spans, "gaps": gaps}


def shots_agreement(shots: DataFrame, direction: DataFrame) -> DataFrame:
    """Shots that end in the attacking half: validated at 0.9 or more."""
    d = shots.filter(F.col("end_x").isNotNull()).join(direction, ["match_id", "team_id", "period"], "left")
    ok = F.coalesce(F.col("sign") * (F.col("end_x") - 0.5) > 0, F.lit(False))
    return agg.agreement(d, ["match_id"], ok, 0.9, strict=False)


# ---------------------------------------------------------------- provider C: nested events with moments
MOMENT_FILE = ("gameid string, gamedate string, events array<struct<eventId string, "
               "home: struct<teamid bigint, name string, abbreviation string, players: array<struct<playerid bigint, firstname string, lastname string, jersey string, position string>>>, "
               "visitor: struct<teamid bigint, name string, abbreviation string, players: array<struct<playerid bigint, firstname string, lastname string, jersey string, position string>>>, "
               "moments array<array<string>>>>")


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    """Positional moments [period, epoch, game clock, shot clock, null, entities] -> typed rows.

    The array mixes numbers and lists, so its members are read as text and the entity list is parsed on its own.
    """
    raw = spark.read.option("multiLine", True).schema(MOMENT_FILE).json(path)
    ev = raw.select(F.concat(F.lit("sportvu:"), F.col("gameid")).alias("match_id"), F.posexplode("events").alias("event_no", "ev"))
    m = ev.select("match_id", "event_no", F.col("ev.eventId").alias("event_id"), F.col("ev.home.teamid").alias("home_id"),
                  F.col("ev.visitor.teamid").alias("away_id"), F.posexplode("ev.moments").alias("moment_no", "m"))
    g = lambda i: F.get("m", F.lit(i))
    return m.select("match_id", "event_no", "moment_no", "event_id", "home_id", "away_id", g(0).cast("int").alias("period"),
                    g(1).cast("bigint").alias("epoch_ms"), g(2).try_cast("double").alias("game_clock"),
                    g(3).try_cast("double").alias("shot_clock"),
                    F.from_json(g(5), "array<array<double>>").alias("entities"))


def read_moment_players(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema(MOMENT_FILE).json(path)
    ev = raw.select(F.concat(F.lit("sportvu:"), F.col("gameid")).alias("match_id"), F.explode("events").alias("ev"))
    side = lambda s: ev.select("match_id", F.col(f"ev.{s}.teamid").alias("team"), F.explode(f"ev.{s}.players").alias("p")).select(
        "match_id", F.col("p.playerid").alias("player_id"), "team",
        F.concat_ws(" ", "p.firstname", "p.lastname").alias("name"), F.col("p.jersey").alias("jersey"))
    return ordered.first_by(side("home").unionByName(side("visitor")), ["match_id", "player_id"], ["team", "name"])


def normalize_moments(moments: DataFrame, players: DataFrame, source: str = "sportvu",
                      hot_rows: int | None = None) -> dict[str, DataFrame]:
    """First moment per epoch, clocks, flags, positions in metres and inferred attack direction."""
    ents = F.to_json(F.transform("entities", lambda e: F.slice(e, 1, 4)))
    m = moments.withColumn("_content", F.concat_ws("|", F.col("period").cast("string"), ents))
    first = F.min_by(F.struct("period", "game_clock", "shot_clock", "event_id", "home_id", "away_id", "entities", "_content"),
                     F.struct("event_no", "moment_no"))
    # one row per distinct content first: repeats of a moment are combined before the shuffle
    per = m.groupBy("match_id", "epoch_ms", "_content").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("event_no", "moment_no")).alias("_o"), first.alias("_r"))
    g = per.groupBy("match_id", "epoch_ms").agg(
        F.min_by("_r", "_o").alias("_r"), F.sum("_n").alias("_all"), F.min_by("_n", "_o").alias("_same"))
    f = g.select("match_id", "epoch_ms", "_r.*", (F.col("_all") - 1).alias("duplicates"), (F.col("_all") - F.col("_same")).alias("conflicts"))
    chunk = ordered.split_if_hot(f, ["match_id"], ordered.by_number("epoch_ms", 600_000), hot_rows)
    f = ordered.with_sequence(f, "seq", ["match_id"], ["epoch_ms"], chunk)
    start = f.groupBy("match_id").agg(F.min("epoch_ms").alias("_e0"))
    f = f.join(start, "match_id").withColumn("t_ms", F.col("epoch_ms") - F.col("_e0")).drop("_e0")
    per = f.groupBy("match_id", "period").agg(F.min("t_ms").alias("offset_ms"), (F.max("t_ms") - F.min("t_ms") + 40).alias("duration_ms"))
    f = windows.clock_stopped(f, ["match_id"], "period", "game_clock", ["epoch_ms"], chunk)
    f = f.join(per.select("match_id", "period", "offset_ms"), ["match_id", "period"])
    is_ball = lambda e: F.get(e, F.lit(0)) == -1
    f = f.withColumns({
        "has_ball": F.exists("entities", is_ball), "n_players": F.size(F.filter("entities", lambda e: ~is_ball(e)))})
    f = f.withColumns({
        "mel_ms": elapsed_game_ms("period", "game_clock"), "source_clock": clock_mm_ss_cc("game_clock"),
        "period_elapsed_ms": F.col("t_ms") - F.col("offset_ms"),
        "frame_quality_flags": join_flags(clock_stopped=F.col("clock_stopped"), no_ball=~F.col("has_ball"),
                                          few_players=F.col("n_players") < 10)})
    e = f.select("match_id", "seq", "period", "t_ms", "home_id", "away_id", "frame_quality_flags", F.explode("entities").alias("e"))
    get = lambda i: F.get("e", F.lit(i))
    e = e.withColumns({"_team": get(0).cast("bigint"), "_pid": get(1).cast("bigint"), "x": get(2), "y": get(3), "z": get(4)})
    ball = F.col("_team") == -1
    x, y = geo.feet_to_metres("x", "y")
    known = (F.col("_team") == F.col("home_id")) | (F.col("_team") == F.col("away_id"))
    pos = e.select(
        "match_id", "seq", "period", "t_ms", "frame_quality_flags", F.when(ball, "ball").otherwise("player").alias("entity_type"),
        F.when(ball, F.lit(f"{source}:ball")).otherwise(ns_id(source, "player", "_pid")).alias("entity_id"),
        F.when(~ball & known, ns_id(source, "team", "_team")).alias("team_id"), "x", "y",
        x.alias("x_m"), y.alias("y_m"), F.when(ball, F.col("z") * geo.FOOT).alias("z_m"),
        F.lit(None).cast("string").alias("possession_team_id"), F.lit(None).cast("boolean").alias("is_detected"),
        F.when(F.col("_team") == F.col("home_id"), "home").when(F.col("_team") == F.col("away_id"), "away").alias("side"), "_pid")
    votes = agg.direction_votes(pos.filter((F.col("seq") % 5 == 0) & F.col("side").isNotNull()).withColumn("frame", F.col("seq")))
    ids = f.groupBy("match_id").agg(F.min("home_id").alias("home_id"), F.min("away_id").alias("away_id"))
    v = votes.join(ids, "match_id")
    sign = v.select("match_id", "period", ns_id(source, "team", "home_id").alias("team_id"), F.col("home_sign").alias("sign")).unionByName(
        v.select("match_id", "period", ns_id(source, "team", "away_id").alias("team_id"), (-F.col("home_sign")).alias("sign")))
    roster = players.select("match_id", ns_id(source, "player", "player_id").alias("entity_id"))
    quality = f.groupBy("match_id").agg(
        F.sum(F.col("duplicates") + 1).alias("moments_total"), F.count(F.lit(1)).alias("unique_moments"),
        F.sum("duplicates").alias("duplicates_dropped"), F.sum("conflicts").alias("conflicting"),
        F.count_if("clock_stopped").alias("frames_clock_stopped"), F.count_if(~F.col("has_ball")).alias("frames_without_ball"),
        F.count_if(F.col("n_players") < 10).alias("frames_few_players"))
    unknown = pos.filter(F.col("entity_type") == "player").select("match_id", "entity_id").distinct().join(
        roster, ["match_id", "entity_id"], "left_anti").groupBy("match_id").agg(F.count(F.lit(1)).alias("unknown_ids"))
    quality = quality.join(unknown, "match_id", "left").fillna({"unknown_ids": 0})
    gaps = windows.time_jumps(f, ["match_id"], "t_ms", 5000, ordered.by_number("t_ms", 600_000) if chunk is not None else None)
    return {"frames": f.drop("entities", "_content"), "positions": joins.attack_normalize(pos, sign).drop("side", "_pid", "x", "y"),
            "periods": per, "direction": sign, "votes": votes, "quality": quality, "gaps": gaps}


def halves_consistent(votes: DataFrame) -> DataFrame:
    """Basketball teams switch sides at half time: periods 1 = 2, 3 = 4, and 1 opposite to 3."""
    s = lambda p: F.max(F.when(F.col("period") == p, F.col("home_sign")))
    g = votes.groupBy("match_id").agg(*[s(p).alias(f"s{p}") for p in (1, 2, 3, 4)], F.min("agreement").alias("min_agreement"))
    ok = (F.col("s1") == F.col("s2")) & (F.col("s3") == F.col("s4")) & (F.col("s1") == -F.col("s3"))
    return g.select("match_id", ok.alias("halftime_switch_consistent"),
                    F.when(F.coalesce(ok, F.lit(False)) & (F.col("min_agreement") > 0.6), "validated")
                    .otherwise("low_confidence").alias("status"))


# ---------------------------------------------------------------- whole-frame messages
ENTITY_FIELDS = ["entity_type", "canonical_player_id", "team_id", "x_m", "y_m", "z_m", "x_att", "y_att", "is_detected", "position_source"]


def assemble_frames(frames: DataFrame, positions: DataFrame, session: str, meta: dict[str, str],
                    entity: Sequence[str] = ENTITY_FIELDS) -> DataFrame:
    """One message per frame (ball struct, players array) plus one end-of-stream message per match with its roster.

    Returns key, value (JSON), match_id, sequence. A frame with too many players keeps them all, so that the validator
    of the receiving side sees the violation.
    """
    pos = positions.withColumn("canonical_player_id", F.col("entity_id")) if "canonical_player_id" not in positions.columns else positions
    have = [c if c in pos.columns else F.lit(None).cast("string").alias(c) for c in entity]
    p = pos.select("match_id", "seq", *have)
    one = F.struct(*entity)
    ball = F.col("entity_type") == "ball"
    ents = p.groupBy("match_id", "seq").agg(
        F.min_by(F.when(ball, one), F.when(ball, F.col("canonical_player_id"))).alias("ball"),
        F.sort_array(F.collect_list(F.when(~ball, F.struct(F.col("canonical_player_id").alias("k"), one.alias("e"))))).alias("_p"))
    ents = ents.withColumn("players", F.transform("_p", lambda x: x["e"])).drop("_p")
    f = frames.join(ents, ["match_id", "seq"], "left")
    from touchline.functions.parsing import split_flags
    fixed = [F.lit(v).alias(k) for k, v in {"schema_version": "1.0.0", "record_type": "tracking_frame", **meta}.items()]
    msg = F.struct(
        *fixed, "match_id", F.concat_ws("|", "match_id", F.lit("frame"), F.col("source_frame_id").cast("string")).alias("record_id"),
        "source_frame_id", "period", F.col("t_ms").alias("physical_time_ms"), F.col("mel_ms").alias("match_elapsed_ms"),
        F.col("seq").alias("sequence"), F.lit(session).alias("replay_session_id"), F.lit(0).alias("attempt"),
        split_flags("frame_quality_flags").alias("quality_flags"), "possession_team_id", "ball",
        F.coalesce("players", F.array().cast(ents.schema["players"].dataType)).alias("players"))
    body = f.select("match_id", F.col("seq").alias("sequence"), F.to_json(msg).alias("value"))
    roster = p.filter(F.col("canonical_player_id").isNotNull()).groupBy("match_id").agg(
        F.array_sort(F.collect_set("canonical_player_id")).alias("roster"))
    last = frames.groupBy("match_id").agg((F.max("seq") + 1).alias("sequence"), F.max("t_ms").alias("_t")).join(roster, "match_id", "left")
    end = last.select("match_id", "sequence", F.to_json(F.struct(
        *fixed, "match_id", F.concat_ws("|", "match_id", F.lit("end_of_stream")).alias("record_id"),
        F.col("_t").alias("physical_time_ms"), "sequence", F.lit(session).alias("replay_session_id"), F.lit(0).alias("attempt"),
        F.lit(True).alias("end_of_stream"), F.array().cast("array<string>").alias("quality_flags"),
        F.array().cast("array<string>").alias("players"), "roster")).alias("value"))
    return body.unionByName(end).withColumn("key", F.concat_ws("|", F.lit(session), "match_id"))
