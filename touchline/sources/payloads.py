"""Score-API payloads (JSON documents) -> game snapshots, periods, plays, events, statistics, lineups.

Each function takes a DataFrame of raw documents; nested lists are exploded by Spark, nothing is fetched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import parsing as ps
from touchline.operators import aggregates as agg
from touchline.operators import joins, ordered

# Statistic name in the payload -> shown name, in priority order
SOCCER_STATS = [
    ("possessionPct", "possession"), ("possession", "possession"),
    ("totalShots", "shots"), ("shotsTotal", "shots"),
    ("shotsOnTarget", "shotsOnTarget"), ("onTargetShots", "shotsOnTarget"),
    ("blockedShots", "shotsBlocked"),
    ("cornerKicks", "corners"), ("corners", "corners"), ("wonCorners", "corners"),
    ("foulsCommitted", "fouls"), ("fouls", "fouls"),
    ("offsides", "offsides"), ("saves", "saves"),
    ("totalPasses", "passes"), ("accuratePasses", "accuratePasses"), ("passPct", "passAccuracy"),
    ("totalCrosses", "crosses"), ("accurateCrosses", "accurateCrosses"),
    ("totalTackles", "tackles"), ("effectiveTackles", "effectiveTackles"),
    ("interceptions", "interceptions"),
    ("totalClearance", "clearances"), ("effectiveClearance", "clearances"),
    ("yellowCards", "yellowCards"), ("redCards", "redCards"),
    ("totalLongBalls", "longBalls"),
]
SKIP_STATUSES = ["Scheduled", "Postponed", "Canceled", "Unnecessary"]
ENDED_STATUSES = ["Full Time", "Final Score", "Final Score - After Extra Time", "Ended", "Abandoned"]
# Coordinates beyond this are placeholders; clock tolerance in seconds; list sizes
COORD_LIMIT, CLOCK_TOLERANCE = 1000, 3.0
RECENT_PLAYS, NFL_PLAYS, NFL_DRIVES = 30, 40, 10

_TEAM = "struct<displayName: string, abbreviation: string, id: string>"
SOCCER_EVENT = ("id string, competitions array<struct<status: struct<displayClock: string, type: struct<description: string>>, "
                f"competitors: array<struct<homeAway: string, score: string, team: {_TEAM}>>>>")
SOCCER_SUMMARY = (
    "game_id string, "
    "keyEvents array<struct<clock: struct<displayValue: string, value: double>, type: struct<text: string>, "
    f"team: {_TEAM}, participants: array<struct<athlete: struct<displayName: string>>>>>, "
    "header struct<competitions: array<struct<competitors: array<struct<id: string, homeAway: string, linescores: array<struct<value: double>>>>>>>, "
    f"boxscore struct<teams: array<struct<team: {_TEAM}, homeAway: string, statistics: array<struct<name: string, displayValue: string>>>>>, "
    "commentary array<struct<time: struct<displayValue: string>, text: string, play: struct<type: struct<type: string>, "
    f"team: {_TEAM}, fieldPositionX: double, fieldPositionY: double, fieldPosition2X: double, fieldPosition2Y: double>>>, "
    "rosters array<struct<team: struct<displayName: string, color: string, alternateColor: string>, formation: string, homeAway: string, "
    "roster: array<struct<athlete: struct<displayName: string>, jersey: string, position: struct<abbreviation: string, displayName: string>, starter: boolean>>>>")


def _side(competitors, side: str):
    return F.get(F.filter(competitors, lambda c: c["homeAway"] == side), F.lit(0))


def soccer_games(events: DataFrame) -> DataFrame:
    """Scoreboard events -> one row per game; running games show their clock in the status."""
    c = F.get("competitions", F.lit(0))
    d = events.filter(F.size("competitions") > 0).select("id", c.alias("c"))
    d = d.withColumns({"h": _side(F.col("c.competitors"), "home"), "a": _side(F.col("c.competitors"), "away"),
                       "status": F.coalesce("c.status.type.description", F.lit("")), "clock": F.coalesce("c.status.displayClock", F.lit(""))})
    live = (F.col("clock") != "") & ~F.col("status").isin(*SKIP_STATUSES, *ENDED_STATUSES)
    score = lambda s: F.coalesce(F.col(f"{s}.score").try_cast("int"), F.lit(0))
    return d.filter(F.col("h").isNotNull() & F.col("a").isNotNull()).select(
        F.col("id").alias("game_id"), F.when(live, F.concat_ws(" · ", "status", "clock")).otherwise(F.col("status")).alias("status_text"),
        "clock", F.col("h.team.displayName").alias("home_team"), score("h").alias("home_score"),
        F.col("a.team.displayName").alias("away_team"), score("a").alias("away_score"))


def soccer_events(summary: DataFrame) -> DataFrame:
    """Goals, cards and substitutions; other key events are left out."""
    e = summary.select("game_id", F.posexplode("keyEvents").alias("pos", "k"))
    who = lambda i: F.coalesce(F.get("k.participants", F.lit(i))["athlete"]["displayName"], F.lit(""))
    text = F.coalesce("k.type.text", F.lit(""))
    kind = ps.classify_event(text)
    sub = kind == "substitution"
    return e.select("game_id", "pos", kind.alias("type"), ps.parse_minute("k.clock.displayValue", "k.clock.value").alias("minute"),
                    F.when(~sub, ps.scorer_name(text, who(0))).alias("player"), F.when(sub, who(1)).alias("playerIn"),
                    F.when(sub, who(0)).alias("playerOut"), F.coalesce("k.team.displayName", F.lit("")).alias("team")) \
        .filter(F.col("type").isNotNull())


def soccer_periods(summary: DataFrame) -> DataFrame:
    comp = F.get("header.competitions", F.lit(0))["competitors"]
    return _periods(summary.select("game_id", _side(comp, "home").alias("h"), _side(comp, "away").alias("a")),
                    "h.linescores", "a.linescores", "value")


def _periods(d: DataFrame, home: str, away: str, field: str) -> DataFrame:
    """Pairs of period scores as far as both sides have one."""
    both = F.slice(F.arrays_zip(F.col(home).alias("h"), F.col(away).alias("a")), 1, F.least(F.size(home), F.size(away)))
    z = d.filter((F.size(home) > 0) & (F.size(away) > 0)).select("game_id", F.posexplode(both).alias("i", "z"))
    num = lambda s: F.coalesce(F.col(f"z.{s}.{field}").cast("int"), F.lit(0))
    return z.select("game_id", (F.col("i") + 1).alias("period"), num("h").alias("home_score"), num("a").alias("away_score"))


def soccer_stats(summary: DataFrame) -> DataFrame:
    """Home and away value per statistic. The home box is found by team id, else the first box is home."""
    comp = F.get("header.competitions", F.lit(0))["competitors"]
    d = summary.filter(F.size("boxscore.teams") >= 2).select("game_id", _side(comp, "home")["id"].alias("hid"), F.col("boxscore.teams").alias("t"))
    match = F.exists("t", lambda x: x["team"]["id"] == F.col("hid")) & F.exists("t", lambda x: x["team"]["id"] != F.col("hid"))
    d = d.withColumn("by_id", F.coalesce(match, F.lit(False))).select("game_id", "hid", "by_id", F.posexplode("t").alias("i", "b"))
    home = F.when(F.col("by_id"), F.col("b.team.id") == F.col("hid")).otherwise(F.col("i") == 0)
    s = d.select("game_id", F.when(home, "home").otherwise("away").alias("side"), F.explode("b.statistics").alias("s")).select(
        "game_id", "side", F.col("s.name").alias("name"), F.coalesce("s.displayValue", F.lit("")).alias("value"))
    return agg.stat_pairs(s, SOCCER_STATS)


def soccer_commentary(summary: DataFrame) -> DataFrame:
    c = summary.select("game_id", F.posexplode("commentary").alias("pos", "c"))
    txt = lambda p: F.coalesce(F.col(p), F.lit(""))
    return c.select("game_id", "pos", txt("c.time.displayValue").alias("minute"), txt("c.text").alias("text"),
                    txt("c.play.type.type").alias("type"), txt("c.play.team.displayName").alias("team"),
                    F.col("c.play.fieldPositionX").alias("x"), F.col("c.play.fieldPositionY").alias("y"),
                    F.col("c.play.fieldPosition2X").alias("x2"), F.col("c.play.fieldPosition2Y").alias("y2"))


def soccer_lineups(summary: DataFrame) -> DataFrame:
    r = summary.select("game_id", F.explode("rosters").alias("r"))
    p = r.select("game_id", F.col("r.team.displayName").alias("team"),
                 F.concat(F.lit("#"), F.coalesce("r.team.color", F.lit("888888"))).alias("color"),
                 F.concat(F.lit("#"), F.coalesce("r.team.alternateColor", F.lit("ffffff"))).alias("alt_color"),
                 F.col("r.formation").alias("formation"), F.col("r.homeAway").alias("side"), F.explode("r.roster").alias("p"))
    return p.select("game_id", "team", "color", "alt_color", "formation", "side", F.col("p.athlete.displayName").alias("name"),
                    F.col("p.jersey").alias("jersey"), F.col("p.position.abbreviation").alias("position"),
                    F.coalesce("p.starter", F.lit(False)).alias("starter"))


# ------------------------------------------------------------------ basketball
NBA_GAME = ("gameId string, gameStatusText string, homeTeam struct<teamName: string, teamTricode: string, score: int, periods: array<struct<period: int, score: int>>>, "
            "awayTeam struct<teamName: string, teamTricode: string, score: int, periods: array<struct<period: int, score: int>>>")
NBA_ACTION = ("game_id string, actionNumber int, clock string, period int, description string, teamTricode string, scoreHome string, "
              "scoreAway string, actionType string, subType string, shotResult string, playerNameI string, area string, areaDetail string, "
              "shotDistance double, x double, y double")


def nba_games(games: DataFrame) -> DataFrame:
    return games.select(F.col("gameId").alias("game_id"), F.col("gameStatusText").alias("status_text"),
                        F.col("homeTeam.teamName").alias("home_team"), F.col("homeTeam.score").alias("home_score"),
                        F.col("homeTeam.teamTricode").alias("home_code"), F.col("awayTeam.teamName").alias("away_team"),
                        F.col("awayTeam.score").alias("away_score"), F.col("awayTeam.teamTricode").alias("away_code"))


def nba_periods(games: DataFrame) -> DataFrame:
    return _periods(games.withColumn("game_id", F.col("gameId")), "homeTeam.periods", "awayTeam.periods", "score")


def usable_coords(plays: DataFrame) -> DataFrame:
    """Second-source plays with a real coordinate and the seconds of their clock."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") <= COORD_LIMIT)
    return plays.filter(ok).withColumn("clock_s", ps.parse_clock("clock", "mmss"))


def nba_plays(actions: DataFrame, coords: DataFrame, game_map: DataFrame, n: int = RECENT_PLAYS) -> DataFrame:
    """Last plays of each game; a play without position takes that of the nearest second-source play.

    game_map: game_id, other_id (games matched by their unordered team pair). coords: other_id, period, clock_s,
    x, y, ord.
    """
    d = ordered.last_n(actions, ["game_id"], ["actionNumber"], n, "from_end")
    d = d.withColumns({"clock_s": ps.parse_clock("clock", "iso"), "clock_text": ps.clock_from_iso("clock")})
    c = coords.join(game_map, "other_id").select("game_id", "period", "clock_s", "x", "y", "ord")
    missing = d.filter(F.col("x").isNull() | F.col("y").isNull())
    near = joins.nearest_join(missing, c, ["game_id", "period"], "clock_s", "clock_s", ["x", "y"], CLOCK_TOLERANCE, "ord", width=120)
    have = d.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    two = lambda c0: F.bround(c0, 2)
    have = have.withColumns({"x": two("x"), "y": two("y"), "other_x": F.lit(None).cast("double"), "other_y": F.lit(None).cast("double")})
    near = near.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double"), "other_x": F.col("matched.x"),
                             "other_y": F.col("matched.y")}).drop("matched", "distance")
    return have.unionByName(near)


def match_games(games: DataFrame, other: DataFrame) -> DataFrame:
    """game_id, other_id for the same two teams, whichever is home."""
    return joins.pair_key_join(games.select("game_id", "home_code", "away_code"), other.select("other_id", "code_a", "code_b"),
                               "home_code", "away_code", "code_a", "code_b").select("game_id", "other_id")


NBA_PLAYER = ("game_id string, side string, name string, starter string, played string, position string, statistics struct<minutes: string, "
              "points: int, reboundsTotal: int, assists: int, steals: int, blocks: int, turnovers: int, fieldGoalsMade: int, fieldGoalsAttempted: int, "
              "fieldGoalsPercentage: double, threePointersMade: int, threePointersAttempted: int, threePointersPercentage: double, "
              "freeThrowsMade: int, freeThrowsAttempted: int, freeThrowsPercentage: double, plusMinusPoints: double>")


def nba_box(players: DataFrame) -> DataFrame:
    """Box score lines of players who played or started."""
    s = lambda n: F.coalesce(F.col(f"statistics.{n}"), F.lit(0))
    shoot = lambda n: F.format_string("%d/%d", s(f"{n}Made"), s(f"{n}Attempted"))
    return players.filter((F.col("played") == "1") | (F.col("starter") == "1")).select(
        "game_id", "side", "name", (F.col("starter") == "1").alias("starter"), "position",
        F.coalesce(ps.clock_from_iso("statistics.minutes"), F.lit("0:00")).alias("minutes"), s("points").alias("points"),
        s("reboundsTotal").alias("rebounds"), s("assists").alias("assists"), s("steals").alias("steals"), s("blocks").alias("blocks"),
        s("turnovers").alias("turnovers"), shoot("fieldGoals").alias("fg"), shoot("threePointers").alias("three_pt"), shoot("freeThrows").alias("ft"))


# Shown name -> field of the team statistics
NBA_TEAM_STATS = {
    "assists": "assists", "rebounds": "reboundsTotal", "offRebounds": "reboundsOffensive", "defRebounds": "reboundsDefensive",
    "steals": "steals", "blocks": "blocks", "turnovers": "turnovers", "fastBreakPts": "pointsFastBreak",
    "pointsOffTurnovers": "pointsFromTurnovers", "pointsInPaint": "pointsInThePaint", "personalFouls": "foulsPersonal",
    "secondChancePts": "pointsSecondChance", "biggestLead": "biggestLead",
}
NBA_SHOOTING = {"fieldGoals": "fieldGoals", "threePointers": "threePointers", "freeThrows": "freeThrows"}


def nba_team_stats(teams: DataFrame) -> DataFrame:
    """teams: game_id, side, statistics map<string,double>. One row per game and statistic with both values."""
    v = lambda n: F.coalesce(F.col("statistics")[n], F.lit(0.0))
    shots = [F.struct(F.lit(shown).alias("stat"), ps.fmt_shooting(v(f"{n}Made"), v(f"{n}Attempted"), v(f"{n}Percentage")).alias("value"))
             for shown, n in NBA_SHOOTING.items()]
    plain = [F.struct(F.lit(shown).alias("stat"), v(n).cast("bigint").cast("string").alias("value")) for shown, n in NBA_TEAM_STATS.items()]
    d = teams.select("game_id", "side", F.explode(F.array(*shots, *plain)).alias("s")).select("game_id", "side", "s.*")
    g = d.groupBy("game_id", "stat").agg(F.max(F.when(F.col("side") == "home", F.col("value"))).alias("home"),
                                         F.max(F.when(F.col("side") == "away", F.col("value"))).alias("away"))
    return g.fillna({"away": "0"})


# ------------------------------------------------------------------ american football
NFL_DRIVES_SCHEMA = (
    "game_id string, drives struct<previous: array<struct<id: string, team: struct<displayName: string, abbreviation: string>, displayResult: string, "
    "yards: int, offensivePlays: int, isScore: boolean, plays: array<struct<id: string, text: string, type: struct<text: string>, "
    "period: struct<number: int>, clock: struct<displayValue: string>, homeScore: int, awayScore: int, scoringPlay: boolean, statYardage: int, "
    "start: struct<down: int, distance: int, yardsToEndzone: int>, end: struct<yardsToEndzone: int, downDistanceText: string>>>>>, "
    "current: struct<id: string, team: struct<displayName: string, abbreviation: string>, displayResult: string, "
    "yards: int, offensivePlays: int, isScore: boolean, plays: array<struct<id: string, text: string, type: struct<text: string>, "
    "period: struct<number: int>, clock: struct<displayValue: string>, homeScore: int, awayScore: int, scoringPlay: boolean, statYardage: int, "
    "start: struct<down: int, distance: int, yardsToEndzone: int>, end: struct<yardsToEndzone: int, downDistanceText: string>>>>>")


def _drives(d: DataFrame) -> DataFrame:
    prev = d.select("game_id", F.posexplode("drives.previous").alias("drive_no", "dr"))
    cur = d.filter(F.col("drives.current").isNotNull()).select(
        "game_id", F.coalesce(F.greatest(F.size("drives.previous"), F.lit(0)), F.lit(0)).alias("drive_no"), F.col("drives.current").alias("dr"))
    return prev.unionByName(cur)


def nfl_drives(d: DataFrame, n: int = NFL_DRIVES) -> DataFrame:
    """Last finished drives per game."""
    p = d.select("game_id", F.posexplode("drives.previous").alias("drive_no", "dr"))
    p = p.select("game_id", "drive_no", F.col("dr.id").alias("id"), F.col("dr.team.displayName").alias("team"),
                 F.col("dr.displayResult").alias("result"), F.coalesce("dr.yards", F.lit(0)).alias("yards"),
                 F.coalesce("dr.offensivePlays", F.lit(0)).alias("num_plays"), F.coalesce("dr.isScore", F.lit(False)).alias("is_score"))
    return ordered.last_n(p, ["game_id"], ["drive_no"], n)


def nfl_plays(d: DataFrame, n: int = NFL_PLAYS) -> DataFrame:
    """Last plays over all drives of a game, the running drive included."""
    p = _drives(d).select("game_id", "drive_no", F.col("dr.team.abbreviation").alias("drive_team"), F.posexplode("dr.plays").alias("play_no", "p"))
    p = p.select("game_id", "drive_no", "play_no", "drive_team", F.col("p.id").alias("id"), F.col("p.text").alias("text"),
                 F.col("p.type.text").alias("type"), F.coalesce("p.period.number", F.lit(0)).alias("period"),
                 F.col("p.clock.displayValue").alias("clock"), F.coalesce("p.statYardage", F.lit(0)).alias("yards_gained"),
                 F.coalesce("p.start.down", F.lit(0)).alias("down"), F.coalesce("p.start.distance", F.lit(0)).alias("distance"),
                 F.coalesce("p.scoringPlay", F.lit(False)).alias("scoring_play"))
    return ordered.last_n(p, ["game_id"], ["drive_no", "play_no"], n)


def nfl_stats(boxes: DataFrame) -> DataFrame:
    """boxes: game_id, homeAway, statistics. Both sides must be present; a missing value is empty text."""
    s = boxes.select("game_id", F.when(F.col("homeAway") == "home", "home").otherwise("away").alias("side"), F.explode("statistics").alias("s"))
    two = boxes.groupBy("game_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("game_id")
    g = s.join(two, "game_id", "left_semi").groupBy("game_id", F.col("s.name").alias("stat")).agg(
        F.max(F.when(F.col("side") == "home", F.col("s.displayValue"))).alias("home"),
        F.max(F.when(F.col("side") == "away", F.col("s.displayValue"))).alias("away"))
    return g.fillna({"home": "", "away": ""})


# ------------------------------------------------------------------ season statistics
# Shown name -> column
NBA_SEASON_STATS = {"points": "PTS", "rebounds": "REB", "assists": "AST", "steals": "STL", "blocks": "BLK", "turnovers": "TOV",
                    "fg_pct": "FG_PCT", "fg3_pct": "FG3_PCT", "ft_pct": "FT_PCT", "minutes": "MIN"}


def nba_season_rows(wide: DataFrame, season: str) -> DataFrame:
    """Wide per-game statistics -> one row per player with a JSON map."""
    stats = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in NBA_SEASON_STATS.items() if c in wide.columns])
    return wide.select(F.lit("nba").alias("league"), F.lit(season).alias("season"), F.coalesce("PLAYER_NAME", F.lit("Unknown")).alias("player_name"),
                       F.coalesce("TEAM_ABBREVIATION", F.lit("")).alias("team"), F.coalesce(F.col("GP").cast("int"), F.lit(0)).alias("games_played"),
                       F.to_json(stats).alias("stats"))


LEADERS = ("leaders array<struct<name: string, leaders: array<struct<value: double, athlete: struct<displayName: string, "
           "team: struct<displayName: string, abbreviation: string>>>>>>")


def leader_rows(docs: DataFrame, league: str, season: str, category: str | None = None, team_field: str = "displayName") -> DataFrame:
    """Leader lists -> one row per player and statistic."""
    e = docs.select(F.explode("leaders").alias("l")).select(F.col("l.name").alias("stat"), F.explode("l.leaders").alias("e"))
    m = F.create_map(F.coalesce("stat", F.lit(category or "")), F.col("e.value").cast("string"))
    if category:
        m = F.map_concat(m, F.create_map(F.lit("category"), F.lit(category)))
    return e.select(F.lit(league).alias("league"), F.lit(season).alias("season"), F.coalesce("e.athlete.displayName", F.lit("Unknown")).alias("player_name"),
                    F.coalesce(f"e.athlete.team.{team_field}", F.lit("")).alias("team"), F.lit(0).alias("games_played"), F.to_json(m).alias("stats"))
