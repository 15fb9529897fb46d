"""Bronze -> silver -> gold for player data. Every builder takes and returns DataFrames."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import identity as ids
from touchline.functions import scoring
from touchline.operators import aggregates as agg
from touchline.operators import joins, ordered, quality, sets
from touchline.operators.reshape import cast_void, fill_existing, find_column, resolve_columns, upper_columns
from touchline.operators.windows import improved_flag

# Advanced metric and summary columns
ADVANCED = ["OFF_RATING", "DEF_RATING", "NET_RATING", "AST_PCT", "AST_TO", "AST_RATIO", "OREB_PCT", "DREB_PCT", "REB_PCT",
            "EFG_PCT", "TS_PCT", "USG_PCT", "PACE", "PIE", "POSS"]
SUMMARY = ["PLAYER_NAME", "TEAM_ABBREVIATION", "AGE", "GP", "MIN", "PTS", "REB", "AST", "STL", "BLK", "TOV", "FG_PCT",
           "FG3_PCT", "FT_PCT", "OFF_RATING", "DEF_RATING", "NET_RATING", "TS_PCT", "USG_PCT", "PIE", "PACE"]
VALUE_COLUMNS = ["AGE", "GP", "MIN", "PTS", "REB", "AST", "STL", "BLK", "TOV", "FG_PCT", "FG3_PCT", "FT_PCT", "TS_PCT",
                 "USG_PCT", "OFF_RATING", "DEF_RATING", "NET_RATING", "PIE", "PACE", "total_games_missed", "injury_count", "salary"]
DELTA_STATS = ["PTS", "REB", "AST", "MIN", "FG_PCT", "FG3_PCT", "TS_PCT", "USG_PCT", "NET_RATING", "PIE"]


# ------------------------------------------------------------------ silver
def dim_players(api: DataFrame | None, rosters: DataFrame | None) -> DataFrame | None:
    """One row per player id over all sources; the alphabetically first source wins, then the first name."""
    frames = []
    if api is not None:
        frames.append(resolve_columns(api, {
            "nba_api_player_id": {"names": ["PERSON_ID"]}, "player_name": {"names": ["DISPLAY_FIRST_LAST"]},
            "from_year": {"names": ["FROM_YEAR"]}, "to_year": {"names": ["TO_YEAR"]}}).select(
            *[F.col(c).cast("string").alias(c) for c in ("nba_api_player_id", "player_name", "from_year", "to_year")])
            .distinct().withColumn("source", F.lit("nba_api")))
    if rosters is not None and find_column(rosters, "player_id"):
        frames.append(resolve_columns(rosters, {
            "nba_api_player_id": {"names": ["player_id"]}, "player_name": {"names": ["player_name"]}}).select(
            F.col("nba_api_player_id").cast("string").alias("nba_api_player_id"), "player_name").distinct()
            .withColumns({"from_year": F.lit(None).cast("string"), "to_year": F.lit(None).cast("string"),
                          "source": F.lit("postgres_rosters")}))
    if not frames:
        return None
    d = sets.union_sources(frames).withColumns({
        "player_id": ids.player_id("nba_api_player_id"), "player_name_normalized": ids.normalize_name("player_name")})
    # rows whose id is not readable are in ``unreadable_ids``; folding them by a null id would merge different players
    d = ordered.first_by(d.filter(F.col("player_id").isNotNull()), ["player_id"], ["source", "player_name", "nba_api_player_id"])
    return d.select("player_id", "nba_api_player_id", "player_name", "player_name_normalized", "from_year", "to_year")


def dim_teams(teams: DataFrame) -> DataFrame:
    d = resolve_columns(teams, {
        "id": {"names": ["id"]}, "team_name": {"names": ["full_name"]}, "abbr": {"names": ["abbreviation"]},
        "conference": {"names": [], "contains": ["conference"]}, "division": {"names": [], "contains": ["division"]},
        "city": {"names": [], "contains": ["city"]}})
    return d.select(ids.team_id("id").alias("team_id"), F.col("id").alias("nba_api_team_id"), "team_name",
                    ids.normalize_team("abbr").alias("team_abbr"), "conference", "division", "city").distinct()


def dim_seasons(stats: DataFrame, season: str = "season") -> DataFrame:
    s = stats.select(F.col(season).alias("season")).distinct()
    year = F.substring("season", 1, 4).try_cast("int")
    return s.select(ids.season_id("season").alias("season_id"), "season", year.alias("start_year"), (year + 1).alias("end_year"))


def _with_ids(df: DataFrame) -> DataFrame:
    """Upper-case columns; PLAYER_ID becomes the canonical id (column names ignore case), SEASON_ID is added."""
    d = upper_columns(df)
    pid = "PLAYER_ID" if "PLAYER_ID" in d.columns else d.columns[0]
    d = d.withColumn("PLAYER_ID", ids.player_id(F.col(pid).cast("string")))
    return d.withColumn("SEASON_ID", ids.season_id("SEASON")) if "SEASON" in d.columns else d


def unreadable_ids(tables: dict[str, tuple[DataFrame | None, str]]) -> DataFrame | None:
    """Quarantine of rows whose player id is text that is no number: table_name, raw_id, reason, row (as JSON).

    ``tables``: name -> (table, its id column). The builders leave such rows out; here each of them is kept.
    """
    parts = []
    for name, (df, column) in tables.items():
        if df is not None:
            bad = df.filter(F.col(column).isNotNull() & ids.player_id(F.col(column).cast("string")).isNull())
            parts.append(bad.select(F.lit(name).alias("table_name"), F.col(column).cast("string").alias("raw_id"),
                                    F.lit("unreadable_player_id").alias("reason"), F.to_json(F.struct(*df.columns)).alias("row")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def fact_player_season_stats(base: DataFrame, advanced: DataFrame | None = None) -> DataFrame:
    b = _with_ids(base)
    team = F.col("TEAM_ABBREVIATION") if "TEAM_ABBREVIATION" in b.columns else F.lit("UNK")
    b = b.withColumn("TEAM_ABBR", ids.normalize_team(team))
    key = ["PLAYER_ID", "SEASON_ID"]
    order = [c for c in ("TEAM_ABBREVIATION", "GP") if c in b.columns] or key
    b = ordered.first_by(b.filter(F.col("PLAYER_ID").isNotNull()), key, order)
    if advanced is not None:
        a = _with_ids(advanced)
        cols = [c for c in ADVANCED if c in a.columns and c not in b.columns]
        if cols:
            b = joins.merge_advanced(b, a.select(*key, *cols), key, cols)
    return cast_void(b)


def fact_player_game_stats(logs: DataFrame) -> DataFrame:
    d = _with_ids(logs)
    if "GAME_ID" in d.columns:
        d = d.withColumn("GAME_ID", ids.game_id("GAME_ID"))
        key = ["PLAYER_ID", "GAME_ID"]
    else:
        key = ["PLAYER_ID", "SEASON_ID"]
    rest = sorted(c for c in d.columns if c not in key)
    return ordered.first_by(d.filter(F.col("PLAYER_ID").isNotNull()), key, rest)


def fact_player_contracts(contracts: DataFrame) -> DataFrame | None:
    name = find_column(contracts, "player", contains=["player_name"])
    salary, season = find_column(contracts, contains=["salary"]), find_column(contracts, contains=["season"])
    team = find_column(contracts, contains=["team"])
    if not (name and salary and season):
        return None
    return contracts.select(
        ids.normalize_name(name).alias("player_name_normalized"), F.col(name).alias("player_name"),
        ids.normalize_season(season).alias("season"), F.col(salary).cast("string").try_cast("double").alias("salary"),
        (ids.normalize_team(team) if team else F.lit("UNK")).alias("team_abbr"), ids.season_id(season).alias("season_id"))


def fact_player_injuries(injuries: DataFrame) -> DataFrame | None:
    name, season = find_column(injuries, contains=["player_name"]), find_column(injuries, contains=["season"])
    if not name:
        return None
    d = injuries.withColumn("player_name_normalized", ids.normalize_name(name))
    return cast_void(d.withColumn("season_id", ids.season_id(season)) if season else d)


def fact_player_shot_profiles(shots: DataFrame) -> DataFrame:
    return cast_void(_with_ids(shots))


def fact_player_profiles(profiles: DataFrame | None) -> DataFrame | None:
    """Scouting profiles as they were ingested; columns without a type become text."""
    return None if profiles is None else cast_void(profiles)


def fact_team_results(standings: DataFrame | None, historical: DataFrame | None) -> DataFrame | None:
    src = standings if standings is not None else historical
    if src is None:
        return None
    d = upper_columns(src)
    tid = next((c for c in ("TEAMID", "TEAM_ID") if c in d.columns), None)
    if tid:
        d = d.withColumn("TEAM_ID", ids.team_id(F.col(tid).cast("string")))
    return cast_void(d.withColumn("SEASON_ID", ids.season_id("SEASON")) if "SEASON" in d.columns else d)


def player_source_mapping(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return sets.source_mapping(sources, lambda c: ids.player_id(c.cast("string")))


# ------------------------------------------------------------------ gold
def player_season_summary(stats: DataFrame, contracts: DataFrame | None = None, injuries: DataFrame | None = None) -> DataFrame:
    d = upper_columns(stats)
    cols = [c for c in SUMMARY if c in d.columns]
    lead = ["PLAYER_ID", "SEASON", *(["SEASON_ID"] if "SEASON_ID" in d.columns else [])]
    d = d.select(*lead, *cols)
    d = ordered.first_by(d, ["PLAYER_ID", "SEASON"], cols)
    # the name is normalized once and used by both joins
    d = d.withColumn("_norm", ids.normalize_name("PLAYER_NAME"))
    if contracts is not None:
        c = agg.contracts_agg(contracts, ["player_name_normalized", "season"])
        d = joins.join_by_normalized(d, c, {"player_name_normalized": F.col("_norm"), "season": F.col("SEASON")}, ["salary"])
    if injuries is not None:
        name = "player_name_normalized" if "player_name_normalized" in injuries.columns else None
        i = injuries if name else injuries.withColumn("player_name_normalized", ids.normalize_name(
            find_column(injuries, contains=["player_name"])))
        season, missed = find_column(i, contains=["season"], exclude=["season_id"]), find_column(i, contains=["games_missed"])
        i = agg.injuries_agg(i.withColumn("_season", F.col(season)), ["player_name_normalized", "_season"], missed)
        d = joins.join_by_normalized(d, i, {"player_name_normalized": F.col("_norm"), "_season": F.col("SEASON")},
                                     ["total_games_missed", "injury_count"])
    return cast_void(fill_existing(d.drop("_norm"), {"total_games_missed": 0, "injury_count": 0, "salary": 0}))


def _salary_carried(d: DataFrame) -> DataFrame:
    """0 means "no salary known"; the last known salary is carried forward over the player's seasons."""
    d = d.withColumn("salary", scoring.zero_to_null("salary"))
    return ordered.carry_forward(d, "salary", "salary", ["PLAYER_ID"], ["SEASON"])


def features_value_model(summary: DataFrame) -> DataFrame:
    """Lags first, then salary carried forward, then rows without any salary dropped."""
    keep = [c for c in VALUE_COLUMNS if c in summary.columns]
    d = summary.select("PLAYER_ID", "SEASON", "PLAYER_NAME", *keep)
    d = ordered.with_lag(d, {s: f"prev_{s}" for s in ("PTS", "REB", "AST", "MIN") if s in keep}, ["PLAYER_ID"], ["SEASON"])
    return _salary_carried(d).filter(F.col("salary") > 0)


def features_improvement_model(summary: DataFrame) -> DataFrame:
    """Lags, deltas, next values and the label. Rows of the latest season stay: they are the ones to score."""
    stats = [s for s in DELTA_STATS if s in summary.columns]
    d = ordered.with_lag(summary, {s: f"prev_{s}" for s in stats}, ["PLAYER_ID"], ["SEASON"])
    d = d.withColumns({f"{s}_delta": F.col(s) - F.col(f"prev_{s}") for s in stats})
    nxt = {s: f"next_{s}" for s in ("PTS", "NET_RATING") if s in summary.columns}
    d = ordered.with_lead(d, nxt, ["PLAYER_ID"], ["SEASON"])
    if "NET_RATING" not in summary.columns:
        d = d.withColumn("next_NET_RATING", F.lit(None).cast("double"))
    return d.withColumn("improved_flag", improved_flag()).filter(F.col("prev_PTS").isNotNull())


def features_trade_target(summary: DataFrame) -> DataFrame:
    """Games filter first, then salary carried forward, then the component scores."""
    d = summary.filter(F.col("GP") >= 10) if "GP" in summary.columns else summary
    d = _salary_carried(d)
    d = d.withColumn("performance_score", scoring.performance_score())
    return d.withColumns({
        "contract_efficiency": scoring.contract_efficiency(),
        "age_upside_score": scoring.step_score("AGE", scoring.AGE_STEPS),
        "durability_score": scoring.step_score(F.coalesce("total_games_missed", F.lit(0)), scoring.DURABILITY_STEPS)})


def source_coverage(mapping: DataFrame) -> DataFrame:
    return agg.coverage(mapping)


def data_quality_summary(silver: dict, gold: dict) -> DataFrame:
    return quality.quality_summary({"silver": silver, "gold": gold})


def rosters_by_season(players: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row per player and season between FROM_YEAR and TO_YEAR; unreadable years are left out."""
    d = players.withColumns({"_f": F.col("FROM_YEAR").cast("string").try_cast("int"), "_t": F.col("TO_YEAR").cast("string").try_cast("int")})
    d = joins.expand_validity(d.filter(F.col("_f").isNotNull() & F.col("_t").isNotNull()), "_f", "_t", "start_year", lo, hi)
    return d.withColumn("season", ids.normalize_season(F.col("start_year").cast("string"))).drop("_f", "_t")


def player_profiles(stats: DataFrame, advanced: DataFrame | None = None) -> DataFrame:
    """Nested profile of every player's latest season; rarely seen players are left out."""
    latest = ordered.latest_by(stats, ["PLAYER_ID"], ["SEASON"])
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    latest = latest.filter(~((num("GP") < 5) & (num("MIN") < 5)))
    if advanced is not None:
        extra = [c for c in ("OFF_RATING", "DEF_RATING", "TS_PCT", "USG_PCT") if c in advanced.columns and c not in stats.columns]
        latest = latest.join(advanced.select("PLAYER_ID", "SEASON", *extra), ["PLAYER_ID", "SEASON"], "left")
    r = scoring.role(num("PTS"), num("REB"), num("AST"), num("MIN"))
    off = F.col("OFF_RATING")
    pace = F.when(off > 110, "fast").when(off > 105, "moderate").otherwise("slow")
    return latest.select(
        F.col("PLAYER_NAME").alias("player_name"), F.col("PLAYER_ID").alias("player_id"),
        F.col("TEAM_ABBREVIATION").alias("team_abbr"), F.col("SEASON").alias("season"), r.alias("role"),
        F.struct(r.alias("primary_role"), scoring.scoring_style(num("PTS"), "TS_PCT").alias("scoring_style"),
                 scoring.defensive_profile(num("REB"), num("BLK"), num("STL")).alias("defensive_profile"),
                 pace.alias("pace_preference")).alias("play_style"),
        F.struct(F.round(num("PTS"), 1).alias("ppg"), F.round(num("REB"), 1).alias("rpg"), F.round(num("AST"), 1).alias("apg"),
                 F.round(num("MIN"), 1).alias("mpg"), num("GP").alias("gp"), F.col("TS_PCT").alias("ts_pct"),
                 F.col("USG_PCT").alias("usg_pct")).alias("stats_snapshot"),
        F.format_string("%s fits well as a %s in %s's system.", "PLAYER_NAME", r, "TEAM_ABBREVIATION").alias("team_fit_narrative"))


def missed_games(stats: DataFrame) -> DataFrame:
    return stats.withColumn("games_missed", scoring.missed_games_estimate("GP")).filter(F.col("games_missed") >= 10)
