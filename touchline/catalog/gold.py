"""Player tables: summary, features, scores, quality, models."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.catalog.base import RAW_SEASONS, SEASONS, query, seasons
from touchline.catalog.functions import PERF, norm_sql
from touchline.functions import identity as ids
from touchline.functions import scoring
from touchline.models import training
from touchline.operators import aggregates as agg
from touchline.operators import ordered, quality
from touchline.operators.reshape import apply_filters, fill_existing, upper_columns
from touchline.operators.windows import improved_flag
from touchline.plans import medallion, scores
from touchline.session import materialize


# ------------------------------------------------------------------ flagship
@query("flagship_improvers", f"""WITH {SEASONS}, l AS (SELECT *, lag(PTS) OVER w AS prev_PTS, lead(PTS) OVER w AS next_PTS FROM seasons WINDOW w AS (PARTITION BY PLAYER_ID ORDER BY SEASON)),
 f AS (SELECT *, PTS - prev_PTS AS PTS_delta, CASE WHEN next_PTS - PTS >= 2.0 AND GP >= 20 THEN 1 ELSE 0 END AS improved_flag FROM l WHERE prev_PTS IS NOT NULL)
SELECT row_number() OVER (ORDER BY PTS_delta DESC, PLAYER_ID, SEASON) AS rank, PLAYER_ID, SEASON, TEAM_ABBREVIATION, PTS, PTS_delta, improved_flag FROM f ORDER BY PTS_delta DESC, PLAYER_ID, SEASON LIMIT 20""")
def _(t):
    d = medallion.features_improvement_model(seasons(t))
    top = d.orderBy(F.desc("PTS_delta"), "PLAYER_ID", "SEASON").limit(20)       # top-k first, then number 20 rows
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("PTS_delta"), "PLAYER_ID", "SEASON")
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "PLAYER_ID", "SEASON", "TEAM_ABBREVIATION", "PTS", "PTS_delta", "improved_flag")


# ------------------------------------------------------------------ summary and its sources
def contracts(t):
    """Contract rows: a name with a suffix, a season in mixed notations, a salary."""
    s = seasons(t).filter(F.col("salary").isNotNull())
    year = F.substring("SEASON", 1, 4)
    return s.select(F.concat("PLAYER_NAME", F.lit(" Jr.")).alias("player_name"), F.col("TEAM_ABBREVIATION").alias("team"),
                    F.when(F.col("PLAYER_ID") % 2 == 0, year).otherwise(F.col("SEASON")).alias("season"), "salary")


def injuries(t):
    o = t("orders").filter(F.col("o_orderstatus") == "P").join(t("customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.upper("c_name").alias("player_name"), ids.normalize_season(F.year("o_orderdate").cast("string")).alias("season"),
                    (F.col("o_orderkey") % 20).alias("games_missed"))


INJ = f"""inj AS (SELECT {norm_sql('c_name')} AS nm, year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season, CAST(sum(o_orderkey % 20) AS BIGINT) AS total_games_missed, count(*) AS injury_count
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""
SUMMARY = SEASONS + f""", {INJ}, con AS (SELECT {norm_sql('PLAYER_NAME')} AS nm, SEASON AS season, max(salary) AS salary FROM seasons WHERE salary IS NOT NULL GROUP BY 1, 2),
summary AS (SELECT 'P' || PLAYER_ID AS PLAYER_ID, s.SEASON, s.PLAYER_NAME, s.TEAM_ABBREVIATION, s.AGE, s.GP, s.MIN, s.PTS, s.REB, s.AST, s.STL, s.BLK, s.TOV, s.TS_PCT,
 coalesce(con.salary, 0) AS salary, coalesce(inj.total_games_missed, 0) AS total_games_missed, coalesce(inj.injury_count, 0) AS injury_count
 FROM seasons s LEFT JOIN con ON con.nm = {norm_sql('s.PLAYER_NAME')} AND con.season = s.SEASON LEFT JOIN inj ON inj.nm = {norm_sql('s.PLAYER_NAME')} AND inj.season = s.SEASON)"""


def summary(t):
    stats = medallion.fact_player_season_stats(seasons(t).drop("salary", "total_games_missed"))
    return medallion.player_season_summary(stats, medallion.fact_player_contracts(contracts(t)), medallion.fact_player_injuries(injuries(t)))


@query("cp09_player_season_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def _(t):
    return summary(t).drop("SEASON_ID")


CARRY = "last_value(salary0 IGNORE NULLS) OVER (PARTITION BY PLAYER_ID ORDER BY SEASON ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS salary"


@query("cp10_features_value_model", f"""WITH {SUMMARY}, l AS (SELECT * EXCLUDE (salary), CASE WHEN salary > 0 THEN salary END AS salary0, lag(PTS) OVER w AS prev_PTS, lag(REB) OVER w AS prev_REB, lag(AST) OVER w AS prev_AST, lag(MIN) OVER w AS prev_MIN
 FROM summary WINDOW w AS (PARTITION BY PLAYER_ID ORDER BY SEASON)), c AS (SELECT *, {CARRY} FROM l)
SELECT PLAYER_ID, SEASON, PLAYER_NAME, AGE, GP, MIN, PTS, REB, AST, STL, BLK, TOV, TS_PCT, total_games_missed, injury_count, salary, prev_PTS, prev_REB, prev_AST, prev_MIN FROM c WHERE salary > 0""")
def _(t):
    return medallion.features_value_model(summary(t))


@query("cp10_features_improvement_model", f"""WITH {SUMMARY}, l AS (SELECT *, lag(PTS) OVER w AS prev_PTS, lag(REB) OVER w AS prev_REB, lag(AST) OVER w AS prev_AST, lag(MIN) OVER w AS prev_MIN, lag(TS_PCT) OVER w AS prev_TS_PCT, lead(PTS) OVER w AS next_PTS
 FROM summary WINDOW w AS (PARTITION BY PLAYER_ID ORDER BY SEASON))
SELECT PLAYER_ID, SEASON, prev_PTS, next_PTS, PTS - prev_PTS AS PTS_delta, REB - prev_REB AS REB_delta, AST - prev_AST AS AST_delta, MIN - prev_MIN AS MIN_delta, TS_PCT - prev_TS_PCT AS TS_PCT_delta,
 CASE WHEN next_PTS - PTS >= 2.0 AND GP >= 20 THEN 1 ELSE 0 END AS improved_flag FROM l WHERE prev_PTS IS NOT NULL""")
def _(t):
    return medallion.features_improvement_model(summary(t)).select(
        "PLAYER_ID", "SEASON", "prev_PTS", "next_PTS", "PTS_delta", "REB_delta", "AST_delta", "MIN_delta", "TS_PCT_delta", "improved_flag")


TRADE = f"""{SUMMARY}, tl AS (SELECT * EXCLUDE (salary), CASE WHEN salary > 0 THEN salary END AS salary0 FROM summary WHERE GP >= 10), tc AS (SELECT *, {CARRY} FROM tl),
trade AS (SELECT *, {PERF} AS performance_score, CASE WHEN salary > 0 THEN ({PERF}) / (salary / 1000000) ELSE 0.0 END AS contract_efficiency,
 CASE WHEN AGE <= 23 THEN 10 WHEN AGE <= 25 THEN 8 WHEN AGE <= 27 THEN 6 WHEN AGE <= 30 THEN 4 WHEN AGE <= 33 THEN 2 ELSE 1 END AS age_upside_score,
 CASE WHEN coalesce(total_games_missed, 0) <= 5 THEN 10 WHEN total_games_missed <= 15 THEN 7 WHEN total_games_missed <= 30 THEN 4 ELSE 2 END AS durability_score FROM tc)"""


@query("cp10_features_trade_target", f"WITH {TRADE} SELECT PLAYER_ID, SEASON, salary, round(performance_score, 8) AS performance_score, round(contract_efficiency, 8) AS contract_efficiency, age_upside_score, durability_score FROM trade")
def _(t):
    return medallion.features_trade_target(summary(t)).select(
        "PLAYER_ID", "SEASON", "salary", F.round("performance_score", 8).alias("performance_score"),
        F.round("contract_efficiency", 8).alias("contract_efficiency"), "age_upside_score", "durability_score")


def gold(t, name):
    """A feature table, written once as the gold layer is, so that scoring reads it instead of building it again."""
    return materialize(getattr(medallion, f"features_{name}")(summary(t)), name)


POOL = f"""{TRADE}, p0 AS (SELECT * FROM trade WHERE SEASON = (SELECT max(SEASON) FROM trade) AND salary > 0 AND GP >= 30 AND MIN >= 15), pool AS (SELECT * FROM p0 WHERE salary <= (SELECT quantile_cont(salary, 0.85) FROM p0))"""


def mm(c):
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE (({c}) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


TRADE_SCORES = POOL + f""", q AS (SELECT *, (SELECT quantile_cont(salary, 0.5) FROM pool) AS med FROM pool), n AS (SELECT *,
 {mm('performance_score')} AS a, {mm('contract_efficiency')} AS b, {mm('age_upside_score::DOUBLE')} AS c, {mm('durability_score::DOUBLE')} AS d, {mm('coalesce(TS_PCT, 0.5)')} AS e, {mm('greatest(med - salary, 0.0)')} AS f0 FROM q),
sc AS (SELECT PLAYER_ID, round(0.15 * a + 0.35 * b + 0.20 * c + 0.10 * d + 0.10 * e + 0.10 * CASE WHEN salary <= med THEN f0 ELSE 0.0 END, 4) AS trade_target_score FROM n WHERE (SELECT count(*) FROM pool) >= 10)"""


@query("cp11_score_trade_targets", f"""WITH {TRADE_SCORES} SELECT row_number() OVER (ORDER BY trade_target_score DESC, CAST(substr(PLAYER_ID, 2) AS BIGINT)) AS rank, PLAYER_ID, trade_target_score,
 CASE WHEN trade_target_score <= 0 THEN NULL WHEN trade_target_score <= 0.3 THEN 'Low Value' WHEN trade_target_score <= 0.5 THEN 'Moderate' WHEN trade_target_score <= 0.7 THEN 'Strong Target' ELSE 'Elite Target' END AS tier FROM sc""")
def _(t):
    return scores.score_trade(gold(t, "trade_target")).select("rank", "PLAYER_ID", "trade_target_score", "tier")


@query("cp11_score_underrated", f"""WITH {SUMMARY}, vl AS (SELECT * EXCLUDE (salary), CASE WHEN salary > 0 THEN salary END AS salary0 FROM summary), vc AS (SELECT *, {CARRY} FROM vl), v AS (SELECT * FROM vc WHERE salary > 0),
 u0 AS (SELECT * FROM v WHERE SEASON = (SELECT max(SEASON) FROM v) AND GP >= 40 AND MIN >= 15), u AS (SELECT * FROM u0 WHERE salary <= (SELECT quantile_cont(salary, 0.75) FROM u0))
SELECT true AS of_the_pool, true AS gaps_positive, true AS ratios_right, true AS ranks_gapless, true AS order_right, count(*) AS pool FROM u""")
def _(t):
    """The scored rows against the pool they come from: who, gap, ratio, rank and order."""
    f = gold(t, "value_model")
    d = scores.score_underrated(f).select("rank", "PLAYER_ID", "salary", "predicted_salary", "undervaluation_ratio")
    pool = apply_filters(scoring.latest_partition(f, "SEASON"), {"GP": (">=", 40), "MIN": (">=", 15.0)}).filter("salary > 0")
    pool = scoring.percentile_cap(pool, "salary", 0.75).select("PLAYER_ID", F.lit(1).alias("here"))
    before = F.lag("undervaluation_ratio").over(Window.orderBy("rank"))
    d = d.withColumn("before", before).join(pool, "PLAYER_ID", "left")
    yes = lambda c, name: F.coalesce(F.bool_and(c), F.lit(True)).alias(name)
    facts = d.agg(yes(F.col("here").isNotNull(), "of_the_pool"), yes(F.col("predicted_salary") > F.col("salary"), "gaps_positive"),
                  yes(F.abs(F.col("undervaluation_ratio") - F.col("predicted_salary") / F.col("salary")) <= 0.005 + 1e-9, "ratios_right"),
                  (F.coalesce(F.max("rank"), F.lit(0)) == F.count_distinct("rank")).alias("ranks_gapless"),
                  yes(F.col("before").isNull() | (F.col("before") >= F.col("undervaluation_ratio")), "order_right"))
    return facts.crossJoin(F.broadcast(pool.agg(F.count(F.lit(1)).alias("pool"))))


@query("cp11_score_improvement", f"""WITH {SUMMARY}, l AS (SELECT *, lag(PTS) OVER w AS pp, lag(TS_PCT) OVER w AS pt, lag(AST) OVER w AS pa FROM summary WINDOW w AS (PARTITION BY PLAYER_ID ORDER BY SEASON)),
 i AS (SELECT * FROM l WHERE pp IS NOT NULL), y AS (SELECT * FROM i WHERE SEASON = (SELECT max(SEASON) FROM i) AND AGE <= 27 AND GP >= 30), q AS (SELECT quantile_cont(salary, 0.75) AS q FROM y WHERE salary > 0)
SELECT PLAYER_ID, true AS sound FROM y WHERE NOT coalesce((PTS >= 22 AND salary > 0 AND salary >= (SELECT q FROM q)) OR PTS >= 25, false)""")
def _(t):
    """Every young player who is no star, and whether probability, score, flag and rank agree."""
    d = scores.score_improvement(gold(t, "improvement_model"))
    p, b, s = F.col("improvement_probability"), F.col("trajectory_bonus"), F.col("breakout_score")
    right = p.between(0, 1) & (F.abs(scoring.breakout_score("improvement_probability", "trajectory_bonus") - s) < 1e-9) & (
        F.col("predicted_improved") == (s >= 0.5).cast("int")) & b.isNotNull()
    whole = Window.partitionBy()
    d = d.select("PLAYER_ID", right.alias("right"), s.alias("s"), "rank", F.lag(s).over(Window.orderBy("rank")).alias("before"), F.count(F.lit(1)).over(whole).alias("n"))
    return d.select("PLAYER_ID", (F.col("right") & F.col("rank").between(1, F.col("n")) & (F.col("before").isNull() | (F.col("before") >= F.col("s")))).alias("sound"))


# ------------------------------------------------------------------ silver
@query("cp02_dim_players", f"""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nm, '1995' AS f, '2001' AS u, 'nba_api' AS src FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'Roster ' || o_custkey, NULL, NULL, 'postgres_rosters' FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, nm) AS rn FROM a) SELECT 'P' || id AS player_id, id AS nba_api_player_id, nm AS player_name, {norm_sql('nm')} AS player_name_normalized, f AS from_year, u AS to_year FROM r WHERE rn = 1""")
def _(t):
    api = t("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("PERSON_ID"), F.col("c_name").alias("DISPLAY_FIRST_LAST"),
                                                            F.lit("1995").alias("FROM_YEAR"), F.lit("2001").alias("TO_YEAR"))
    ros = t("orders", "o_custkey").select(F.col("o_custkey").alias("player_id"), F.concat(F.lit("Roster "), F.col("o_custkey").cast("string")).alias("player_name"))
    return medallion.dim_players(api, ros)


@query("cp03_dim_teams", "SELECT CASE WHEN n_nationkey = 0 THEN '' ELSE 'T' || n_nationkey END AS team_id, n_nationkey AS nba_api_team_id, n_name AS team_name, upper(n_name) AS team_abbr, r_name AS conference, CAST(NULL AS VARCHAR) AS division, CAST(NULL AS VARCHAR) AS city FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    d = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = d.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("full_name"), F.lower("n_name").alias("abbreviation"), F.col("r_name").alias("team_conference"))
    return medallion.dim_teams(d)


@query("cp03_dim_seasons", "SELECT DISTINCT 'S' || year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season_id, CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(year(o_orderdate) AS INTEGER) AS start_year, CAST(year(o_orderdate) + 1 AS INTEGER) AS end_year FROM orders")
def _(t):
    return medallion.dim_seasons(t("orders", "o_orderdate").select(F.year("o_orderdate").cast("string").alias("season")))


@query("cp04_fact_player_season_stats", f"""WITH {SEASONS}, adv AS (SELECT o_custkey, year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS se, min(o_orderkey) / 10.0::DOUBLE AS PIE FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT 'P' || PLAYER_ID AS PLAYER_ID, 'S' || SEASON AS SEASON_ID, SEASON, upper(TEAM_ABBREVIATION) AS TEAM_ABBR, PTS, PIE FROM seasons LEFT JOIN adv ON o_custkey = PLAYER_ID AND se = SEASON""")
def _(t):
    adv = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").cast("string").alias("season"), (F.col("o_orderkey") / 10.0).alias("pie"))
    return medallion.fact_player_season_stats(seasons(t), adv).select("PLAYER_ID", "SEASON_ID", "SEASON", "TEAM_ABBR", "PTS", "PIE")


@query("cp05_fact_player_game_stats", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_extendedprice, l_partkey) AS rn FROM lineitem)
SELECT 'P' || l_suppkey AS PLAYER_ID, 'G' || l_orderkey AS GAME_ID, l_extendedprice AS PTS, l_partkey AS TEAM FROM r WHERE rn = 1""")
def _(t):
    logs = t("lineitem").select(F.col("l_suppkey").alias("player_id"), F.col("l_orderkey").alias("game_id"), F.col("l_extendedprice").alias("pts"), F.col("l_partkey").alias("team"))
    return medallion.fact_player_game_stats(logs).select("PLAYER_ID", "GAME_ID", "PTS", "TEAM")


@query("cp06_contracts_injuries", f"""WITH {SEASONS}, {INJ} SELECT 'contract' AS kind, {norm_sql('PLAYER_NAME')} AS nm, SEASON AS season, salary AS v FROM seasons WHERE salary IS NOT NULL
UNION ALL SELECT 'injury', {norm_sql('c_name')}, year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0'), CAST(o_orderkey % 20 AS DOUBLE) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def _(t):
    c = medallion.fact_player_contracts(contracts(t)).select(F.lit("contract").alias("kind"), F.col("player_name_normalized").alias("nm"), "season", F.col("salary").alias("v"))
    i = medallion.fact_player_injuries(injuries(t)).select(F.lit("injury").alias("kind"), F.col("player_name_normalized").alias("nm"), "season", F.col("games_missed").cast("double").alias("v"))
    return c.unionByName(i)


@query("cp07_team_results", "SELECT 'T' || s_suppkey AS TEAM_ID, 'S2023-24' AS SEASON_ID, s_acctbal AS WINS FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT '', 'S2023-24', s_acctbal FROM supplier WHERE s_suppkey = 0")
def _(t):
    d = t("supplier").select(F.col("s_suppkey").alias("teamid"), F.lit("2023").alias("season"), F.col("s_acctbal").alias("wins"))
    return medallion.fact_team_results(None, d.withColumnRenamed("teamid", "team_id")).select("TEAM_ID", "SEASON_ID", "WINS")


def mapping(t):
    return medallion.player_source_mapping({"stats": (t("orders", "o_custkey"), "o_custkey"), "advanced": (t("lineitem", "l_suppkey"), "l_suppkey"),
                                            "shots": (t("customer", "c_custkey"), "c_custkey")})


MAPPING = "mapping AS (SELECT DISTINCT 'P' || o_custkey AS player_id, 'stats' AS source_name FROM orders UNION ALL SELECT DISTINCT 'P' || l_suppkey, 'advanced' FROM lineitem UNION ALL SELECT DISTINCT 'P' || c_custkey, 'shots' FROM customer)"


@query("se03_source_mapping", f"WITH {MAPPING} SELECT * FROM mapping")
def _(t):
    return mapping(t)


@query("cp08_source_coverage", f"WITH {MAPPING} SELECT source_name, count(DISTINCT player_id) AS unique_players, count(*) AS total_records FROM mapping GROUP BY 1")
def _(t):
    return medallion.source_coverage(mapping(t))


@query("cp12_data_quality_summary", """SELECT 'silver' AS layer, 'orders' AS table_name, count(*) AS row_count, 6 AS column_count, 'ok' AS status FROM orders UNION ALL SELECT 'silver', 'customer', count(*), 5, 'ok' FROM customer
UNION ALL SELECT 'gold', 'events', count(*), 6, 'ok' FROM events UNION ALL SELECT 'gold', 'dim_games', 0, 0, 'missing'""")
def _(t):
    return medallion.data_quality_summary({"orders": t("orders"), "customer": t("customer")}, {"events": t("events"), "dim_games": None})


@query("cp23_rosters_by_season", """WITH p AS (SELECT c_custkey, 1990 + CAST(c_custkey % 12 AS INTEGER) AS f, 1992 + CAST(c_custkey % 17 AS INTEGER) AS u FROM customer), y AS (SELECT unnest(range(1996, 2003)) AS yr)
SELECT c_custkey, CAST(yr AS INTEGER) AS start_year, yr || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') AS season FROM p JOIN y ON yr BETWEEN f AND u""")
def _(t):
    p = t("customer").select("c_custkey", (F.lit(1990) + F.col("c_custkey") % 12).cast("string").alias("FROM_YEAR"), (F.lit(1992) + F.col("c_custkey") % 17).cast("string").alias("TO_YEAR"))
    return medallion.rosters_by_season(p, 1996, 2002).select("c_custkey", "start_year", "season")


@query("cp23_player_profiles", f"""WITH {SEASONS}, r AS (SELECT *, row_number() OVER (PARTITION BY PLAYER_ID ORDER BY SEASON DESC) AS rn FROM seasons)
SELECT PLAYER_ID AS player_id, SEASON AS season, CASE WHEN PTS >= 20 AND AST >= 6 THEN 'Playmaker' WHEN PTS >= 20 THEN 'Primary Scorer' WHEN PTS >= 15 AND AST >= 5 THEN 'Floor General' WHEN PTS >= 15 THEN 'Secondary Scorer'
  WHEN REB >= 8 AND PTS < 12 THEN 'Rebounding Specialist' WHEN REB >= 7 THEN 'Energy Big' WHEN AST >= 5 THEN 'Combo Guard' WHEN PTS >= 10 THEN '3-and-D Wing' WHEN MIN >= 20 THEN 'Versatile Forward' ELSE 'Bench' END AS role,
 CASE WHEN (PTS * 7) > 70 THEN 'fast' ELSE 'slow' END AS pace FROM r WHERE rn = 1 AND NOT (GP < 5 AND MIN < 5)""")
def _(t):
    s = seasons(t).withColumns({"OFF_RATING": F.when(F.col("PTS") * 7 > 70, 120.0).otherwise(90.0), "USG_PCT": F.lit(0.2)})
    return medallion.player_profiles(s).select("player_id", "season", "role", F.col("play_style.pace_preference").alias("pace"))


@query("cp24_missed_games", f"WITH {RAW_SEASONS} SELECT PLAYER_ID, yr AS \"year\", greatest(0, 75 - GP) AS games_missed FROM raw_seasons WHERE greatest(0, 75 - GP) >= 10")
def _(t):
    from touchline.catalog.base import raw_seasons
    return medallion.missed_games(raw_seasons(t)).select("PLAYER_ID", "year", "games_missed")


# ------------------------------------------------------------------ projection and filters on seasons
@query("pr02_upper_columns", "SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME, n_regionkey AS N_REGIONKEY FROM nation")
def _(t):
    return upper_columns(t("nation"))


@query("pr04_fill_existing", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, coalesce(salary, 0) AS salary, coalesce(BLK, 0) AS BLK FROM seasons")
def _(t):
    return fill_existing(seasons(t).select("PLAYER_ID", "SEASON", "salary", "BLK"), {"salary": 0, "BLK": 0, "nowhere": 0})


@query("pr05_zero_to_null", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def _(t):
    return t("customer").select("c_custkey", scoring.zero_to_null("c_acctbal").alias("balance"))


@query("pr11_filter_rules", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, GP, MIN, AGE FROM seasons WHERE GP >= 30 AND MIN >= 15 AND AGE <= 27 AND salary IS NOT NULL")
def _(t):
    d = apply_filters(seasons(t), {"GP": (">=", 30), "MIN": (">=", 15.0), "AGE": ("<=", 27), "HEIGHT": (">", 2)})
    return d.filter(F.col("salary").isNotNull()).select("PLAYER_ID", "SEASON", "GP", "MIN", "AGE")


@query("pr12_percentile_cap", "WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, o_totalprice FROM a WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.85) FROM a)")
def _(t):
    return scoring.percentile_cap(t("orders").filter("o_orderstatus = 'F'"), "o_totalprice", 0.85).select("o_orderkey", "o_totalprice")


@query("pr12_percentile_cap_by_group", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, quantile_cont(o_totalprice, 0.25) OVER (PARTITION BY o_orderpriority) AS q FROM orders) WHERE o_totalprice <= q")
def _(t):
    return scoring.percentile_cap(t("orders"), "o_totalprice", 0.25, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("pr13_exclude_stars", f"""WITH {SEASONS}, q AS (SELECT quantile_cont(salary, 0.75) AS q FROM seasons WHERE salary > 0) SELECT PLAYER_ID, SEASON, PTS, salary FROM seasons, q WHERE NOT (coalesce(PTS >= 22 AND salary > 0 AND salary >= q, false) OR PTS >= 25)""")
def _(t):
    return scoring.exclude_stars(seasons(t)).select("PLAYER_ID", "SEASON", "PTS", "salary")


@query("pr14_latest_partition", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON FROM seasons WHERE SEASON = (SELECT max(SEASON) FROM seasons)")
def _(t):
    return scoring.latest_partition(seasons(t), "SEASON").select("PLAYER_ID", "SEASON")


# ------------------------------------------------------------------ windows over seasons
@query("wi01_lag", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, lag(PTS) OVER w AS prev_PTS, lag(MIN) OVER w AS prev_MIN FROM seasons WINDOW w AS (PARTITION BY PLAYER_ID ORDER BY SEASON)")
def _(t):
    return ordered.with_lag(seasons(t), {"PTS": "prev_PTS", "MIN": "prev_MIN"}, ["PLAYER_ID"], ["SEASON"]).select("PLAYER_ID", "SEASON", "prev_PTS", "prev_MIN")


@query("wi02_lead", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, lead(PTS) OVER (PARTITION BY PLAYER_ID ORDER BY SEASON) AS next_PTS FROM seasons")
def _(t):
    return ordered.with_lead(seasons(t), {"PTS": "next_PTS"}, ["PLAYER_ID"], ["SEASON"]).select("PLAYER_ID", "SEASON", "next_PTS")


@query("wi03_delta", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, PTS - lag(PTS) OVER (PARTITION BY PLAYER_ID ORDER BY SEASON) AS PTS_delta FROM seasons")
def _(t):
    return ordered.with_delta(seasons(t), {"PTS": "PTS_delta"}, ["PLAYER_ID"], ["SEASON"]).select("PLAYER_ID", "SEASON", "PTS_delta")


@query("wi04_carry_forward", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, last_value(salary IGNORE NULLS) OVER (PARTITION BY PLAYER_ID ORDER BY SEASON ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS salary FROM seasons")
def _(t):
    return ordered.carry_forward(seasons(t), "salary", "salary", ["PLAYER_ID"], ["SEASON"]).select("PLAYER_ID", "SEASON", "salary")


@query("wi05_improved_flag", f"WITH {SEASONS}, n AS (SELECT *, lead(PTS) OVER (PARTITION BY PLAYER_ID ORDER BY SEASON) AS next_PTS FROM seasons) SELECT PLAYER_ID, SEASON, CASE WHEN next_PTS - PTS >= 2 AND GP >= 20 THEN 1 ELSE 0 END AS improved_flag FROM n")
def _(t):
    d = ordered.with_lead(seasons(t), {"PTS": "next_PTS"}, ["PLAYER_ID"], ["SEASON"])
    return d.select("PLAYER_ID", "SEASON", improved_flag().alias("improved_flag"))


@query("wi06_global_rank", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(t):
    return ordered.global_rank(t("orders", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("wi06_global_rank_skewed", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_totalprice < 300000 THEN 1.0 ELSE o_totalprice END DESC, o_orderkey) AS rank FROM orders")
def _(t):
    s = F.when(F.col("o_totalprice") < 300000, 1.0).otherwise(F.col("o_totalprice"))
    return ordered.global_rank(t("orders", "o_orderkey", "o_totalprice").withColumn("s", s), "s", "o_orderkey").select("o_orderkey", "rank")


# ------------------------------------------------------------------ models
@query("ml01_time_split", f"WITH {SEASONS} SELECT PLAYER_ID, SEASON, CASE WHEN SEASON <= '1998-99' THEN 'train' WHEN SEASON = '1999-00' THEN 'validation' ELSE 'test' END AS split FROM seasons")
def _(t):
    return training.time_split(seasons(t), "1998-99", "1999-00").select("PLAYER_ID", "SEASON", "split")


VALUE_ROWS = f"""{SUMMARY}, vl AS (SELECT * EXCLUDE (salary), CASE WHEN salary > 0 THEN salary END AS salary0 FROM summary), vc AS (SELECT *, {CARRY} FROM vl), v AS (SELECT * FROM vc WHERE salary > 0)"""


@query("ml03_train_value_models", f"""WITH {VALUE_ROWS}, tr AS (SELECT avg(salary) AS m, count(*) AS n FROM v WHERE SEASON <= '1998-99'), va AS (SELECT count(*) AS n, avg(abs(salary - (SELECT m FROM tr))) AS e FROM v WHERE SEASON = '1999-00')
SELECT unnest(['linear_regression', 'random_forest', 'gradient_boosting']) AS model, tr.n AS train_rows, va.n AS validation_rows, 16 AS features, round(va.e, 2) AS mean_mae, true AS sound, 'ok' AS status FROM tr, va""")
def _(t):
    """Facts of the fitted models that SQL knows: rows of the split, the error of the mean, and whether errors and choice agree."""
    f = gold(t, "value_model")
    r = training.train_value(f, "1998-99", "1999-00")
    least = min((m["mae"] for m in r["results"].values()), default=None)          # no model: no rows
    rows = [(n, r["train_rows"], r["validation_rows"], len(r["features"]), r["status"],
             0 <= m["mae"] <= m["rmse"] * (1 + 1e-9) and m["r2"] <= 1 and (n == r["best"]) == (m["mae"] == least)) for n, m in r["results"].items()]
    models = f.sparkSession.createDataFrame(rows, "model string, train_rows bigint, validation_rows bigint, features int, status string, sound boolean")
    mean = f.filter("SEASON <= '1998-99'").agg(F.avg("salary").alias("m"))
    error = f.filter("SEASON = '1999-00'").crossJoin(F.broadcast(mean)).agg(F.round(F.avg(F.abs(F.col("salary") - F.col("m"))), 2).alias("mean_mae"))
    return models.crossJoin(F.broadcast(error))


@query("ml04_train_improvement_models", f"""WITH {SUMMARY}, l AS (SELECT *, lag(PTS) OVER w AS prev_PTS, lead(PTS) OVER w AS next_PTS FROM summary WINDOW w AS (PARTITION BY PLAYER_ID ORDER BY SEASON)),
 m AS (SELECT SEASON, CASE WHEN next_PTS - PTS >= 2.0 AND GP >= 20 THEN 1 ELSE 0 END AS y FROM l WHERE prev_PTS IS NOT NULL)
SELECT unnest(['logistic_regression', 'random_forest', 'gradient_boosting']) AS model, count(*) FILTER (WHERE SEASON <= '1998-99') AS train_rows, count(*) FILTER (WHERE SEASON > '1998-99') AS test_rows, sum(y) FILTER (WHERE SEASON > '1998-99') AS test_positives, true AS sound FROM m""")
def _(t):
    f = gold(t, "improvement_model")
    r = training.train_improvement(f, "1998-99")
    most = max((m["f1"] for m in r["results"].values()), default=None)
    rows = [(n, r["train_rows"], r["test_rows"], all(0 <= m[k] <= 1 for k in ("accuracy", "f1", "auc")) and (n == r["best"]) == (m["f1"] == most and most > 0))
            for n, m in r["results"].items()]
    models = f.sparkSession.createDataFrame(rows, "model string, train_rows bigint, test_rows bigint, sound boolean")
    return models.crossJoin(F.broadcast(f.filter("SEASON > '1998-99'").agg(F.sum(F.col("improved_flag").cast("bigint")).alias("test_positives"))))


@query("ml05_regression_metrics", """SELECT o_orderpriority, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT o_orderpriority, o_totalprice / 1000 AS y, 250.0::DOUBLE + o_orderkey % 7 AS p FROM orders) GROUP BY 1""")
def _(t):
    d = t("orders").select("o_orderpriority", (F.col("o_totalprice") / 1000).alias("y"), (F.lit(250.0) + F.col("o_orderkey") % 7).alias("p"))
    return training.regression_metrics(d, "y", "p", ["o_orderpriority"]).select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query("ml05_classification_metrics", """WITH c AS (SELECT source, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fn, count(*) FILTER (WHERE toxic <> 1 AND quality <> 1) AS tn
 FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, tp, fp, fn, tn, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def _(t):
    d = t("labels").join(t("documents", "doc_id", "source"), "doc_id")
    return training.classification_metrics(d, "toxic", "quality", ["source"])


# ------------------------------------------------------------------ quality
@query("ag17_profile_tables", """SELECT 'customer' AS table_name, count(*) AS row_count, 5 AS column_count, c AS column_name, 0::BIGINT AS nulls FROM customer, (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS c) GROUP BY c
UNION ALL SELECT 'nation', count(*), 3, c, 0 FROM nation, (SELECT unnest(['n_nationkey','n_name','n_regionkey']) AS c) GROUP BY c""")
def _(t):
    return quality.profile_tables({"customer": t("customer"), "nation": t("nation"), "gone": None})


@query("ag31_quality_gate", """SELECT 'orders' AS table_name, count(*) AS row_count, 2 AS column_count, 'st' AS column_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS nulls, 'too_many_nulls' AS violation FROM orders HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0.1 * count(*)
UNION ALL SELECT 'nation', count(*), 3, unnest(['n_nationkey','n_name','n_regionkey']), 0, 'too_few_rows' FROM nation""")
def _(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("st"))
    return quality.quality_gate(quality.profile_tables({"orders": o, "nation": t("nation")}), {"orders": 1, "nation": 1000})


@query("ag01_contracts_agg", f"WITH {SEASONS} SELECT TEAM_ABBREVIATION, SEASON, max(salary) AS salary FROM seasons GROUP BY 1, 2")
def _(t):
    return agg.contracts_agg(seasons(t), ["TEAM_ABBREVIATION", "SEASON"])


@query("ag02_injuries_agg", "SELECT o_custkey, CAST(sum(o_orderkey % 20) AS BIGINT) AS total_games_missed, count(*) AS injury_count FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def _(t):
    d = t("orders").filter("o_orderstatus = 'P'").withColumn("games_missed", F.col("o_orderkey") % 20)
    return agg.injuries_agg(d, ["o_custkey"])


@query("ag03_coverage", "SELECT event_type, count(DISTINCT user_id) AS unique_players, count(*) AS total_records FROM events GROUP BY 1")
def _(t):
    return agg.coverage(t("events"), "event_type", "user_id")


@query("ag19_latest_per_key", f"WITH {SEASONS} SELECT PLAYER_ID, max(SEASON) AS SEASON, arg_max(PTS, SEASON) AS PTS FROM seasons GROUP BY 1")
def _(t):
    return ordered.latest_by(seasons(t).select("PLAYER_ID", "SEASON", "PTS"), ["PLAYER_ID"], ["SEASON"])
