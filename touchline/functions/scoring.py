"""Player value arithmetic, steps, scales, tiers, grades and role tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def zero_to_null(col) -> Column:
    c = _c(col)
    return F.when(c > 0, c)


def performance_score() -> Column:
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    return (F.col("PTS") * 1.0 + F.col("REB") * 1.2 + F.col("AST") * 1.5
            + z("STL") * 2.0 + z("BLK") * 2.0 - z("TOV") * 1.0)


def contract_efficiency(score="performance_score", salary="salary") -> Column:
    s = _c(salary)
    return F.when(s > 0, _c(score) / (s / 1_000_000)).otherwise(F.lit(0.0))


# Fixed values: (upper bound, points), then the points above the last bound
AGE_STEPS = ([(23, 10), (25, 8), (27, 6), (30, 4), (33, 2)], 1)
DURABILITY_STEPS = ([(5, 10), (15, 7), (30, 4)], 2)


def step_score(col, steps) -> Column:
    bounds, rest = steps
    c, out = _c(col), None
    for limit, points in bounds:
        out = (F if out is None else out).when(c <= limit, F.lit(points))
    return out.otherwise(F.lit(rest))


def with_stats(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to rows: one small aggregate joined back, never a whole-group window.

    Without ``by`` the aggregate is a single row, so broadcasting it is safe at any table size.
    """
    if by:
        g = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
        g = g.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], *aggs)
        cond = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
        return df.join(g, cond).drop(*[f"_b{i}" for i in range(len(by))])
    one = df.agg(*[c.alias(n) for n, c in aggs.items()]).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def range_stats(cols: Sequence[str]) -> dict[str, Column]:
    return {**{f"_lo_{c}": F.min(c) for c in cols}, **{f"_hi_{c}": F.max(c) for c in cols}}


def min_max(df: DataFrame, cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Scale to 0..1; a constant column becomes 0.5. ``cols``: source -> new name."""
    aggs = range_stats(list(cols))
    return with_stats(df, by, **aggs).withColumns({new: scaled(c) for c, new in cols.items()}).drop(*aggs)


def zscore(df: DataFrame, cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Population z-score per group; zero or undefined spread counts as 1, a missing value as 0."""
    aggs = {}
    for c in cols:
        aggs[f"_mu_{c}"], aggs[f"_sd_{c}"] = F.avg(c), F.stddev_pop(c)
    out = with_stats(df, by, **aggs)
    for c, new in cols.items():
        sd = F.col(f"_sd_{c}")
        sd = F.when(sd.isNull() | F.isnan(sd) | (sd == 0), F.lit(1.0)).otherwise(sd)
        out = out.withColumn(new, F.coalesce((F.col(c) - F.col(f"_mu_{c}")) / sd, F.lit(0.0)))
    return out.drop(*aggs)


def percentile_cap(df: DataFrame, col: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """Keep rows at or below the interpolated percentile of the rows that reached this filter."""
    from touchline.operators.aggregates import with_quantiles

    return with_quantiles(df, col, {"_cap": p}, by).filter(F.col(col) <= F.col("_cap")).drop("_cap")


def latest_partition(df: DataFrame, col: str) -> DataFrame:
    return with_stats(df, [], _latest=F.max(col)).filter(F.col(col) == F.col("_latest")).drop("_latest")


def exclude_stars(df: DataFrame, pts: float = 22.0, obvious: float = 25.0, p: float = 0.75) -> DataFrame:
    """Drop high scorers on big contracts and every very high scorer; a missing salary never matches."""
    from touchline.operators.aggregates import with_quantiles

    d = with_quantiles(df.withColumn("_valid", F.when(F.col("salary") > 0, F.col("salary"))), "_valid", {"_q": p})
    star = ((F.col("PTS") >= pts) & (F.col("_valid") >= F.col("_q"))) | (F.col("PTS") >= obvious)
    return d.filter(~F.coalesce(star, F.lit(False))).drop("_q", "_valid")


def median_stats(col: str) -> dict[str, Column]:
    """Aggregates that ``median_bonus`` needs besides the median."""
    return {"_cheap": F.min(col), "_dear": F.max(col)}


def with_median(df: DataFrame, col: str) -> DataFrame:
    """Attach the column's median as ``_med``."""
    from touchline.operators.aggregates import with_quantiles

    return with_quantiles(df, col, {"_med": 0.5})


def median_bonus(col: str) -> Column:
    """0..1 by distance below the median for rows at or below it, else 0; equal distances scale to 0.5."""
    below = lambda c: F.greatest(F.col("_med") - c, F.lit(0.0))
    lo, hi = below(F.col("_dear")), below(F.col("_cheap"))
    scaled = F.when(lo == hi, F.lit(0.5)).otherwise((below(F.col(col)) - lo) / (hi - lo))
    return F.when(F.col(col) <= F.col("_med"), scaled).otherwise(F.lit(0.0))


def below_median_bonus(df: DataFrame, col: str, out: str) -> DataFrame:
    stats = median_stats(col)
    return with_median(with_stats(df, [], **stats), col).withColumn(out, median_bonus(col)).drop(*stats, "_med")


def scaled(col: str) -> Column:
    """Min-max scale from ``_lo_<col>``, ``_hi_<col>``."""
    lo, hi = F.col(f"_lo_{col}"), F.col(f"_hi_{col}")
    return F.when(lo == hi, F.lit(0.5)).otherwise((F.col(col) - lo) / (hi - lo))


# Trade score weights
TRADE_WEIGHTS = {
    "performance_score": 0.15,
    "contract_efficiency": 0.35,
    "age_upside_score": 0.20,
    "durability_score": 0.10,
    "efficiency_score": 0.10,
    "salary_bonus": 0.10,
}


def composite(weights: dict[str, float], suffix: str = "_norm", digits: int = 4) -> Column:
    total = None
    for name, w in weights.items():
        term = F.lit(w) * F.col(name + suffix)
        total = term if total is None else total + term
    return F.round(total, digits)


# Right-closed score tiers
TIERS = [(0.3, "Low Value"), (0.5, "Moderate"), (0.7, "Strong Target"), (1.01, "Elite Target")]


def tier(col) -> Column:
    c = _c(col)
    out = F.when(c <= 0, F.lit(None).cast("string"))
    for hi, label in TIERS:
        out = out.when(c <= hi, label)
    return out


def trajectory_bonus(pts="PTS_delta", ts="TS_PCT_delta", ast="AST_delta") -> Column:
    def part(c, scale, cap):
        return F.when(c > 0, F.least(c * scale, F.lit(cap))).otherwise(F.lit(0.0))
    return part(_c(pts), F.lit(1 / 5.0), 0.15) + part(_c(ts), F.lit(2.0), 0.10) + part(_c(ast), F.lit(1 / 3.0), 0.05)


def breakout_score(probability, bonus) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(probability) + F.round(_c(bonus), 3))), 4)


def undervaluation(df: DataFrame, predicted="predicted_salary", salary="salary") -> DataFrame:
    """Gap, ratio (2 digits) and percentage (1 digit); only rows predicted above their salary stay."""
    d = df.withColumn("undervaluation_gap", F.col(predicted) - F.col(salary)).filter(F.col("undervaluation_gap") > 0)
    return d.withColumns({
        "undervaluation_ratio": F.round(F.col(predicted) / F.col(salary), 2),
        "undervaluation_pct": F.round(F.col("undervaluation_gap") / F.col(salary) * 100, 1)})


def role(ppg, rpg, apg, mpg, rest: str = "Bench") -> Column:
    """Role from a stat line; the last label replaces a random pick."""
    p, r, a, m = map(_c, (ppg, rpg, apg, mpg))
    return (F.when((p >= 20) & (a >= 6), "Playmaker").when(p >= 20, "Primary Scorer")
            .when((p >= 15) & (a >= 5), "Floor General").when(p >= 15, "Secondary Scorer")
            .when((r >= 8) & (p < 12), "Rebounding Specialist").when(r >= 7, "Energy Big")
            .when(a >= 5, "Combo Guard").when(p >= 10, "3-and-D Wing")
            .when(m >= 20, "Versatile Forward").otherwise(rest))


def scoring_style(ppg, ts) -> Column:
    return (F.when(_c(ppg) >= 25, "elite volume scorer").when(_c(ts) > 0.60, "efficient scorer")
            .when(_c(ppg) >= 15, "capable scorer").otherwise("selective scorer"))


def defensive_profile(rpg, bpg, spg) -> Column:
    return (F.when(_c(bpg) >= 1.5, "rim protector").when(_c(spg) >= 1.5, "active hands defender")
            .when(_c(rpg) >= 8, "glass cleaner").otherwise("positional defender"))


def grade(accuracy) -> Column:
    a = _c(accuracy)
    return (F.when(a >= 0.95, "S").when(a >= 0.85, "A").when(a >= 0.70, "B").when(a >= 0.50, "C").otherwise("F"))


def stars(accuracy) -> Column:
    a = _c(accuracy)
    return (F.when(a >= 0.95, 5).when(a >= 0.80, 4).when(a >= 0.65, 3).when(a >= 0.45, 2).when(a >= 0.25, 1).otherwise(0))


def multiplier(streak) -> Column:
    s = _c(streak)
    return F.when(s >= 30, 4).when(s >= 20, 3).when(s >= 10, 2).otherwise(1)


def missed_games_estimate(gp, season_games: int = 75) -> Column:
    return F.greatest(F.lit(0), F.lit(season_games) - _c(gp))
