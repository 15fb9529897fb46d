"""Windowed operators: change detection, gaps, streaks, fills, moments and timelines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scoring import multiplier
from touchline.operators import ordered


def improved_flag(next_pts="next_PTS", pts="PTS", gp="GP") -> Column:
    return F.when((F.col(next_pts) - F.col(pts) >= 2.0) & (F.col(gp) >= 20), 1).otherwise(0)


def changes_only(df: DataFrame, by: Sequence[str], cols: Sequence[str], order: Sequence, chunk: Column | None = None) -> DataFrame:
    """Rows whose fingerprint differs from the row before (a value may come back later)."""
    d = df.withColumn("_fp", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    d = ordered.with_lag(d, {"_fp": "_old"}, by, order, chunk)
    return d.filter(F.col("_old").isNull() | (F.col("_fp") != F.col("_old"))).drop("_fp", "_old")


def gap_segments(df: DataFrame, by: Sequence[str], t: str, has: str, min_ms: int, frame_ms: int,
                 chunk: Column | None = None) -> DataFrame:
    """Runs without data of at least ``min_ms``; a run still open at the end lasts one frame longer."""
    d = ordered.with_lag(df.select(*by, t, has), {has: "_prev"}, by, [t], chunk)
    d = ordered.carry_backward(d.withColumn("_t_ok", F.when(F.col(has), F.col(t))), "_t_ok", "_end", by, [t], chunk)
    last = df.groupBy(*by).agg(F.max(t).alias("_last"))
    starts = d.filter(~F.col(has) & F.coalesce(F.col("_prev"), F.lit(True))).join(last, list(by))
    end = F.coalesce("_end", "_last")
    dur = end - F.col(t) + F.when(F.col("_end").isNull(), F.lit(frame_ms)).otherwise(F.lit(0))
    return starts.select(*by, F.col(t).alias("start_ms"), end.alias("end_ms"), dur.alias("duration_ms")) \
        .filter(F.col("duration_ms") >= min_ms)


def time_jumps(df: DataFrame, by: Sequence[str], t: str, min_ms: int, chunk: Column | None = None) -> DataFrame:
    """Places where the next row is at least ``min_ms`` later."""
    d = ordered.with_lead(df.select(*by, t), {t: "_next"}, by, [t], chunk)
    return d.filter(F.col("_next") - F.col(t) >= min_ms).select(
        *by, F.col(t).alias("start_ms"), F.col("_next").alias("end_ms"), (F.col("_next") - F.col(t)).alias("duration_ms"))


def clock_stopped(df: DataFrame, by: Sequence[str], period: str, clock: str, order: Sequence,
                  chunk: Column | None = None) -> DataFrame:
    d = ordered.with_lag(df, {period: "_p", clock: "_c"}, by, order, chunk)
    same = (F.col("_p") == F.col(period)) & (F.col("_c") == F.col(clock))
    return d.withColumn("clock_stopped", F.coalesce(same, F.lit(False))).drop("_p", "_c")


def streak_score(df: DataFrame, by: Sequence[str], order: Sequence, hit: Column, base: Column,
                 chunk: Column | None = None) -> DataFrame:
    """``streak`` after each row (0 on a miss) and ``points`` = base * multiplier of the streak before it."""
    d = df.withColumns({"_hit": hit.cast("bigint"), "_base": base})
    d = ordered.running_sum(d, "_hit", "_hits", by, order, chunk)
    d = d.withColumn("_at_miss", F.when(F.col("_hit") == 0, F.col("_hits")))
    d = ordered.carry_forward(d, "_at_miss", "_reset", by, order, chunk)
    streak = F.col("_hits") - F.coalesce("_reset", F.lit(0))
    d = d.withColumn("streak", streak)
    points = F.when(F.col("_hit") == 1, F.col("_base") * multiplier(F.col("streak") - 1)).otherwise(F.lit(0))
    return d.withColumn("points", points.cast("bigint")).drop("_hit", "_base", "_hits", "_at_miss", "_reset")


def segment_break(df: DataFrame, by: Sequence[str], order: Sequence, max_gap_ms, max_speed, chunk: Column | None = None,
                  keep: dict[str, str] | None = None) -> DataFrame:
    """Break flag from raw x, y, t only: first row, other period, bad or long step, implausible jump.

    Adds dt_ms, raw distance (null across breaks) and the previous values named in ``keep``.
    """
    need = {"t_ms": "_pt", "period": "_pp", "x_m": "_px", "y_m": "_py"}
    keep = keep or {}
    d = ordered.with_lag(df, {**need, **{c: n for c, n in keep.items() if c not in need}}, by, order, chunk)
    d = d.withColumns({n: F.col(need[c]) for c, n in keep.items() if c in need})
    dt = F.col("t_ms") - F.col("_pt")
    step = F.hypot(F.col("x_m") - F.col("_px"), F.col("y_m") - F.col("_py"))
    gap = max_gap_ms if isinstance(max_gap_ms, Column) else F.lit(max_gap_ms)
    vmax = max_speed if isinstance(max_speed, Column) else F.lit(max_speed)
    same = F.coalesce(F.col("_pp") == F.col("period"), F.lit(False))
    near = same & (dt > 0) & (dt <= gap)
    far = near & (step / (dt / 1000.0) > vmax)
    return d.withColumns({
        "gap_ms": dt, "implausible": F.coalesce(far, F.lit(False)),
        "segment_start": ~(near & ~far), "gap_too_long": F.coalesce(same & (dt > gap), F.lit(False)),
        "dist_raw_m": F.when(near & ~far, step)}).drop("_pt", "_pp", "_px", "_py")


def fill_both(df: DataFrame, cols: Sequence[str], by: Sequence[str], order: Sequence, chunk: Column | None = None) -> DataFrame:
    """Forward fill, then backward fill what is still missing."""
    for c in cols:
        df = ordered.carry_forward(df, c, "_f", by, order, chunk)
        df = ordered.carry_backward(df, c, "_b", by, order, chunk)
        df = df.withColumn(c, F.coalesce("_f", "_b")).drop("_f", "_b")
    return df


def moving_avg3(df: DataFrame, col: str, out: str, by: Sequence[str], order: Sequence, chunk: Column | None = None) -> DataFrame:
    """Mean of previous, current and next value; missing neighbours count as zero."""
    d = ordered.with_lag(df, {col: "_l"}, by, order, chunk)
    d = ordered.with_lead(d, {col: "_r"}, by, order, chunk)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.withColumn(out, (z("_l") + F.col(col) + z("_r")) / 3).drop("_l", "_r")


def period_offsets(df: DataFrame, by: Sequence[str], period: str, duration: str, out: str = "offset_ms") -> DataFrame:
    """Sum of the durations of the earlier periods (a match has few periods)."""
    d = ordered.running_sum(df, duration, "_upto", by, [period], include_current=False)
    return d.withColumn(out, F.coalesce("_upto", F.lit(0)).cast("bigint")).drop("_upto")


def lyric_sections(lines: DataFrame, doc: Sequence[str], t: str, duration: str, gap_ms: int = 4000,
                   chunk: Column | None = None) -> DataFrame:
    """Vocal spans between gaps longer than ``gap_ms`` and the instrumental spans around them."""
    d = ordered.with_lead(lines, {t: "_next"}, doc, [t], chunk)
    d = ordered.with_lag(d, {t: "_prev"}, doc, [t], chunk)
    gap = F.coalesce(F.col("_next"), F.col(duration)) - F.col(t)
    d = d.withColumns({"_gap": gap, "_ends": (gap > gap_ms) | F.col("_next").isNull(),
                       "_starts": F.col("_prev").isNull() | (F.col(t) - F.col("_prev") > gap_ms)})
    d = ordered.carry_forward(d.withColumn("_s", F.when(F.col("_starts"), F.col(t))), "_s", "_from", doc, [t], chunk)
    ends = d.filter("_ends")
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.cast("bigint").alias("start_ms"), b.cast("bigint").alias("end_ms"))
    T = F.col(t)
    vocal = span("vocal", F.col("_from"), T + F.least(F.col("_gap"), F.lit(3000)))
    between = F.when(F.col("_next").isNotNull() & (F.col("_gap") > gap_ms), span("instrumental", T + 2000, F.col("_next") - 500))
    outro = F.when(F.col("_next").isNull() & (F.col(duration) - T > gap_ms), span("instrumental", T + 3000, F.col(duration) - 1000))
    a = ends.select(*doc, F.explode(F.array_compact(F.array(vocal, between, outro))).alias("s"))
    first = d.filter(F.col("_prev").isNull() & (T > gap_ms)).select(*doc, span("instrumental", F.lit(2000), T - 500).alias("s"))
    return a.unionByName(first).select(*doc, "s.*")


def moment_vectors(sec: DataFrame, match: Sequence[str], features: Sequence[str], window: int = 10, step: int = 2,
                   min_seconds: int = 8, max_null: float = 0.25, teams: Sequence[str] = (), poss: bool = False) -> DataFrame:
    """Anchors every ``step`` seconds with mean and trend of each feature over the causal window.

    ``sec``: one row per (match, period, sec) with the feature columns and ``t_ms``. Each second is sent to the
    few anchors whose window holds it, so a group has at most ``window`` rows. The trend is the mean of the
    last three minus the mean of the first three rows present.
    """
    key = [*match, "period"]
    span = sec.groupBy(*key).agg((F.min("sec") + window - 1).alias("_lo"), F.max("sec").alias("_hi"))
    d = sec.join(span, key)
    first = F.greatest(F.col("sec"), F.col("_lo"))
    first = first + (first - F.col("_lo")) % step
    last = F.least(F.col("sec") + window - 1, F.col("_hi"))
    d = d.withColumns({"_a": first.cast("bigint"), "_z": last.cast("bigint")}).filter(F.col("_a") <= F.col("_z"))
    d = d.withColumn("anchor", F.explode(F.sequence("_a", "_z", F.lit(step).cast("bigint"))))
    extra = [f"{t}_poss_share" for t in teams] if poss else []
    g = d.groupBy(*key, "anchor").agg(
        F.array_sort(F.collect_list(F.struct("sec", "t_ms", *features, *extra))).alias("rows"))
    g = g.filter(F.size("rows") >= min_seconds)

    def mean(rows, f):
        v = F.filter(F.transform(rows, lambda r: r[f].cast("double")), lambda x: x.isNotNull())
        return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))

    rows = F.col("rows")
    head, tail = F.slice(rows, 1, 3), F.slice(rows, F.size(rows) - 2, 3)
    vec = {}
    for f in features:
        vec[f"{f}__mean"] = mean(rows, f)
        vec[f"{f}__trend"] = mean(tail, f) - mean(head, f)
    g = g.withColumns(vec)
    nulls = sum((F.col(n).isNull().cast("int") for n in vec), F.lit(0))
    g = g.filter(nulls / F.lit(len(vec)) <= max_null)
    here = F.element_at(F.filter(rows, lambda r: r["sec"] == F.col("anchor")), -1)["t_ms"]
    exact = F.exists(rows, lambda r: r["sec"] == F.col("anchor"))
    g = g.withColumn("t_ms", F.when(exact, here).otherwise(F.col("anchor") * 1000).cast("bigint"))
    if poss:
        newest = F.filter(rows, lambda r: r["sec"] > F.element_at(rows, -1)["sec"] - 3)
        label = None
        for t in teams:
            label = (F if label is None else label).when(mean(newest, f"{t}_poss_share") >= 0.6, F.lit(t))
        g = g.withColumn("label", label)
    return g.drop("rows")


def with_page(df: DataFrame, from_col: str, start: int, limit: int, order: Sequence) -> DataFrame:
    """Rows from a cursor onward, ordered, at most ``limit`` (the page size is the feature)."""
    return df.filter(F.col(from_col) >= start).orderBy(*order).limit(limit)


def top_n(df: DataFrame, col: str, n: int, tie: Sequence = ()) -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last(), *tie).limit(n)
