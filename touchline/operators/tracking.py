"""Movement metrics from tracking positions: segments, smoothing, speed, sprints, windows, dwell, team shape.

Everything is a DataFrame plan. With ``chunk=None`` all steps of one entity share one shuffle on
(session, match, entity); ``plan_chunk`` switches to blocks of sequence numbers when one entity holds too
many rows for a task.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators import ordered
from touchline.operators.windows import segment_break
from touchline.session import materialize

BLOCK = 256


def block_rows(alpha: float) -> int:
    """Rows after which a smoothed value has lost its share of what came before, to below double precision.

    Weights grow by as much over a block as values fade, so the same length keeps them in range for every alpha.
    """
    return max(2, math.ceil(18 / -math.log10(1.0 - alpha)))

# most selective first: rows are sorted by these
ENTITY = ["entity_id", "match_id", "session_id"]


@dataclass(frozen=True)
class Sport:
    """Thresholds of one sport."""
    name: str
    reorder_frames: int
    max_gap_ms: int
    max_speed_player: float
    max_speed_ball: float
    ema_alpha: float
    high_speed: float
    sprint_speed: float
    accel: float
    window_ms: int
    grid_nx: int
    grid_ny: int
    min_outfield: int
    idle_ms: int
    length_m: float
    width_m: float
    version: str = "1.0.0"


# Reorder depth, gap, speed limits, smoothing, thresholds, window, grid, minimum players, idle time
SOCCER = Sport("soccer", 20, 500, 12.5, 45.0, 0.5, 5.5, 7.0, 3.0, 60000, 21, 13, 8, 120000, 105.0, 68.0)
BASKETBALL = Sport("basketball", 50, 200, 10.5, 30.0, 0.35, 4.5, 6.0, 3.0, 60000, 19, 10, 5, 120000,
                   geo.COURT_LENGTH_M, geo.COURT_WIDTH_M)
SPORTS = {s.name: s for s in (SOCCER, BASKETBALL)}


def plan_chunk(pos: DataFrame, hot_rows: int | None = None, width: int = 4 * BLOCK) -> Column | None:
    return ordered.split_if_hot(pos, ENTITY, ordered.by_number("seq", width), hot_rows)


def with_cells(pos: DataFrame, cfg: Sport) -> DataFrame:
    both = F.col("x_att").isNotNull() & F.col("y_att").isNotNull()
    return pos.withColumns({
        "cell_x": F.when(both, geo.grid_cell("x_att", cfg.length_m, cfg.grid_nx)),
        "cell_y": F.when(both, geo.grid_cell("y_att", cfg.width_m, cfg.grid_ny))})


def ema(df: DataFrame, alpha: float, by, order: str, cols: dict[str, str], start: str = "segment_start",
        seeds: dict[str, str] | None = None, chunk: Column | None = None) -> DataFrame:
    """Causal exponential smoothing that restarts where ``start`` is true, written as running sums.

    s_n is the sum of w_i (1-a)^(n-i), with weight 1 on the first row of a segment and ``a`` after it. Rows get
    a gapless number per key and sums run inside blocks of ``block_rows(alpha)`` rows, which keeps the powers in
    range. A full block shrinks whatever came before it to below double precision, so a block needs only the end
    value of the block before. ``seeds`` names columns that replace the first value of a segment when not null.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    keep = 1.0 - alpha
    seeds = seeds or {}
    if keep == 0:                               # nothing is carried on
        return df.withColumns({out: F.when(F.col(start) & F.col(seeds[c]).isNotNull(), F.col(seeds[c])).otherwise(F.col(c))
                               if c in seeds else F.col(c) for c, out in cols.items()})
    block = block_rows(alpha)
    d = ordered.with_sequence(df, "_n", by, [order], chunk)
    if chunk is not None:
        d = materialize(d, "ema")
    d = d.withColumns({"_blk": F.floor(F.col("_n") / block), "_k": (F.col("_n") % block).cast("double")})
    # a piece is a segment cut at block borders; numbering pieces along the key keeps the sort order already there
    scope = [*by] if chunk is None else [ordered.SCOPE]
    if chunk is not None:
        d = d.withColumn(ordered.SCOPE, F.struct(*by, "_blk"))              # the join's key too: no second shuffle
    along = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col(start) | (F.col("_k") == 0)
    d = d.withColumns({"_piece": F.sum(cut.cast("int")).over(along),
                       # no break since the block began: the block before still has a share
                       "_open": F.last(F.when(cut, ~F.col(start)), ignorenulls=True).over(along)})
    w = F.when(F.col(start), 1.0).otherwise(alpha)
    up, down = F.pow(F.lit(keep), -F.col("_k")), F.pow(F.lit(keep), F.col("_k"))
    first = {c: (F.coalesce(F.col(seeds[c]), F.col(c)) if c in seeds else F.col(c)) for c in cols}
    piece = Window.partitionBy(*scope, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_l_{c}": F.sum(w * first[c] * up).over(piece) * down for c in cols})
    ends = F.struct(*[F.col(f"_l_{c}").alias(c) for c in cols])
    if chunk is None:
        # the latest block end before a row closes the block before it
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("_end", F.last(F.when(F.col("_k") == block - 1, ends), ignorenulls=True).over(before))
    else:
        edge = d.filter(F.col("_k") == block - 1).select(
            F.struct(*by, (F.col("_blk") + 1).alias("_blk")).alias("_e"), ends.alias("_end"))
        d = d.join(edge, F.col(ordered.SCOPE) == F.col("_e"), "left").drop(ordered.SCOPE, "_e")
    rest = F.pow(F.lit(keep), F.col("_k") + 1)
    carried = lambda c: F.when(F.col("_open"), F.coalesce(rest * F.col(f"_end.{c}"), F.lit(0.0))).otherwise(F.lit(0.0))
    d = d.withColumns({out: F.col(f"_l_{c}") + carried(c) for c, out in cols.items()})
    return d.drop("_n", "_blk", "_k", "_piece", "_open", "_end", *[f"_l_{c}" for c in cols])


def sprint_entries(d: DataFrame, sprint_speed: float, chunk: Column | None = None, by=None, order: str = "seq") -> DataFrame:
    """``sprint_entry``, and the state after each row: ``in_sprint`` and ``below_ms``.

    A sprint starts on an interval at or above the threshold when the interval before was below it and at least
    1000 ms below the threshold have passed since the last sprint. Only valid player intervals count, and the
    state lives on across segment breaks. An entity never seen sprinting starts with "long below".
    """
    never = 10**9
    by = by or ENTITY
    valid = ~F.col("segment_start") & ~F.col("is_state") & (F.col("entity_type") == "player")
    fast = F.col("speed_mps") >= sprint_speed
    slow = (F.when(F.col("is_state"), F.coalesce("below0", F.lit(never))).when(F.col("gap_ms").isNull(), F.lit(never))
            .when(valid & ~fast, F.col("gap_ms")).otherwise(F.lit(0)))
    d = d.withColumns({"_fast": F.when(F.col("is_state"), F.coalesce("sprint0", F.lit(False))).when(valid, fast),
                       "_slow": slow.cast("bigint")})
    cut = (lambda x: x) if chunk is None else (lambda x: materialize(x, "sprint"))
    d = cut(ordered.sums_and_lasts(d, {"_slow": "_cum"}, {"_fast": "in_sprint"}, by, [order], chunk))
    d = d.withColumn("_mark", F.when(valid & fast, F.col("_cum")))
    d = cut(ordered.carry_forward(d, "_mark", "_last", by, [order], chunk))
    d = d.withColumns({"below_ms": F.col("_cum") - F.coalesce("_last", F.lit(0)),
                       "in_sprint": F.coalesce("in_sprint", F.lit(False))})
    d = ordered.with_lag(d, {"below_ms": "_b", "in_sprint": "_i"}, by, [order], chunk)
    entry = valid & fast & ~F.col("_i") & (F.col("_b") >= 1000)
    return d.withColumn("sprint_entry", F.coalesce(entry, F.lit(False))) \
        .drop("_fast", "_slow", "_cum", "_mark", "_last", "_b", "_i")


STATE_FIELDS = {"sx0": "double", "sy0": "double", "speed0": "double", "below0": "bigint", "sprint0": "boolean"}


def kinematics(pos: DataFrame, cfg: Sport, chunk: Column | None = None, seeded: bool = False) -> DataFrame:
    """Per observation: break flags, smoothed position, step, speed, acceleration, sprint state.

    pos: session_id, match_id, entity_id, entity_type, team_id, seq, t_ms, period, x_m, y_m, x_att, y_att,
    is_detected, possession (team in possession in the frame). With ``seeded`` the input also holds one row per
    entity with ``is_state`` true and the fields of ``STATE_FIELDS``: where an earlier run stopped.
    """
    d = pos.filter(F.col("entity_id").isNotNull() & F.col("x_m").isNotNull() & F.col("y_m").isNotNull()
                   & F.col("t_ms").isNotNull())
    if not seeded:
        d = d.withColumns({**{n: F.lit(None).cast(t) for n, t in STATE_FIELDS.items()}, "is_state": F.lit(False)})
    cut = (lambda x, n: x) if chunk is None else materialize
    vmax = F.when(F.col("entity_type") == "ball", cfg.max_speed_ball).otherwise(cfg.max_speed_player)
    d = with_cells(d, cfg)
    d = cut(segment_break(d, ENTITY, ["seq"], cfg.max_gap_ms, vmax, chunk, keep={
        "cell_x": "p_cell_x", "cell_y": "p_cell_y", "team_id": "p_team", "is_detected": "p_detected", "t_ms": "p_t"}),
        "segments")
    d = cut(ema(d, cfg.ema_alpha, ENTITY, "seq", {"x_m": "sx", "y_m": "sy"},
                seeds={"x_m": "sx0", "y_m": "sy0"}, chunk=chunk), "smooth")
    d = cut(ordered.with_lag(d, {"sx": "_sx", "sy": "_sy"}, ENTITY, ["seq"], chunk), "steps")
    dt = F.col("gap_ms") / 1000.0
    valid = ~F.col("segment_start") & ~F.col("is_state")
    d = d.withColumn("dist_m", F.when(valid, F.hypot(F.col("sx") - F.col("_sx"), F.col("sy") - F.col("_sy"))))
    d = d.withColumn("speed_mps", F.when(F.col("is_state"), F.col("speed0")).otherwise(F.col("dist_m") / dt))
    d = cut(ordered.with_lag(d, {"speed_mps": "_v"}, ENTITY, ["seq"], chunk), "speeds")
    d = d.withColumn("accel_mps2", F.when(valid, (F.col("speed_mps") - F.col("_v")) / dt))
    return sprint_entries(d, cfg.sprint_speed, chunk).drop("_sx", "_sy", "_v", *STATE_FIELDS)


def attribute_intervals(obs: DataFrame, periods: DataFrame, cfg: Sport) -> DataFrame:
    """One row per valid player interval, and per gap that is too long.

    An interval counts for the window, cell and team of its *start*, with the possession of its *end* frame; a
    gap counts for the window where it *ends*. ``periods``: match_id, period, offset_ms (a few rows per match).
    """
    p = periods.select(F.col("match_id").alias("_m"), F.col("period").alias("_p"), "offset_ms")
    d = obs.filter((F.col("entity_type") == "player") & ~F.col("is_state")
                   & (~F.col("segment_start") | F.col("gap_too_long")))
    d = d.join(p, (F.col("match_id") == F.col("_m")) & (F.col("period") == F.col("_p")), "left").drop("_m", "_p")
    off = F.coalesce("offset_ms", F.lit(0))
    gap = F.col("gap_too_long")
    start = F.when(gap, F.col("t_ms")).otherwise(F.col("p_t"))
    return d.withColumns({
        "offset_ms": off, "is_gap": gap, "window": geo.game_window(start, F.col("period"), off, cfg.window_ms),
        "team": F.coalesce("p_team", "team_id"),
        "both_detected": F.coalesce("p_detected", F.lit(False)) & F.coalesce("is_detected", F.lit(False))})


# columns that windows and dwell need
INTERVAL = ["session_id", "match_id", "entity_id", "seq", "team", "window", "offset_ms", "is_gap", "gap_ms", "dist_m", "dist_raw_m",
            "speed_mps", "accel_mps2", "sprint_entry", "both_detected", "possession", "p_cell_x", "p_cell_y"]


def player_windows(iv: DataFrame, cfg: Sport, by=("session_id", "match_id")) -> DataFrame:
    """Sums per (entity, window); every measure is a sum, a count or a maximum, so parts can be added up."""
    ok = ~F.col("is_gap")
    dt = F.col("gap_ms")
    s = lambda cond, v: F.sum(F.when(cond, v).otherwise(F.lit(0)))
    speed, acc = F.col("speed_mps"), F.col("accel_mps2")
    known = F.col("possession").isNotNull()
    mine = F.col("possession") == F.col("team")
    return iv.groupBy(*by, "entity_id", "window").agg(
        F.min_by("team", "seq").alias("team_id"), F.min("offset_ms").alias("offset_ms"),
        s(ok, F.col("dist_m")).alias("distance_m"), s(ok, F.col("dist_raw_m")).alias("distance_raw_m"),
        s(ok, dt).alias("active_ms"), s(ok & F.col("both_detected"), dt).alias("detected_ms"),
        s(ok & (speed >= cfg.high_speed), dt).alias("hi_ms"),
        s(ok & (speed >= cfg.sprint_speed), dt).alias("sprint_ms"),
        s(ok & (speed >= cfg.high_speed), F.col("dist_m")).alias("hi_distance_m"),
        F.count_if(ok & F.col("sprint_entry")).alias("sprint_count"),
        F.count_if(ok & (acc >= cfg.accel)).alias("accel_count"),
        F.count_if(ok & (acc <= -cfg.accel)).alias("decel_count"),
        F.coalesce(F.max(F.when(ok, speed)), F.lit(0.0)).alias("max_speed_mps"),
        s(ok & known & mine, dt).alias("in_poss_ms"), s(ok & known & ~mine, dt).alias("out_poss_ms"),
        s(ok & ~known, dt).alias("poss_unknown_ms"), F.count_if(ok).alias("n_intervals"),
        s(~ok, dt).alias("excluded_gap_ms"),
        s(ok & F.col("p_cell_x").isNull(), dt).alias("no_cell_ms"))


WINDOW_SUMS = ["distance_m", "distance_raw_m", "active_ms", "detected_ms", "hi_ms", "sprint_ms", "hi_distance_m",
               "sprint_count", "accel_count", "decel_count", "in_poss_ms", "out_poss_ms", "poss_unknown_ms",
               "n_intervals", "excluded_gap_ms", "no_cell_ms"]


def add_up_player_windows(parts: DataFrame, by=("session_id", "match_id")) -> DataFrame:
    """Whole windows from parts made by different runs; ``part`` orders the runs."""
    return parts.groupBy(*by, "entity_id", "window").agg(
        F.min_by("team_id", "part").alias("team_id"), F.min("offset_ms").alias("offset_ms"),
        *[F.sum(c).alias(c) for c in WINDOW_SUMS], F.max("max_speed_mps").alias("max_speed_mps"),
        F.max("part").alias("part"))


def with_bounds(df: DataFrame, cfg: Sport) -> DataFrame:
    start = geo.window_start("window", "offset_ms", cfg.window_ms)
    return df.withColumns({"window_start_ms": start, "window_end_ms": start + cfg.window_ms}).drop("offset_ms")


def dwell(iv: DataFrame, by=("session_id", "match_id")) -> DataFrame:
    """Time per (entity, window, cell). Sums to active time minus time without a cell."""
    d = iv.filter(~F.col("is_gap") & F.col("p_cell_x").isNotNull())
    return d.groupBy(*by, "entity_id", "window", F.col("p_cell_x").alias("cell_x"), F.col("p_cell_y").alias("cell_y")) \
        .agg(F.min_by("team", "seq").alias("team_id"), F.sum("gap_ms").alias("dwell_ms"))


def team_frames(pos: DataFrame, frames: DataFrame, keepers: DataFrame, cfg: Sport, teams: DataFrame,
                by=("session_id", "match_id"), hooks: Sequence[Hook] = ()) -> DataFrame:
    """Shape per team and frame over the outfield players; null when too few players are known.

    ``teams``: match_id, team_id (two rows per match); ``keepers``: match_id, entity_id. A team without players in
    a frame still gets a row. Each of ``hooks`` adds a sport's own measures.
    """
    fkey = [*by, "seq"]
    p = pos.filter((F.col("entity_type") == "player") & F.col("team_id").isNotNull()
                   & F.col("x_att").isNotNull() & F.col("y_att").isNotNull())
    gk = keepers.select("match_id", "entity_id").distinct().withColumn("is_keeper", F.lit(True))
    p = p.join(gk, ["match_id", "entity_id"], "left") \
        .withColumn("out", F.col("is_keeper").isNull())
    o = F.col("out")
    xy = F.struct(F.col("x_att").alias("x"), F.col("y_att").alias("y"))
    extra = {n: c for h in hooks for n, c in h.gather().items()}
    g = p.groupBy(*fkey, "team_id").agg(
        F.count_if(o).alias("n_outfield"), F.count_if(o & F.coalesce("is_detected", F.lit(False))).alias("n_detected"),
        F.avg(F.when(o, F.col("x_att"))).alias("cx"), F.avg(F.when(o, F.col("y_att"))).alias("cy"),
        (F.max(F.when(o, F.col("y_att"))) - F.min(F.when(o, F.col("y_att")))).alias("w"),
        (F.max(F.when(o, F.col("x_att"))) - F.min(F.when(o, F.col("x_att")))).alias("dp"),
        F.sort_array(F.collect_list(F.when(o, xy))).alias("pts"), *[c.alias(n) for n, c in extra.items()])
    mel = F.col("mel_ms") if "mel_ms" in frames.columns else F.lit(None).cast("bigint").alias("mel_ms")
    base = frames.select(*by, "seq", "t_ms", mel, "period", "possession").join(teams.select("match_id", "team_id"), "match_id")
    d = base.join(g, [*fkey, "team_id"], "left")
    d = d.withColumns({"n_outfield": F.coalesce("n_outfield", F.lit(0)), "n_detected": F.coalesce("n_detected", F.lit(0))})
    ok = F.col("n_outfield") >= cfg.min_outfield
    xs = F.transform("pts", lambda q: q["x"])
    ys = F.transform("pts", lambda q: q["y"])
    line = geo.kth_mean(xs, 4) + cfg.length_m / 2 if cfg.name == "soccer" else F.lit(None).cast("double")
    hull = geo.hull_area(F.when(ok, xs), F.when(ok, ys))
    d = d.withColumns({
        "sufficient": ok, "in_possession": F.col("possession") == F.col("team_id"),
        "centroid_x": F.when(ok, F.col("cx")), "centroid_y": F.when(ok, F.col("cy")),
        "width_m": F.when(ok, F.col("w")), "depth_m": F.when(ok, F.col("dp")),
        "hull_area_m2": hull, "def_line_height_m": F.when(ok, line)})
    for h in hooks:
        d = h.finish(d, pos, fkey)
    return d.drop("cx", "cy", "w", "dp", "pts", "possession", *extra)


@dataclass(frozen=True)
class Hook:
    """Measures of one sport per team and frame.

    ``gather`` names aggregates over the team's players of the frame (columns x_att, y_att, x_m, y_m);
    ``finish(rows, positions, frame key)`` makes the measures from them. The gathered columns are dropped afterwards.
    """
    name: str
    gather: Callable[[], dict[str, Column]]
    finish: Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def _spacing_inputs() -> dict[str, Column]:
    at = lambda x, y: F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return {"all_xy": at("x_att", "y_att"), "all_m": at("x_m", "y_m"), "front_share": F.avg((F.col("x_att") > 0).cast("double")),
            "paint": F.count_if(geo.in_paint("x_att", "y_att")), "corner": F.count_if(geo.in_corner("x_att", "y_att"))}


def _spacing(d: DataFrame, pos: DataFrame, fkey) -> DataFrame:
    """Basketball spacing: offense is the team in possession, else the one with 60 % of players in front."""
    ball = pos.filter((F.col("entity_type") == "ball") & F.col("x_m").isNotNull()).groupBy(*fkey).agg(
        F.min_by(F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y")), "entity_id").alias("ball"))
    d = d.join(ball, fkey, "left")
    enough = F.coalesce(F.size("all_xy") >= 2, F.lit(False))
    offense = F.coalesce(F.col("in_possession"), F.col("front_share") >= 0.6)
    d = d.withColumn("offense", F.when(enough, offense))
    off = F.col("offense")
    xs, ys = F.transform("all_xy", lambda q: q["x"]), F.transform("all_xy", lambda q: q["y"])
    return d.withColumns({
        "mean_pairwise_m": F.when(enough, F.round(geo.mean_pairwise("all_xy"), 3)),
        "spacing_hull_m2": geo.hull_area(F.when(enough, xs), F.when(enough, ys)),
        "paint_count": F.when(off, F.col("paint")), "corner_count": F.when(off, F.col("corner")),
        "nearest_def_to_ball_m": F.when(~off & F.col("ball").isNotNull(),
                                        F.round(geo.nearest("all_m", "ball.x", "ball.y"), 3))}).drop("ball")


SPACING = Hook("spacing", _spacing_inputs, _spacing)
# a sport's hooks, in the order they are applied
HOOKS: dict[str, list[Hook]] = {"soccer": [], "basketball": [SPACING]}


def register_hook(sport: str, hook: Hook) -> None:
    """Add a hook to a sport, new or known; a hook of the same name is replaced."""
    HOOKS[sport] = [h for h in HOOKS.get(sport, []) if h.name != hook.name] + [hook]


SHAPE = ["centroid_x", "width_m", "depth_m", "hull_area_m2", "def_line_height_m"]


def team_windows(tf: DataFrame, periods: DataFrame, cfg: Sport, by=("session_id", "match_id")) -> DataFrame:
    """Frame counts and sums of the shape measures per (team, window); means are taken in ``team_means``."""
    p = periods.select(F.col("match_id").alias("_m"), F.col("period").alias("_p"), "offset_ms")
    d = tf.filter(F.col("t_ms").isNotNull()).join(
        p, (F.col("match_id") == F.col("_m")) & (F.col("period") == F.col("_p")), "left").drop("_m", "_p")
    off = F.coalesce("offset_ms", F.lit(0))
    d = d.withColumns({"offset_ms": off, "window": geo.game_window("t_ms", "period", off, cfg.window_ms)})
    ok = F.col("sufficient")
    return d.groupBy(*by, "team_id", "window").agg(
        F.min("offset_ms").alias("offset_ms"), F.count(F.lit(1)).alias("n_frames"), F.count_if(ok).alias("n_sufficient"),
        F.count_if(F.coalesce("in_possession", F.lit(False))).alias("in_possession_frames"),
        # per-frame values are stored with four digits before they are averaged
        *[F.sum(F.when(ok, F.round(F.col(c), 4))).alias(f"sum_{c}") for c in SHAPE],
        *[F.count(F.when(ok, F.col(c))).alias(f"cnt_{c}") for c in SHAPE])


def add_up_team_windows(parts: DataFrame, by=("session_id", "match_id")) -> DataFrame:
    return parts.groupBy(*by, "team_id", "window").agg(
        F.min("offset_ms").alias("offset_ms"),
        *[F.sum(c).alias(c) for c in ("n_frames", "n_sufficient", "in_possession_frames")],
        *[F.sum(f"{a}_{c}").alias(f"{a}_{c}") for c in SHAPE for a in ("sum", "cnt")], F.max("part").alias("part"))


def team_means(df: DataFrame) -> DataFrame:
    return df.withColumns({f"mean_{c}": F.try_divide(f"sum_{c}", f"cnt_{c}") for c in SHAPE}) \
        .drop(*[f"{a}_{c}" for c in SHAPE for a in ("sum", "cnt")])


def nearest_per_cell(pos: DataFrame, cfg: Sport, cell_m: float, frame=("match_id", "seq"), teams_only: bool = True) -> DataFrame:
    """Team nearest to the centre of every grid cell, one row per frame and cell.

    Each frame is one row with an array of players. The search runs over the cells inside that row, and only its
    results are exploded: no grid join, and no copy of the players per cell.
    """
    nx, ny = -(-cfg.length_m // cell_m), -(-cfg.width_m // cell_m)
    players = pos.filter((F.col("entity_type") == "player") & F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    f = players.groupBy(*frame).agg(
        F.collect_list(F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y"), "team_id", "entity_id")).alias("ents"))
    cells = F.sequence(F.lit(0), F.lit(int(nx * ny) - 1))

    def winner(cell: Column) -> Column:
        cx, cy = F.floor(cell / int(ny)).cast("int"), (cell % int(ny)).cast("int")
        x, y = -cfg.length_m / 2 + (cx + 0.5) * cell_m, -cfg.width_m / 2 + (cy + 0.5) * cell_m
        best = F.array_min(F.transform("ents", lambda e: F.struct(
            ((e["x"] - x) * (e["x"] - x) + (e["y"] - y) * (e["y"] - y)).alias("d2"), e["entity_id"].alias("entity_id"),
            e["team_id"].alias("team_id"))))
        return F.struct(cx.alias("cell_x"), cy.alias("cell_y"), best.alias("best"))

    # the winner is opened after the explode, so that each cell is searched once
    d = f.filter(F.size("ents") > 3).select(*frame, F.explode(F.transform(cells, winner)).alias("w"))
    return d.select(*frame, "w.cell_x", "w.cell_y", "w.best.team_id", "w.best.entity_id")


def run_batch(pos: DataFrame, frames: DataFrame, periods: DataFrame, teams: DataFrame, keepers: DataFrame, cfg: Sport,
              hot_rows: int | None = None) -> dict[str, DataFrame]:
    """All results of one or many matches: obs, player_window, dwell, team_frame, team_window."""
    obs = kinematics(pos, cfg, plan_chunk(pos, hot_rows))
    iv = attribute_intervals(obs, periods, cfg)
    tf = team_frames(pos, frames, keepers, cfg, teams, hooks=HOOKS.get(cfg.name, []))
    return {"obs": obs, "player_window": with_bounds(player_windows(iv, cfg), cfg), "dwell": dwell(iv),
            "team_frame": tf, "team_window": with_bounds(team_means(team_windows(tf, periods, cfg)), cfg)}
