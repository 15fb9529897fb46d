"""Equi, interval, nearest-in-time and as-of joins.

As-of and nearest joins are written as *union + carry along the order* instead of a range join: no pair
rows are made, and where one key holds many rows the carry is chunked (see ``ordered``) and spread over many tasks.
Join strategy for plain joins is left to Spark, which broadcasts only what its size estimate allows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import ordered


def merge_advanced(base: DataFrame, adv: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Left join after keeping one right row per key."""
    return base.join(ordered.first_by(adv, keys, order), list(keys), "left")


def join_by_normalized(df: DataFrame, right: DataFrame, pairs: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Left join on computed keys: ``pairs`` maps a right key column to the left key expression."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in pairs], *keep)
    cond = None
    for k, expr in pairs.items():
        c = expr == F.col(f"_r_{k}")
        cond = c if cond is None else cond & c
    return df.join(r, cond, "left").drop(*[f"_r_{k}" for k in pairs])


def expand_validity(periods: DataFrame, start: str, end: str, out: str, lo: int, hi: int) -> DataFrame:
    """One row per whole step of ``start..end`` inside ``lo..hi``: turns an interval join into an equi join."""
    a, b = F.greatest(F.col(start), F.lit(lo)), F.least(F.col(end), F.lit(hi))
    return periods.filter(a <= b).withColumn(out, F.explode(F.sequence(a.cast("int"), b.cast("int"))))


def _side(left: DataFrame, right: DataFrame, by, left_on, right_on, cols, tie):
    """Left and right rows in one frame; right rows are reduced to one per (key, time) first."""
    r = right.select(*by, F.col(right_on).alias("_t"), *cols, *( [tie] if tie and tie not in cols else []))
    r = r.filter(F.col("_t").isNotNull())
    order = [tie] if tie else list(cols)
    r = ordered.first_by(r, [*by, "_t"], order) if order else r.distinct()
    val = F.struct(F.col("_t").alias("t"), *([F.col(tie).alias("ord")] if tie else []), *[F.col(c) for c in cols])
    rows_r = r.select(*by, "_t", F.lit(0).alias("_side"), val.alias("_val"))
    row = F.struct(*[F.col(c) for c in left.columns])
    rows_l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    return rows_l.unionByName(rows_r, allowMissingColumns=True)


def _chunk_of(left, right, by, width, hot_rows) -> Column | None:
    """Time chunks when one key holds many rows on either side, else one plain window."""
    both = left.select(*by).unionAll(right.select(*by))
    return ordered.split_if_hot(both, by, F.floor(F.col("_t") / F.lit(width)), hot_rows)


def _back_to_left(both: DataFrame, left: DataFrame, extra: Sequence[str]) -> DataFrame:
    return both.filter(F.col("_side") == 1).select(*[F.col(f"_row.{c}").alias(c) for c in left.columns], *extra)


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
                  cols: Sequence[str], tie: str | None = None, width: float = 3_600_000, hot_rows: int | None = None) -> DataFrame:
    """Latest right row at or before each left row; ``matched`` is its struct (null when there is none)."""
    both = _side(left, right, by, left_on, right_on, cols, tie)
    both = ordered.carry_forward(both, "_val", "matched", by, ["_t", "_side"], _chunk_of(left, right, by, width, hot_rows))
    return _back_to_left(both, left, ["matched"])


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
                 cols: Sequence[str], tie: str | None = None, width: float = 3_600_000, hot_rows: int | None = None) -> DataFrame:
    """Earliest right row at or after each left row."""
    both = _side(left, right, by, left_on, right_on, cols, tie).withColumn("_o", -F.col("_side"))
    both = ordered.carry_backward(both, "_val", "matched", by, ["_t", "_o"], _chunk_of(left, right, by, width, hot_rows))
    return _back_to_left(both, left, ["matched"])


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
                 cols: Sequence[str], tol: float, tie: str, width: float = 3_600_000,
                 hot_rows: int | None = None) -> DataFrame:
    """Right row with the smallest time distance, at most ``tol`` away; ties go to the smaller ``tie``."""
    both = _side(left, right, by, left_on, right_on, cols, tie)
    chunk = _chunk_of(left, right, by, width, hot_rows)
    both = ordered.carry_forward(both, "_val", "_before", by, ["_t", "_side"], chunk)
    both = both.withColumn("_o", -F.col("_side"))
    both = ordered.carry_backward(both, "_val", "_after", by, ["_t", "_o"], chunk)
    db, da = F.abs(F.col("_t") - F.col("_before.t")), F.abs(F.col("_after.t") - F.col("_t"))
    use_before = F.col("_after").isNull() | (db < da) | ((db == da) & (F.col("_before.ord") <= F.col("_after.ord")))
    best = F.when(F.col("_before").isNotNull() & use_before, F.col("_before")).otherwise(F.col("_after"))
    both = both.withColumn("matched", best).withColumn("distance", F.abs(F.col("_t") - F.col("matched.t")))
    hit = F.coalesce(F.col("distance") <= tol, F.lit(False))
    both = both.withColumns({"matched": F.when(hit, F.col("matched")), "distance": F.when(hit, F.col("distance"))})
    return _back_to_left(both, left, ["matched", "distance"])


def place_on_frames(events: DataFrame, frames: DataFrame, by: Sequence[str], event_clock: str, frame_clock: str,
                    frame_time: str, tracked_within: int = 2000, width: float = 3_600_000,
                    hot_rows: int | None = None) -> DataFrame:
    """Time of the first frame whose game clock has reached the event's, else the last frame of the group.

    Events whose group has no frames are dropped. ``tracked``: the frame is at most ``tracked_within`` of
    game clock after the event.
    """
    f = frames.filter(F.col(frame_clock).isNotNull()).select(*by, frame_clock, frame_time)
    chunk = ordered.split_if_hot(f, by, ordered.by_number(frame_time, int(width)), hot_rows)
    recs = monotonic_only(f, frame_clock, by, [frame_time], chunk)
    last = f.groupBy(*by).agg(F.max(frame_time).alias("_last_t"))
    placed = asof_forward(events, recs, by, event_clock, frame_clock, [frame_time], width=width, hot_rows=hot_rows)
    placed = placed.join(last, list(by))
    gap = F.col("matched.t") - F.col(event_clock)
    return placed.withColumns({
        "t_ms": F.coalesce(F.col(f"matched.{frame_time}"), F.col("_last_t")).cast("bigint"),
        "tracked": F.coalesce((gap >= 0) & (gap <= tracked_within), F.lit(False))}).drop("matched", "_last_t")


def monotonic_only(df: DataFrame, col: str, by: Sequence[str], order: Sequence, chunk: Column | None = None) -> DataFrame:
    """Rows above everything before them (frames that do not go back)."""
    d = ordered.running_max(df, col, "_before_max", by, order, chunk, include_current=False)
    return d.filter(F.col("_before_max").isNull() | (F.col(col) > F.col("_before_max"))).drop("_before_max")


def attack_normalize(pos: DataFrame, direction: DataFrame, team: str = "team_id", ball_team: str = "possession_team_id",
                     by: Sequence[str] = ("match_id", "period")) -> DataFrame:
    """x_att, y_att: turned so the team attacks toward +x; the ball uses the team in possession; unknown is null."""
    d = direction.select(*[F.col(b).alias(f"_d_{b}") for b in by], F.col("team_id").alias("_d_team"), "sign")
    ref = F.when(F.col("entity_type") == "ball", F.col(ball_team)).otherwise(F.col(team))
    cond = ref == F.col("_d_team")
    for b in by:
        cond = cond & (F.col(b) == F.col(f"_d_{b}"))
    out = pos.join(d, cond, "left")
    return out.withColumns({"x_att": F.col("x_m") * F.col("sign"), "y_att": F.col("y_m") * F.col("sign")}) \
        .drop("_d_team", "sign", *[f"_d_{b}" for b in by])


def new_only(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return df.join(index.select(key), key, "left_anti")


def pair_key(a, b) -> Column:
    """The same key for (home, away) and (away, home)."""
    return F.array_sort(F.array(a, b))


def pair_key_join(left: DataFrame, right: DataFrame, la: str, lb: str, ra: str, rb: str, how: str = "inner") -> DataFrame:
    l = left.withColumn("_pair", pair_key(F.col(la), F.col(lb)))
    r = right.withColumn("_pair", pair_key(F.col(ra), F.col(rb)))
    return l.join(r, "_pair", how).drop("_pair")


def parity(batch: DataFrame, stream: DataFrame, keys: Sequence[str], metrics: Sequence[str],
           rtol: float = 1e-4, atol: float = 1e-3) -> DataFrame:
    """One row: rows on each side, rows on one side only, mismatches per metric (null equals null)."""
    b = batch.select(*keys, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics], F.lit(1).alias("_b"))
    s = stream.select(*keys, *[F.col(m).cast("double").alias(f"s_{m}") for m in metrics], F.lit(1).alias("_s"))
    j = b.join(s, list(keys), "full_outer")
    both = F.col("_b").isNotNull() & F.col("_s").isNotNull()

    def differs(m):
        x, y = F.col(f"b_{m}"), F.col(f"s_{m}")
        close = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
        return both & ~F.coalesce(close, x.isNull() & y.isNull())

    return j.agg(F.count("_b").alias("batch_rows"), F.count("_s").alias("stream_rows"),
                 F.count_if(F.col("_s").isNull()).alias("only_batch"),
                 F.count_if(F.col("_b").isNull()).alias("only_stream"),
                 *[F.count_if(differs(m)).alias(f"diff_{m}") for m in metrics])


def hit_match(notes: DataFrame, presses: DataFrame, perfect_ms: int = 120, good_ms: int = 200,
              hot_rows: int | None = None) -> DataFrame:
    """First press per note in the same play and lane within the good window; unmatched notes are misses.

    notes: song_id, note_id, lane, time_ms. presses: play_id, song_id, lane, time_ms. One press may hit
    several notes and a note takes the earliest press, so this is a forward as-of join from the moment the
    note can first be hit.
    """
    plays = presses.select("play_id", "song_id").distinct()
    chart = notes.join(plays, "song_id").withColumn("opens_ms", F.col("time_ms") - good_ms)
    hit = asof_forward(chart, presses.withColumn("press_ms", F.col("time_ms")), ["play_id", "lane"], "opens_ms",
                       "time_ms", ["press_ms"], width=60_000, hot_rows=hot_rows)
    off = F.abs(F.col("matched.press_ms") - F.col("time_ms"))
    quality = F.when(off <= perfect_ms, "PERFECT").when(off <= good_ms, "GOOD").otherwise("MISS")
    return hit.withColumns({"press_ms": F.when(off <= good_ms, F.col("matched.press_ms")),
                            "quality": quality}).drop("matched", "opens_ms")
