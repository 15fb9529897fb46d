"""Pitch and court geometry: units, cells, windows, regions, distances, hulls."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metres per foot, court size, basket, lane and corner geometry
FOOT = 0.3048
COURT_LENGTH_FT, COURT_WIDTH_FT = 94.0, 50.0
BASKET_FT = 5.25
LANE_DEPTH_FT, LANE_HALF_WIDTH_FT = 19.0, 8.0
CORNER_DEPTH_FT, CORNER_Y_FT = 14.0, 22.0
PITCH_LENGTH_M, PITCH_WIDTH_M = 105.0, 68.0
COURT_LENGTH_M, COURT_WIDTH_M = COURT_LENGTH_FT * FOOT, COURT_WIDTH_FT * FOOT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def feet_to_metres(x, y) -> tuple[Column, Column]:
    """Feet from a corner -> metres from the centre."""
    return (_c(x) - COURT_LENGTH_FT / 2) * FOOT, (_c(y) - COURT_WIDTH_FT / 2) * FOOT


def unit_to_metres(x, y, length=PITCH_LENGTH_M, width=PITCH_WIDTH_M) -> tuple[Column, Column]:
    """0..1 from the top left -> metres from the centre, y upwards."""
    return (_c(x) - 0.5) * length, (F.lit(0.5) - _c(y)) * width


def grid_cell(v, size, n) -> Column:
    """Cell index along one axis, clamped to the edges; truncation toward zero; null in, null out."""
    size, n = (s if isinstance(s, Column) else F.lit(s) for s in (size, n))
    i = ((_c(v) + size / 2) / size * n).cast("int")
    return F.when(_c(v).isNotNull(), F.least(F.greatest(i, F.lit(0)), n.cast("int") - 1))


def game_window(t_ms, period, offset_ms, window_ms) -> Column:
    """period * 10000 + index of the window since the period began."""
    since = F.greatest(_c(t_ms) - _c(offset_ms), F.lit(0))
    w = window_ms if isinstance(window_ms, Column) else F.lit(window_ms)
    return (_c(period).cast("bigint") * 10000 + F.floor(since / w)).cast("bigint")


def window_start(window, offset_ms, window_ms) -> Column:
    w = window_ms if isinstance(window_ms, Column) else F.lit(window_ms)
    return (_c(offset_ms) + (_c(window) % 10000) * w).cast("bigint")


def in_paint(x, y) -> Column:
    return (_c(x) >= COURT_LENGTH_M / 2 - LANE_DEPTH_FT * FOOT) & (F.abs(_c(y)) <= LANE_HALF_WIDTH_FT * FOOT)


def in_corner(x, y) -> Column:
    return (_c(x) >= COURT_LENGTH_M / 2 - CORNER_DEPTH_FT * FOOT) & (F.abs(_c(y)) >= CORNER_Y_FT * FOOT)


def dist(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def kth_mean(points, k: int) -> Column:
    """Mean of the ``k`` smallest values of an array."""
    low = F.slice(F.array_sort(_c(points)), 1, k)
    return F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / F.size(low)


def mean_pairwise(points) -> Column:
    """Mean distance over all pairs of an array<struct<x,y>>, inside the row: no pair rows are made."""
    p = _c(points)
    n = F.size(p)
    total = F.aggregate(p, F.lit(0.0), lambda acc, a: acc + F.aggregate(
        p, F.lit(0.0), lambda s, b: s + F.hypot(a["x"] - b["x"], a["y"] - b["y"])))
    return F.when(n >= 2, total / (n * (n - 1)))


def nearest(points, x, y) -> Column:
    """Smallest distance from (x, y) to an array<struct<x,y>>."""
    px, py = _c(x), _c(y)
    return F.array_min(F.transform(_c(points), lambda a: F.hypot(a["x"] - px, a["y"] - py)))


def _hull_area(xs, ys) -> float:
    """Area of the convex hull by gift wrapping on plain floats (groups are a dozen points); 0 on a line."""
    pts = list(dict.fromkeys(zip(xs, ys)))
    if len(pts) < 3:
        return 0.0
    first = at = min(pts)
    twice, steps = 0.0, 0
    while True:
        ax, ay = at
        bx, by, reach = ax, ay, 0.0
        for px, py in pts:
            dx, dy = px - ax, py - ay
            turn = (bx - ax) * dy - (by - ay) * dx
            # the next corner has no point to its right; of points in line the farthest is taken
            if turn < 0.0 or (turn == 0.0 and dx * dx + dy * dy > reach):
                bx, by, reach = px, py, dx * dx + dy * dy
        twice += (ax - first[0]) * (by - first[1]) - (bx - first[0]) * (ay - first[1])
        at = (bx, by)
        steps += 1
        if at == first or steps > len(pts):
            return abs(twice) / 2.0


@F.pandas_udf(T.DoubleType())
def hull_area(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Convex hull area per row from two arrays; null below three points. Arrow batches."""
    return pd.Series([None if x is None or len(x) < 3 else _hull_area(np.asarray(x).tolist(), np.asarray(y).tolist())
                      for x, y in zip(xs, ys)], dtype="float64")
