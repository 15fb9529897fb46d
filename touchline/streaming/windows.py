"""Keyed state of moving entities: where each stopped, and its open windows and dwell cells, in the state store.

One key is one entity of one match. A batch's positions of the entity arrive in sequence order; the state holds the last
position with its smoothed values and sprint state, and a list of open windows and of their cells. With every batch the reorder
step sends each entity of the match the match's clock, so windows also close for entities that are no longer seen; the last
clock of a match closes everything and clears the state. The measures are those of ``operators.tracking``, which the stream = batch
tests hold against each other.
"""
from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.tracking import WINDOW_SUMS, Sport
from touchline.streaming.validate import ENVELOPE

NEVER = 10 ** 9
FRAME_KEYS = 32                      # frames pass by under as many keys
POSITION = {"seq": "bigint", "t_ms": "bigint", "mel_ms": "bigint", "period": "int", "possession": "string", "entity_id": "string",
            "entity_type": "string", "team_id": "string", "x_m": "double", "y_m": "double", "z_m": "double", "x_att": "double", "y_att": "double",
            "is_detected": "boolean", "position_source": "string"}
UNIT = {"unit": "string", "kind": "string", **POSITION, "payload": "string"}
MEASURES = {"speed_mps": "double", "accel_mps2": "double", "dist_raw_m": "double", "dist_m": "double", "segment_start": "boolean", "gap_ms": "bigint",
            "implausible": "boolean", "cell_x": "int", "cell_y": "int"}
OUT = {"session_id": "string", "match_id": "string", "kind": "string", "released_upto": "bigint", **POSITION, **MEASURES, "payload": "string"}
AT = ("t_ms bigint, period int, x double, y double, cell_x int, cell_y int, team string, detected boolean, sx double, sy double, speed double, "
      "below bigint, sprinting boolean")
OPEN = "window bigint, offset_ms bigint, team_id string, " + ", ".join(f"{c} double" for c in [*WINDOW_SUMS, "max_speed_mps"])
CELLS = "window bigint, cell_x int, cell_y int, team_id string, dwell_ms bigint"
WHOLE = [c for c in WINDOW_SUMS if not c.endswith("_m")]


def _unit(**fields: Column) -> Column:
    return F.struct(*[fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in UNIT.items()])


def units(released: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of ``reorder.released`` as rows per unit: positions and clocks by entity, one row per frame, the rest as it is."""
    d = released.withColumn("e", F.when(F.col("kind") == "frame", F.from_json("payload", ENVELOPE)))
    e = lambda c: F.col(f"e.{c}")
    shared = {"seq": F.col("seq"), "t_ms": e("physical_time_ms"), "mel_ms": e("match_elapsed_ms"), "period": e("period"), "possession": e("possession_team_id")}
    players = F.coalesce(e("players"), F.array().cast(ENTS))
    note = F.to_json(F.struct(
        e("source_frame_id").alias("source_frame_id"), e("source_clock").alias("clock"), F.size(players).alias("n_players"),
        F.size(F.filter(players, lambda x: F.coalesce(x["is_detected"], F.lit(False)))).alias("n_detected"), e("ball").isNotNull().alias("has_ball"),
        F.array_join(e("quality_flags"), ",").alias("flags"), e("attempt").alias("attempt"), e("replay_event_time").alias("replay_event_time"),
        e("produced_at").alias("produced_at")))
    frame = _unit(unit=F.concat(F.lit("f:"), (F.col("seq") % FRAME_KEYS).cast("string")), kind=F.lit("frame"), payload=note, **shared)
    spot = lambda x: _unit(
        unit=F.concat(F.lit("e:"), F.coalesce(x["canonical_player_id"], F.lit(""))), kind=F.lit("position"), entity_id=x["canonical_player_id"],
        **{c: x[c] for c in ("entity_type", "team_id", "x_m", "y_m", "z_m", "x_att", "y_att", "is_detected", "position_source")}, **shared)
    of_frame = F.concat(F.array(frame), F.transform(F.concat(F.array_compact(F.array(e("ball").cast(ENT))), players), spot))
    clock = F.col("kind") == "clock"
    other = _unit(unit=F.when(clock, F.concat(F.lit("e:"), F.get_json_object("payload", "$.unit"))).otherwise(F.lit("x:")), kind=F.col("kind"),
                  seq=F.col("seq"), period=F.get_json_object("payload", "$.period"), payload=F.col("payload"))
    rows = F.when(F.col("kind") == "frame", of_frame).otherwise(F.array(other))
    d = d.select("session_id", "match_id", "released_upto", F.explode(rows).alias("u")).select("session_id", "match_id", "released_upto", "u.*")
    off = periods.select(F.col("match_id").alias("_m"), F.col("period").alias("_p"), "offset_ms")
    d = d.join(off, (F.col("match_id") == F.col("_m")) & (F.col("period") == F.col("_p")), "left").drop("_m", "_p")
    return d.withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0)))


ENT = ("struct<entity_type: string, canonical_player_id: string, team_id: string, x_m: double, y_m: double, z_m: double, "
       "x_att: double, y_att: double, is_detected: boolean, position_source: string>")
ENTS = f"array<{ENT}>"


STRINGS = [c for c, t in OUT.items() if t == "string"]


def _rows(d: pd.DataFrame, **columns) -> pd.DataFrame:
    """``OUT`` rows; text as objects, which turn into one Arrow array however the parts were put together."""
    d = d.assign(**columns).reindex(columns=list(OUT))
    return d.assign(**{c: d[c].astype(object).where(d[c].notna(), None) for c in STRINGS})


def _cell(v: np.ndarray, size: float, n: int) -> np.ndarray:
    """Cell along one axis, clamped; NaN where unknown."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(v), np.nan, np.clip(np.trunc((v + size / 2) / size * n), 0, n - 1))


def _lagged(first, values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.array([first], dtype=values.dtype), values[:-1]])


class EntityWindows(StatefulProcessor):
    def __init__(self, cfg: Sport):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", AT)
        self.open = handle.getListState("open", OPEN)
        self.cells = handle.getListState("cells", CELLS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not key[2].startswith("e:"):
            for d in rows:
                yield _rows(d)
            return
        d = pd.concat(list(rows), ignore_index=True)
        clock = d[d["kind"] == "clock"]
        spots = d[d["kind"] == "position"].sort_values("seq", kind="stable", ignore_index=True)
        usable = spots["entity_id"].notna() & spots["x_m"].notna() & spots["y_m"].notna() & spots["t_ms"].notna()
        if not usable.all():
            yield _rows(spots[~usable], kind="unusable")
            spots = spots[usable].reset_index(drop=True)
        windows = {w[0]: list(w) for w in self.open.get()} if self.open.exists() else {}
        cells = {(c[0], c[1], c[2]): list(c) for c in self.cells.get()} if self.cells.exists() else {}
        touched: set = set()
        if len(spots):
            obs = self._move(spots)
            if spots["entity_type"].iloc[0] == "player":
                touched = self._add(obs, windows, cells)
            yield _rows(obs, kind="position")
        if len(clock):
            last = clock.loc[clock["seq"].idxmax()]
            note = json.loads(last["payload"])
            out = self._out(key, spots, windows, cells, touched, note, int(last["released_upto"]))
            if len(out):
                yield out
            if note["ended"]:
                for state in (self.at, self.open, self.cells):
                    state.clear()
                return
        for state, held in ((self.open, windows), (self.cells, cells)):
            if held:
                state.put([tuple(x) for x in held.values()])
            else:
                state.clear()

    def _move(self, d: pd.DataFrame) -> pd.DataFrame:
        """Breaks, smoothing, speed, acceleration and sprints of one entity's rows, from where the state stopped."""
        cfg, num = self.cfg, lambda c: d[c].to_numpy(dtype=float, na_value=np.nan)
        old = self.at.get() if self.at.exists() else None
        nan = float("nan")
        o_t, o_p, o_x, o_y, o_cx, o_cy, o_team, o_det, o_sx, o_sy, o_v, below, sprinting = [
            nan if v is None and i not in (6, 7) else v for i, v in enumerate(old)] if old else [nan] * 6 + [None, None] + [nan] * 3 + [0, False]
        t, p, x, y = num("t_ms"), num("period"), num("x_m"), num("y_m")
        xa, ya = num("x_att"), num("y_att")
        both = ~(np.isnan(xa) | np.isnan(ya))
        cx, cy = (np.where(both, _cell(v, s, n), np.nan) for v, s, n in ((xa, cfg.length_m, cfg.grid_nx), (ya, cfg.width_m, cfg.grid_ny)))
        player = d["entity_type"].iloc[0] == "player"
        vmax = cfg.max_speed_ball if d["entity_type"].iloc[0] == "ball" else cfg.max_speed_player
        with np.errstate(invalid="ignore", divide="ignore"):
            dt = t - _lagged(o_t, t)
            step = np.hypot(x - _lagged(o_x, x), y - _lagged(o_y, y))
            same = _lagged(o_p, p) == p
            near = same & (dt > 0) & (dt <= cfg.max_gap_ms)
            far = near & (step / (dt / 1000.0) > vmax)
        valid, n = near & ~far, len(d)
        sx, sy, speed, dist, entry = np.empty(n), np.empty(n), np.full(n, nan), np.full(n, nan), np.zeros(n, bool)
        a, b, v = o_sx, o_sy, o_v
        accel, keep = np.full(n, nan), 1.0 - cfg.ema_alpha
        xs, ys, ds, ok = x.tolist(), y.tolist(), dt.tolist(), valid.tolist()
        for i in range(n):
            if ok[i]:
                na, nb = cfg.ema_alpha * xs[i] + keep * a, cfg.ema_alpha * ys[i] + keep * b
                dist[i] = math.hypot(na - a, nb - b)
                s = dist[i] / (ds[i] / 1000.0)
                accel[i] = (s - v) / (ds[i] / 1000.0)
                speed[i], v, a, b = s, s, na, nb
                if player:
                    fast = s >= cfg.sprint_speed
                    entry[i] = fast and not sprinting and below >= 1000
                    below = 0 if fast else below + int(ds[i])
                    sprinting = fast
            else:
                a, b, v = xs[i], ys[i], nan
                if ds[i] != ds[i]:
                    below += NEVER
            sx[i], sy[i] = a, b
        team = d["team_id"].where(d["team_id"].notna(), None).to_numpy(dtype=object)
        det = d["is_detected"].where(d["is_detected"].notna(), None).to_numpy(dtype=object)
        none = lambda z: None if z != z else z
        last = (int(t[-1]), None if p[-1] != p[-1] else int(p[-1]), x[-1], y[-1], none(cx[-1]), none(cy[-1]), team[-1], None if det[-1] is None else bool(det[-1]),
                sx[-1], sy[-1], none(speed[-1]), int(below), bool(sprinting))
        self.at.update(tuple(int(z) if i in (4, 5) and z is not None else z for i, z in enumerate(last)))
        return d.assign(
            speed_mps=speed, accel_mps2=accel, dist_m=dist, dist_raw_m=np.where(valid, step, np.nan), segment_start=~valid, gap_ms=dt, implausible=far,
            cell_x=cx, cell_y=cy, _gap=same & (dt > cfg.max_gap_ms), _pt=_lagged(o_t, t), _pcx=_lagged(o_cx, cx), _pcy=_lagged(o_cy, cy),
            _team=[a if a is not None else b for a, b in zip([o_team, *team[:-1]], team)], _det=[bool(a) and bool(b) for a, b in zip([o_det, *det[:-1]], det)],
            _entry=entry)

    def _add(self, d: pd.DataFrame, windows: dict, cells: dict) -> set:
        """Add valid intervals and long gaps to the open windows; returns the windows they fell into."""
        cfg = self.cfg
        d = d[~d["segment_start"].to_numpy() | d["_gap"].to_numpy()]
        d = d[d["period"].notna()]
        if not len(d):
            return set()
        gap, dt = d["_gap"].to_numpy(), d["gap_ms"].to_numpy()
        off = d["offset_ms"].to_numpy(dtype=float)
        start = np.where(gap, d["t_ms"].to_numpy(dtype=float), d["_pt"].to_numpy())
        at = (d["period"].to_numpy(dtype=float) * 10000 + np.floor(np.maximum(start - off, 0) / cfg.window_ms)).astype(np.int64)
        speed, accel, dist = d["speed_mps"].to_numpy(), d["accel_mps2"].to_numpy(), d["dist_m"].to_numpy()
        known = d["possession"].notna().to_numpy()
        team = d["_team"].to_numpy(dtype=object)
        has = np.array([x is not None for x in team])
        mine = known & has & (d["possession"].to_numpy(dtype=object) == team)
        pcx, pcy = d["_pcx"].to_numpy(), d["_pcy"].to_numpy()
        with np.errstate(invalid="ignore"):
            high, sprint = speed >= cfg.high_speed, speed >= cfg.sprint_speed
            up, down = accel >= cfg.accel, accel <= -cfg.accel
        parts = {"distance_m": (~gap, dist), "distance_raw_m": (~gap, d["dist_raw_m"].to_numpy()), "active_ms": (~gap, dt),
                 "detected_ms": (~gap & d["_det"].to_numpy(), dt), "hi_ms": (~gap & high, dt), "sprint_ms": (~gap & sprint, dt),
                 "hi_distance_m": (~gap & high, dist), "sprint_count": (~gap & d["_entry"].to_numpy(), None), "accel_count": (~gap & up, None),
                 "decel_count": (~gap & down, None), "in_poss_ms": (~gap & mine, dt), "out_poss_ms": (~gap & known & has & ~mine, dt),
                 "poss_unknown_ms": (~gap & ~known, dt), "n_intervals": (~gap, None), "excluded_gap_ms": (gap, dt), "no_cell_ms": (~gap & np.isnan(pcx), dt)}
        for w in np.unique(at):
            here = at == w
            sums = {c: float(v[m & here].sum()) if v is not None else float((m & here).sum()) for c, (m, v) in parts.items()}
            top = float(np.nanmax(np.where(here & ~gap, speed, 0.0), initial=0.0))
            if w in windows:
                row = windows[w]
                row[1] = min(row[1], int(off[here].min()))
                row[3:-1] = [a + sums[c] for a, c in zip(row[3:-1], WINDOW_SUMS)]
                row[-1] = max(row[-1], top)
            else:
                windows[int(w)] = [int(w), int(off[here].min()), team[here][0], *[sums[c] for c in WINDOW_SUMS], top]
        stay = ~gap & ~np.isnan(pcx)
        for w, x, y, g, q in zip(at[stay].tolist(), pcx[stay].tolist(), pcy[stay].tolist(), dt[stay].tolist(), team[stay]):
            key = (w, int(x), int(y))
            if key in cells:
                cells[key][4] += int(g)
            else:
                cells[key] = [*key, q, int(g)]
        return set(np.unique(at).tolist())

    def _out(self, key, spots: pd.DataFrame, windows: dict, cells: dict, touched: set, note: dict, upto: int) -> pd.DataFrame:
        """Closed windows once as final, open ones that changed as partial; closed ones leave the state."""
        cfg, rows = self.cfg, []
        entity = key[2][2:]

        def closed(w: int, offset: int) -> bool:
            end = offset + (w % 10000 + 1) * cfg.window_ms
            return bool(note["ended"] or (note["period"] is not None and w // 10000 != note["period"]) or (note["t"] is not None and end + cfg.max_gap_ms < note["t"]))

        def row(kind: str, values: dict, final: bool) -> None:
            values |= {"entity_id": entity, "is_final": final, "version": 2 * upto + final}
            rows.append((key[0], key[1], kind, json.dumps(values)))

        for w, r in list(windows.items()):
            final = closed(w, r[1])
            if final or w in touched:
                start = r[1] + (w % 10000) * cfg.window_ms
                values = dict(zip([*WINDOW_SUMS, "max_speed_mps"], r[3:]))
                row("window", {"window": w, "window_start_ms": start, "window_end_ms": start + cfg.window_ms, "team_id": r[2],
                               **{c: int(v) if c in WHOLE else v for c, v in values.items()}}, final)
            for c in [c for c in cells if c[0] == w]:
                if final or w in touched:
                    row("dwell", {"window": w, "cell_x": c[1], "cell_y": c[2], "team_id": cells[c][3], "dwell_ms": cells[c][4]}, final)
                if final:
                    del cells[c]
            if final:
                del windows[w]
        return _rows(pd.DataFrame(rows, columns=["session_id", "match_id", "kind", "payload"]))


def entity_rows(released: DataFrame, periods: DataFrame, cfg: Sport) -> DataFrame:
    """Stream of ``OUT`` rows: position (measured), unusable, frame, window, dwell, and what the reorder step reports."""
    return units(released, periods).groupBy("session_id", "match_id", "unit").transformWithStateInPandas(
        statefulProcessor=EntityWindows(cfg), outputStructType=", ".join(f"{c} {t}" for c, t in OUT.items()), outputMode="Append", timeMode="None")
