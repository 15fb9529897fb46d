"""Per-match reorder buffer: releases frames in sequence order, once each.

A batch is judged as a whole: its rows are compared, as columns, with where the match stands and with one another, and
each gets one verdict. Before the rows meet in the task of their match, each input task packs those of a match into a few
rows of sorted numbers and joined texts. The match's task keeps numbers and texts in scratch files, sorted in runs as a sort's
rows are, and reads them back in sequence order, piece by piece: memory holds one piece, however long the batch is.
The state of a match is small: the newest and the last released sequence, the frames that still wait, what was released (packed
differences, of which only the packs that late rows fall into are read), and the ids of its entities, each of which is told the
match's clock when it moves. Everything computed *from* frames is spread by entity afterwards, so one busy match is not one busy task.
"""
from __future__ import annotations

import json
import os
import struct
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, match_id string, kind string, seq bigint, released_upto bigint, payload string"
COLUMNS = ["session_id", "match_id", "kind", "seq", "released_upto", "payload"]
KEEP_AFTER_END_MS = 600_000
# fixed values: verdicts on rows that come too late, and the counters they are added to
LATE = {"after_end_of_stream": "after_end", "late_correction": "late_correction", "late_beyond_reorder_buffer": "late_beyond_reorder_buffer"}
DUPLICATE, CORRECTION, NEW = "duplicate", "corrections_applied", "new"
VERDICTS = [*LATE, DUPLICATE, CORRECTION, NEW]
ROWS_AT_ONCE = 10_000       # rows of an answer
RUN = 100_000               # rows that are sorted in memory
STEP = 1024                 # of a sorted run, the order of each so manieth row is kept in memory
PACK = 16_384               # released sequences of one state entry
PACKED_BYTES = 1 << 20      # texts of one packed row, unless a single text is longer
PACKED = "session_id string, match_id string, numbers binary, texts binary, rosters string"
ORDER = ["sequence", "attempt", "kafka_offset"]
# a message in numbers; without a time or a period, has_t or has_period is false. size: bytes of its text
NUMBERS = np.dtype([("sequence", "<i8"), ("attempt", "<i4"), ("kafka_offset", "<i8"), ("t", "<i8"), ("has_t", "?"), ("period", "<i4"),
                    ("has_period", "?"), ("eos", "?"), ("correction", "?"), ("roster", "<i4"), ("size", "<i4")])
ROW = np.dtype([*NUMBERS.descr, ("text", "<i8")])


class Texts:
    """The texts of a batch in a scratch file, their places in another."""

    def __init__(self):
        self.file, self.ends, self.count, self.end = tempfile.TemporaryFile(), tempfile.TemporaryFile(), 0, 0
        self.ends.write(struct.pack("<q", 0))

    def add(self, texts) -> None:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.add_bytes(b"".join(data), np.array([len(d) for d in data], np.int64))

    def add_bytes(self, data: bytes, sizes: np.ndarray) -> None:
        self.file.write(data)
        self.ends.write((self.end + np.cumsum(sizes, dtype=np.int64)).astype("<i8").tobytes())
        self.count, self.end = self.count + len(sizes), self.end + int(sizes.sum(dtype=np.int64))

    def get(self, rows: np.ndarray) -> list[str]:
        self.file.flush(), self.ends.flush()
        file, ends, out = self.file.fileno(), self.ends.fileno(), []
        for r in rows.tolist():
            a, b = struct.unpack("<qq", os.pread(ends, 16, 8 * r))
            out.append(os.pread(file, b - a, a).decode("utf-8", "surrogatepass"))
        return out


def ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort([rows[c] for c in reversed(ORDER)])]


def before(rows: np.ndarray, key: tuple) -> int:
    """How many of the ordered rows come before a key of ``ORDER``."""
    lo, hi = 0, len(rows)
    for name, value in zip(ORDER, key):
        some = rows[name][lo:hi]
        lo, hi = lo + int(np.searchsorted(some, value, "left")), lo + int(np.searchsorted(some, value, "right"))
    return lo


class Batch:
    """The messages of a match in one batch: numbers in a scratch file, as sorted runs, and texts in another."""

    def __init__(self, run: int = RUN, step: int = STEP):
        self.run, self.step, self.file, self.texts = run, step, tempfile.TemporaryFile(), Texts()
        self.rosters, self.fresh, self.n_fresh, self.runs, self.n = {}, [], 0, [], 0
        self.over, self.top = False, -1

    def add(self, numbers: bytes, texts: bytes, rosters: str) -> None:
        rows = np.frombuffer(numbers, NUMBERS)
        new = np.empty(len(rows), ROW)
        for name in NUMBERS.names:
            new[name] = rows[name]
        new["text"] = self.texts.count + np.arange(len(rows))
        new["roster"] = np.array([self.rosters.setdefault(r, len(self.rosters)) for r in json.loads(rosters)], np.int32)[rows["roster"]]
        self.texts.add_bytes(texts, rows["size"])
        self.over |= bool(new["eos"].any())
        new = new[~new["eos"]]
        if len(new):
            self.top = max(self.top, int(new["sequence"].max()))
            self.fresh.append(new)
            self.n_fresh += len(new)
        if self.n_fresh >= self.run:
            self._write()

    def _write(self) -> None:
        if self.fresh:
            rows = ordered(np.concatenate(self.fresh))
            self.file.write(rows.tobytes())
            self.runs.append((self.n, len(rows), rows[ORDER][::self.step].copy()))
            self.n, self.fresh, self.n_fresh = self.n + len(rows), [], 0

    def _read(self, begin: int, end: int) -> np.ndarray:
        size = ROW.itemsize
        return np.frombuffer(os.pread(self.file.fileno(), (end - begin) * size, begin * size), ROW)

    def pieces(self) -> Iterator[np.ndarray]:
        """The frames in order, in pieces of about one run's rows. Only rows that are equal in ``ORDER`` are never parted."""
        self._write()
        self.file.flush()
        if not self.runs:
            return
        marks = ordered(np.concatenate([m for _, _, m in self.runs]))
        bounds = [tuple(m) for m in marks[::max(1, self.run // self.step)][1:].tolist()] + [None]
        at = [0] * len(self.runs)
        for bound in bounds:
            parts = []
            for i, (begin, n, kept) in enumerate(self.runs):
                end = n
                if bound is not None:
                    end = max(at[i], min(n, before(kept, bound) * self.step))
                some = self._read(begin + at[i], begin + end)
                if bound is not None:
                    some = some[:before(some, bound)]
                at[i] += len(some)
                parts.append(some)
            rows = np.concatenate(parts)
            if len(rows):
                yield ordered(rows)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of ``released`` -> few rows of ``PACKED``: those of one match, sorted, as an array of ``NUMBERS`` and their joined texts."""
    whole = lambda c, t: pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(t)
    for b in batches:
        if not b.num_rows:
            continue
        c = {name: b.column(name) for name in b.schema.names}
        codes = {k: c[k].dictionary_encode("encode") for k in ("session_id", "match_id", "roster")}
        rows = np.zeros(b.num_rows, NUMBERS)
        for name in ("sequence", "attempt", "kafka_offset", "t", "period"):
            rows[name] = whole(c[name], NUMBERS[name])
        for name in ("eos", "correction"):
            rows[name] = pc.fill_null(c[name], False).to_numpy(zero_copy_only=False)
        for name in ("t", "period"):
            rows[f"has_{name}"] = c[name].is_valid().to_numpy(zero_copy_only=False)
        rows["roster"] = codes["roster"].indices.to_numpy()
        session, match = (codes[k].indices.to_numpy().astype(np.int64) for k in ("session_id", "match_id"))
        texts = pc.fill_null(c["value"], "").cast(pa.large_binary())
        rows["size"] = pc.binary_length(texts).to_numpy()
        order = np.lexsort([*(rows[x] for x in reversed(ORDER)), match, session])
        total = np.cumsum(rows["size"][order], dtype=np.int64) // PACKED_BYTES
        cut = np.flatnonzero((np.diff(session[order]) != 0) | (np.diff(match[order]) != 0) | (np.diff(total) != 0)) + 1
        out = []
        for some in np.split(order, cut):
            used, local = np.unique(rows["roster"][some], return_inverse=True)
            mine = rows[some]
            mine["roster"] = local
            joined = b"".join(texts.take(pa.array(some)).to_pylist())
            out.append((c["session_id"][int(some[0])].as_py(), c["match_id"][int(some[0])].as_py(), mine.tobytes(), joined,
                        json.dumps([codes["roster"].dictionary[int(i)].as_py() for i in used])))
        kinds = [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in PACKED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)


def verdicts(rows: np.ndarray, last: int, waiting: set[int], upto: int, released, ended: bool) -> np.ndarray:
    """One verdict, its place in ``VERDICTS``, per frame of a piece that is in order; ``last`` is the sequence that the piece before ended with.

    ``released`` tells of ascending sequences which went out.
    """
    seq, fix = rows["sequence"], rows["correction"]
    no = lambda name: np.int8(VERDICTS.index(name))
    if ended:
        return np.full(len(rows), no("after_end_of_stream"))
    again = np.isin(seq, sorted(waiting)) | (seq == np.r_[last, seq[:-1]])
    n = int(np.searchsorted(seq, upto, "right"))
    out = np.where(~again, no(NEW), np.where(fix, no(CORRECTION), no(DUPLICATE)))
    if n:
        out[:n] = np.where(fix[:n], no("late_correction"), np.where(released(seq[:n]), no(DUPLICATE), no("late_beyond_reorder_buffer")))
    return out


class Reorder(StatefulProcessor):
    """Holds the frames of a (session, match) that came ahead of ones still expected."""

    def __init__(self, depth: int, idle_ms: int, run: int = RUN, step: int = STEP, pack: int = PACK):
        self.depth, self.idle_ms, self.run, self.step, self.pack = depth, idle_ms, run, step, pack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.where = handle.getValueState("where", "newest bigint, first bigint, upto bigint, ended boolean, counts string, t bigint, period int")
        self.roster = handle.getValueState("roster", "ids string")
        self.waiting = handle.getMapState("waiting", "seq bigint", "value string, attempt int, t bigint, period int")
        self.packs = handle.getValueState("packs", "firsts string")
        self.released = handle.getMapState("released", "first bigint", "steps binary")

    def _restore(self) -> None:
        newest, first, upto, ended, counts, t, period = self.where.get() if self.where.exists() else (-1, None, -1, False, "{}", None, None)
        self.newest, self.first, self.upto, self.ended, self.counts = newest, first, upto, ended, Counter(json.loads(counts))
        self.t, self.period = t, period
        # what waits is read once, and only what still waits at the end is written
        self.stored = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        self.held = dict(self.stored)
        self.firsts = json.loads(self.packs.get()[0]) if self.packs.exists() else []
        self.open = None

    def _keep(self, now: int) -> None:
        for s in self.stored.keys() - self.held.keys():
            self.waiting.removeKey((s,))
        for s, v in self.held.items():
            if self.stored.get(s) != v:
                self.waiting.updateValue((s,), v)
        if self.open is not None:
            self.packs.update((json.dumps(self.firsts),))
        self.where.update((self.newest, self.first, self.upto, self.ended, json.dumps(self.counts), self.t, self.period))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + (KEEP_AFTER_END_MS if self.ended else self.idle_ms))

    def _of_pack(self, first: int) -> np.ndarray:
        return np.cumsum(np.frombuffer(zlib.decompress(bytes(self.released.getValue((first,))[0])), "<i8"))

    def _went_out(self, seq: np.ndarray) -> np.ndarray:
        """Which of these ascending sequences were released; reads the packs that they fall into."""
        out = np.zeros(seq.size, bool)
        pack = np.searchsorted(np.array(self.firsts, np.int64), seq, "right") - 1
        for p in np.unique(pack[pack >= 0]).tolist():
            a, b = np.searchsorted(pack, [p, p + 1])
            out[a:b] = np.isin(seq[a:b], self._of_pack(self.firsts[p]))
        return out

    def _note(self, due: np.ndarray) -> None:
        """Adds released sequences, all after those so far; the last pack is filled first."""
        if self.open is None:
            self.open = self._of_pack(self.firsts[-1]) if self.firsts else due[:0]
        every = np.r_[self.open, due] if self.open.size < self.pack else due
        for i in range(0, every.size, self.pack):
            self.open = every[i:i + self.pack]
            first = int(self.open[0])
            if not self.firsts or self.firsts[-1] != first:
                self.firsts.append(first)
            self.released.updateValue((first,), (zlib.compress(np.diff(self.open, prepend=0).astype("<i8").tobytes(), 1),))

    def _release(self, due: np.ndarray, t: list, period: list) -> None:
        """Frames of these ascending sequences go out; what they skip is counted. The last known clock is kept."""
        if not due.size:
            return
        before = np.r_[self.upto if self.first is not None else due[0] - 1, due[:-1]]
        skipped = due - before - 1
        if (gaps := int((skipped > 0).sum())):
            self.counts["sequence_gaps"] += gaps
            self.counts["missing_frames"] += int(skipped.sum())
        self.counts["frames_released"] += due.size
        for a, b in zip(reversed(t), reversed(period)):
            if a is not None:
                self.t, self.period = a, b
                break
        self.first = int(due[0]) if self.first is None else self.first
        self.upto = int(due[-1])
        self._note(due)

    def _finish(self) -> list[tuple]:
        """What waits, in order, and the end mark."""
        due = sorted(self.held)
        held = [self.held.pop(s) for s in due]
        self._release(np.array(due, np.int64), [h[2] for h in held], [h[3] for h in held])
        self.ended = True
        return [*(("frame", s, s, h[0]) for s, h in zip(due, held)), ("end", self.upto, self.upto, None)]

    def _answer(self, key, out: list[tuple], released: bool, now: int) -> pd.DataFrame:
        # fixed values: the field names of the statistics
        stats = {"hwm": self.newest, "released_upto": self.upto, "buffer_size": len(self.held), "ended": self.ended,
                 **{f"c_{k}": v for k, v in self.counts.items()}}
        out = [*out, ("stats", self.upto, self.upto, json.dumps(stats, separators=(",", ":")))]
        if released:
            note = {"t": self.t, "period": self.period, "ended": self.ended}
            out += [("clock", self.upto, self.upto, json.dumps({"unit": i, **note})) for i in (json.loads(self.roster.get()[0]) if self.roster.exists() else [])]
        self._keep(now)
        return pd.DataFrame([(*key, *r) for r in out], columns=COLUMNS)

    def _late(self, key, tail: np.ndarray, why: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(tail), ROWS_AT_ONCE):
            some = tail[i:i + ROWS_AT_ONCE]
            notes = [json.dumps({"seq": s, "reason": VERDICTS[v], "t": t if known else None, "attempt": n}, separators=(",", ":"))
                     for s, v, t, known, n in zip(some["sequence"].tolist(), why[i:i + ROWS_AT_ONCE].tolist(), some["t"].tolist(),
                                                  some["has_t"].tolist(), some["attempt"].tolist())]
            yield self._frame(key, "late", some["sequence"], self.upto, notes)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._restore()
        batch = Batch(self.run, self.step)
        for part in rows:
            for numbers, texts, rosters in zip(part["numbers"], part["texts"], part["rosters"]):
                batch.add(numbers, texts, rosters)
        finish = batch.over and not self.ended
        was, upto, ended, waiting, last = self.newest, self.upto, self.ended, set(self.held), -1
        if not ended:
            self.newest = max(self.newest, batch.top)
        limit = None if finish else self.newest - self.depth
        met, any_out, taken = set(), False, np.empty(0, ROW)
        for piece in batch.pieces():
            verdict = verdicts(piece, last, waiting, upto, self._went_out, ended)
            last = int(piece["sequence"][-1])
            late = verdict < len(LATE)
            yield from self._late(key, piece[late], verdict[late])
            of = np.bincount(verdict, minlength=len(VERDICTS))
            self.counts.update({LATE.get(v, v): int(n) for v, n in zip(VERDICTS, of) if n and v != NEW})
            if (behind := int((piece["sequence"][verdict == VERDICTS.index(NEW)] < was).sum())):
                self.counts["reordered"] += behind
            # of a sequence's new row and its corrections, the last one stands; the next piece may begin with more of the last sequence's
            taken = np.concatenate([taken, piece[verdict >= VERDICTS.index(CORRECTION)]])
            taken = taken[np.r_[taken["sequence"][1:] != taken["sequence"][:-1], True][:len(taken)]]
            for frames in self._go_out(key, taken[:-1], batch, limit, met):
                any_out = True
                yield frames
            taken = taken[-1:]
        for frames in self._go_out(key, taken, batch, limit, met, to_the_end=True):
            any_out = True
            yield frames
        known = set(json.loads(self.roster.get()[0])) if self.roster.exists() else set()
        names = list(batch.rosters)
        if not known.issuperset(found := {i for r in met for i in json.loads(names[r])}):
            self.roster.update((json.dumps(sorted(known | found)),))
        self.ended = self.ended or finish
        end = [("end", self.upto, self.upto, None)] if finish else []
        yield self._answer(key, end, finish or any_out, timerValues.getCurrentProcessingTimeInMs())

    def _go_out(self, key, taken: np.ndarray, batch: Batch, limit: int | None, met: set[int], to_the_end: bool = False) -> Iterator[pd.DataFrame]:
        """Of accepted frames in order, and those that waited up to there, the due ones go out and the others wait."""
        met.update(np.unique(taken["roster"]).tolist())
        seq = taken["sequence"]
        for i in range(0, max(1, len(taken)), ROWS_AT_ONCE):
            some = taken[i:i + ROWS_AT_ONCE]
            upto = None if to_the_end and i + ROWS_AT_ONCE >= len(taken) else int(some["sequence"][-1]) if len(some) else -1
            fresh = set(some["sequence"].tolist())
            # those that waited and were not corrected; a correction takes its frame's place
            old = sorted(s for s in self.held if s not in fresh and s in self.stored and (upto is None or s <= upto))
            due = len(some) if limit is None else int(np.searchsorted(some["sequence"], limit, "right"))
            row = lambda x, text: (text, int(x["attempt"]), int(x["t"]) if x["has_t"] else None, int(x["period"]) if x["has_period"] else None)
            out = [(s, self.held.pop(s)) for s in old if limit is None or s <= limit]
            for s in fresh & self.held.keys():
                del self.held[s]
            go, stay = some[:due], some[due:]
            t = [a if b else None for a, b in zip(go["t"].tolist(), go["has_t"].tolist())]
            period = [a if b else None for a, b in zip(go["period"].tolist(), go["has_period"].tolist())]
            pool = list(zip(go["sequence"].tolist(), batch.texts.get(go["text"]), t, period))
            if out:
                pool = sorted([*pool, *((s, v[0], v[2], v[3]) for s, v in out)], key=lambda r: r[0])
            for x, text in zip(stay, batch.texts.get(stay["text"])):
                self.held[int(x["sequence"])] = row(x, text)
            if pool:
                s, values, t, period = zip(*pool)
                s = np.array(s, np.int64)
                self._release(s, t, period)
                yield self._frame(key, "frame", s, s, list(values))

    @staticmethod
    def _frame(key, kind: str, seq, upto, payload: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(COLUMNS, [*key, kind, seq, upto, payload])), columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Idle: finish the match; idle again later: forget it."""
        self._restore()
        if self.ended:
            for state in (self.waiting, self.packs, self.released, self.where, self.roster):
                state.clear()
            return
        yield self._answer(key, self._finish(), True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def released(messages: DataFrame, depth: int, idle_ms: int) -> DataFrame:
    """Stream of valid messages -> stream of released frames, late rows, end marks, statistics and clocks (one per entity).

    messages: session_id, match_id, value, e (parsed), kafka_offset.
    """
    ids = F.coalesce(F.transform("e.players", lambda x: x["canonical_player_id"]), F.array().cast("array<string>"))
    m = messages.select(
        "session_id", "match_id", "value", F.col("e.sequence").alias("sequence"),
        F.coalesce(F.col("e.attempt"), F.lit(0)).alias("attempt"), F.col("e.physical_time_ms").alias("t"), F.col("e.period").alias("period"),
        F.to_json(F.filter(ids, lambda i: i.isNotNull())).alias("roster"),
        F.coalesce(F.col("e.end_of_stream"), F.lit(False)).alias("eos"),
        F.coalesce(F.array_contains(F.col("e.quality_flags"), "injected_correction"), F.lit(False)).alias("correction"),
        F.coalesce(F.col("kafka_offset").cast("bigint"), F.lit(0).cast("bigint")).alias("kafka_offset"))
    return m.mapInArrow(packed, PACKED).groupBy("session_id", "match_id").transformWithStateInPandas(
        statefulProcessor=Reorder(depth, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
