"""Reorder rules, faults, idle timeout, retries, parity of stream and batch, score stream."""
from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests import circle as circ
from touchline.operators import tracking
from touchline.operators.joins import parity
from touchline.sinks.tables import CommitLog, Lake
from touchline.sources.files import stream_source
from touchline.sources.tracking import assemble_frames
from touchline.streaming import scores as sc
from touchline.streaming import tracking as st
from touchline.streaming.reorder import released
from touchline.streaming.validate import attributed, with_validation


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State tasks start a Python worker each; two partitions are enough for a handful of keys."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    # timers keep a query ticking; without empty batches "available now" ends with the input
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def write_batches(folder, batches):
    """One JSON file per batch with growing modification times, so files arrive in order."""
    os.makedirs(folder, exist_ok=True)
    base, off = time.time() - 10_000, 0
    for i, rows in enumerate(batches):
        path = f"{folder}/part-{i:05d}.json"
        with open(path, "w") as fh:
            for key, value in rows:
                fh.write(json.dumps({"key": key, "value": value, "topic": "tracking", "kafka_partition": 0, "kafka_offset": off,
                                     "kafka_ts": "2024-01-01T00:00:00Z"}) + "\n")
                off += 1
        os.utime(path, (base + i, base + i))


def msg(seq, session="s", match="m", **kw):
    m = {"schema_version": "1.0.0", "record_type": "tracking_frame", "match_id": match, "replay_session_id": session, "sequence": seq,
         "physical_time_ms": seq * 100, "period": 1, "attempt": 0, "quality_flags": [], "players": [], **kw}
    return f"{session}|{match}", json.dumps(m)


def run_reorder(spark, tmp, batches, depth=5, idle_ms=600_000, trigger=None):
    write_batches(f"{tmp}/in", batches)
    src = stream_source(spark, {"format": "json", "path": f"{tmp}/in", "per_trigger": 1})
    valid = attributed(with_validation(src)).filter(F.col("invalid_reason").isNull())
    rows = []
    q = (released(valid, depth, idle_ms).writeStream.foreachBatch(lambda d, i: rows.extend(d.collect()))
         .option("checkpointLocation", f"{tmp}/cp").trigger(**(trigger or {"availableNow": True})).start())
    if trigger is None:
        assert q.awaitTermination(180)
    return q, rows


def test_release_order_duplicates_corrections_late(spark, tmp_path):
    a = [msg(i) for i in (0, 1, 2, 4, 3, 5, 6, 7, 8, 9)] + [msg(8)]
    b = [msg(9, quality_flags=["injected_correction"], clock="new"), msg(2, quality_flags=["injected_correction"]), msg(1)] + [msg(i) for i in (10, 11, 14, 15, 16, 17, 18, 19, 20)]
    c = [msg(12), msg(21, end_of_stream=True)]
    d = [msg(30)]
    _, rows = run_reorder(spark, tmp_path, [a, b, c, d])
    frames = [r.seq for r in sorted((r for r in rows if r.kind == "frame"), key=lambda r: r.seq)]
    assert frames == [i for i in range(21) if i not in (12, 13)]
    late = {(r.seq, json.loads(r.payload)["reason"]) for r in rows if r.kind == "late"}
    assert late == {(2, "late_correction"), (12, "late_beyond_reorder_buffer"), (30, "after_end_of_stream")}
    assert json.loads(next(r.payload for r in rows if r.kind == "frame" and r.seq == 9))["clock"] == "new"
    stats = [json.loads(r.payload) for r in rows if r.kind == "stats"]
    last = max(stats, key=lambda s: (s["ended"], s.get("c_after_end", 0)))
    assert last["c_duplicate"] == 2 and last["c_corrections_applied"] == 1 and last["c_missing_frames"] == 2
    assert last["c_frames_released"] == 19 and last["buffer_size"] == 0 and last["c_after_end"] == 1
    assert sum(r.kind == "end" for r in rows) == 1


def test_a_batch_keeps_its_texts_out_of_memory(spark, tmp_path):
    """Texts go through the scratch file and back in order, over several answers and batches; holes are packed."""
    import numpy as np

    from touchline.streaming import reorder

    texts = reorder.Texts()
    texts.add(["a", "", "\u00e9"])
    texts.add(["\u4e2d", "end"])
    assert texts.get(np.array([4, 2, 1, 3])) == ["end", "\u00e9", "", "\u4e2d"]
    seqs = list(range(0, 30_000, 2))
    late = [msg(i) for i in (1, 3)] + [msg(4), msg(30_001)]
    _, rows = run_reorder(spark, tmp_path, [[msg(i) for i in reversed(seqs)], late, [msg(30_002, end_of_stream=True)]])
    frames = [r for r in rows if r.kind == "frame"]
    assert sorted(r.seq for r in frames) == [*seqs, 30_001] and all(json.loads(r.payload)["sequence"] == r.seq for r in frames)
    assert {(r.seq, json.loads(r.payload)["reason"]) for r in rows if r.kind == "late"} == {(i, "late_beyond_reorder_buffer") for i in (1, 3)}
    last = json.loads([r.payload for r in rows if r.kind == "stats"][-1])
    assert last["c_duplicate"] == 1 and last["c_frames_released"] == 15_001 and last["c_missing_frames"] == 14_999 + 2


class States:
    """A state handle in memory."""

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        iterator = lambda self: iter([*self.items()])
        getValue = lambda self, k: self[k]

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    getValueState = lambda self, *a: States.Value()
    getMapState = lambda self, *a: States.Map()
    listTimers = lambda self: []

    def registerTimer(self, at):
        pass


def packed_rows(messages, at_once):
    """Messages (sequence, attempt, offset, correction, end) as the rows that the reorder step gets."""
    import pyarrow as pa

    from touchline.streaming import reorder

    for i in range(0, len(messages), at_once):
        some = messages[i:i + at_once]
        cols = {"session_id": ["s"] * len(some), "match_id": ["m"] * len(some), "value": [f"{m}" for m in some], "sequence": [m[0] for m in some],
                "attempt": [m[1] for m in some], "t": [m[0] * 10 if m[0] % 4 else None for m in some], "period": [1] * len(some),
                "roster": [json.dumps([f"p{m[0] % 3}"]) for m in some], "eos": [m[4] for m in some], "correction": [m[3] for m in some],
                "kafka_offset": [m[2] for m in some]}
        b = pa.RecordBatch.from_pydict(cols, schema=pa.schema([(c, pa.string() if c in ("session_id", "match_id", "value", "roster") else pa.bool_() if c in ("eos", "correction")
                                                               else pa.int32() if c in ("attempt", "period") else pa.int64()) for c in cols]))
        yield from (r.to_pandas() for r in reorder.packed([b]))


def plain_reorder(batches, depth):
    """The reorder rules message by message: released (sequence, text), late (sequence, reason), in the order they go out, per batch."""
    newest, upto, held, gone, ended = -1, -1, {}, set(), False
    for batch in batches:
        late, out, seen = [], [], set(held)
        top = max([newest, *(m[0] for m in batch if not m[4])]) if not ended else newest
        for m in sorted((m for m in batch if not m[4]), key=lambda m: m[:3]):
            if ended:
                late.append((m[0], "after_end_of_stream"))
            elif m[0] <= upto:
                if m[3] or m[0] not in gone:
                    late.append((m[0], "late_correction" if m[3] else "late_beyond_reorder_buffer"))
            elif m[0] not in seen or m[3]:
                held[m[0]] = f"{m}"
                seen.add(m[0])
        newest, over = top, any(m[4] for m in batch) and not ended
        for q in sorted(q for q in held if over or q <= newest - depth):
            out.append((q, held.pop(q)))
            gone.add(q)
            upto = q
        ended = ended or over
        yield late, out


@pytest.mark.parametrize("run, step, pack", [(4, 1, 3), (16, 4, 5), (100_000, 1024, 16_384)])
def test_a_match_is_reordered_piece_by_piece(run, step, pack):
    """Runs, pieces and packs of any size give the rows of the plain rules, and no piece is much longer than a run."""
    from types import SimpleNamespace

    from touchline.streaming import reorder

    r = random.Random(3)
    batches = []
    for i in range(6):
        of = [r.randrange(i * 40, i * 40 + 90) for _ in range(120)]
        batches.append([(q, r.randrange(3), n, r.random() < 0.2, False) for n, q in enumerate(of)])
    batches[4].append((999, 0, 999, False, True))
    state = reorder.Reorder(7, 1000, run, step, pack)
    state.init(States())
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    for batch, (late, out) in zip(batches, plain_reorder(batches, 7), strict=True):
        rows = [x for part in state.handleInputRows(("s", "m"), packed_rows(batch, 50), clock) for x in part.itertuples()]
        assert [(x.seq, x.payload) for x in rows if x.kind == "frame"] == out
        assert [(x.seq, json.loads(x.payload)["reason"]) for x in rows if x.kind == "late"] == late
        assert state.newest == max(m[0] for b in batches[:batches.index(batch) + 1][:5] for m in b if not m[4])
    held = reorder.Batch(run, step)
    for part in packed_rows(batches[0], 7):
        held.add(*part.iloc[0, 2:])
    pieces = [*held.pieces()]
    got = [tuple(x) for p in pieces for x in p[reorder.ORDER].tolist()]
    assert got == sorted(m[:3] for m in batches[0])
    if run < 100:
        assert len(pieces) > 3 and max(map(len, pieces)) <= run + len(held.runs) * step and max(n for _, n, _ in held.runs) <= run + 7


def test_idle_match_is_finished_by_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    q, rows = run_reorder(spark, tmp_path, [[msg(i) for i in range(8)]], depth=5, idle_ms=3000, trigger={"processingTime": "1 second"})
    try:
        end = time.time() + 90
        while time.time() < end and not any(r.kind == "end" for r in rows):
            time.sleep(1)
    finally:
        q.stop()
    kinds = [r.kind for r in rows]
    assert kinds.count("frame") == 8 and kinds.count("end") == 1


def test_validation_rules(spark):
    good = msg(1)[1]
    bad = [("s|m", "not json"), ("s|m", json.dumps({"match_id": "m"})), msg(1, schema_version="2.0"), msg(1, record_type="x"), msg(-1),
           msg(1, physical_time_ms=None), msg(1, physical_time_ms=-5), msg(1, players=[{"entity_type": "player"}] * 41), ("other|m", good), ("s|m", good),
           msg(5, end_of_stream=True, physical_time_ms=None)]
    d = attributed(with_validation(spark.createDataFrame(bad, "key string, value string").coalesce(1)))
    r = [(x.invalid_reason, x.session_id, x.attributed_by_key) for x in d.collect()]
    assert [x[0] for x in r] == ["unparseable_or_missing_match_id", "missing_replay_session_id", "unsupported_schema_version", "wrong_record_type", "bad_sequence",
                                 "missing_physical_time", "negative_physical_time", "too_many_entities", "key_envelope_mismatch", None, None]
    assert r[0][1:] == ("s", True) and r[1][1] == "s" and r[1][2] is False


@pytest.fixture(scope="module")
def small(spark):
    return {k: v.cache() for k, v in circ.build(spark, period_s=70).items()}


def messages_of(small):
    meta = {"source": "test", "sport": "soccer"}
    rows = assemble_frames(small["frames"], small["positions"], "s1", meta).orderBy("sequence").select("key", "value").collect()
    return [(r.key, r.value) for r in rows]


def faulted(msgs, seed=11):
    """Duplicates, neighbour swaps, short delays, corrections and broken text, all inside the reorder depth."""
    r, out, held = random.Random(seed), [], []
    for i, (k, v) in enumerate(msgs[:-1]):
        if r.random() < 0.03:
            held.append((i + 5, (k, v)))
        else:
            out.append((k, v))
            if r.random() < 0.05:
                out.append((k, v))
            if r.random() < 0.02:
                m = json.loads(v)
                m["quality_flags"] = m["quality_flags"] + ["injected_correction"]
                out.append((k, json.dumps(m)))
            if r.random() < 0.01:
                out.append((k, v[: len(v) // 2]))
            if len(out) > 1 and r.random() < 0.05:
                out[-1], out[-2] = out[-2], out[-1]
        out += [m for at, m in held if at <= i]
        held = [h for h in held if h[0] > i]
    return out + [m for _, m in held] + [msgs[-1]]


@pytest.mark.parametrize("faults", [False, True])
def test_stream_equals_batch(spark, small, tmp_path, faults):
    msgs = messages_of(small)
    if faults:
        msgs = faulted(msgs)
    n = 500
    write_batches(f"{tmp_path}/in", [msgs[i:i + n] for i in range(0, len(msgs), n)])
    lake = st.open_lake(spark, f"{tmp_path}/lake")
    src = lambda: stream_source(spark, {"format": "json", "path": f"{tmp_path}/in", "per_trigger": 1})
    eng = st.Engine(lake, tracking.SOCCER, small["periods"], small["teams"], small["keepers"])
    q = st.start_engine(src(), eng, f"{tmp_path}/cp", {"availableNow": True})
    q.awaitTermination(600)
    assert q.exception() is None
    batch = tracking.run_batch(small["positions"], small["frames"], small["periods"], small["teams"], small["keepers"], tracking.SOCCER)
    pw = lake.read("gold.player_windows")
    final = st.final_rows(pw, ["session_id", "match_id", "entity_id", "window"])
    assert final.count() == pw.filter("is_final").count()          # one final row per window
    assert pw.filter("not is_final").count() > 0                   # partial rows came before
    checks = [
        (batch["player_window"], final, ["entity_id", "window"], ["distance_m", "active_ms", "detected_ms", "hi_ms", "sprint_ms", "sprint_count", "accel_count",
                                                                 "decel_count", "max_speed_mps", "in_poss_ms", "excluded_gap_ms"]),
        (batch["team_window"], st.final_rows(lake.read("gold.team_windows"), ["session_id", "match_id", "team_id", "window"]), ["team_id", "window"],
         ["n_frames", "n_sufficient", "mean_width_m", "mean_depth_m", "mean_hull_area_m2"]),
        (batch["dwell"], st.final_rows(lake.read("gold.spatial_dwell"), ["session_id", "match_id", "entity_id", "window", "cell_x", "cell_y"]),
         ["entity_id", "window", "cell_x", "cell_y"], ["dwell_ms"])]
    for b, s, keys, metrics in checks:
        row = parity(b, s, keys, metrics).first().asDict()
        assert row["batch_rows"] == row["stream_rows"] > 0, row
        assert all(v == 0 for k, v in row.items() if k.startswith(("only", "diff"))), row
    assert lake.read("silver.tracking_frames").count() == small["frames"].count()
    # one match's rows are its own folders, and old team state is gone
    plan = lake.read("silver.tracking_positions").filter("match_id = 'none'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(match_id" in plan.replace("\n", "") and lake.read("silver.tracking_positions").filter("match_id = 'none'").count() == 0
    assert len(os.listdir(f"{tmp_path}/lake/state.team_windows")) <= 6 and len([f for f in os.listdir(f"{tmp_path}/lake/state.team_windows") if f.startswith("batch_id=")]) <= 2
    if not faults:
        bq = st.start_bronze(src(), lake, f"{tmp_path}/cpb", {"availableNow": True})
        bq.awaitTermination(300)
        assert bq.exception() is None and lake.read("bronze.tracking_raw").count() == len(msgs)
    else:
        bq = st.start_bronze(src(), lake, f"{tmp_path}/cpb", {"availableNow": True})
        bq.awaitTermination(300)
        bad = lake.read("ops.quarantine")
        assert bad.count() == lake.read("bronze.tracking_raw").filter("not valid").count() > 0
        assert bad.filter("match_id is null").count() == 0           # found again through the message key


def test_retried_batch_adds_nothing(spark, tmp_path):
    lake = Lake(spark, f"{tmp_path}/lake", {"t": "a bigint, batch_id bigint"})
    log = CommitLog(lake, "q")
    df = spark.range(5).select(F.col("id").alias("a"))
    assert log.append(df, "t", 0) and not log.append(df, "t", 0)
    assert log.last("t", 5) == 0 and log.last("t", 0) is None
    # a failure between data and ledger: the same batch again replaces its own rows
    lake.commit(df, "t", 1)
    assert log.append(df, "t", 1)
    assert lake.read("t").count() == 10 and lake.read("ops.sink_ledger").count() == 2


def snapshot(league, gid, h, a, status, events=(), periods=()):
    return json.dumps({"league": league, "games": [{"gameId": gid, "statusText": status, "homeTeam": {"teamName": "H", "score": h}, "awayTeam": {"teamName": "A", "score": a},
                                                    "periods": list(periods), "events": list(events)}]})


def test_score_stream_inserts_once(spark, tmp_path):
    ev = [{"type": "goal", "minute": 3, "player": "P", "team": "H"}, {"type": "substitution", "minute": None, "playerIn": "I", "playerOut": "O", "team": "A"}]
    per = [{"period": 1, "homeScore": 1, "awayScore": 0}]
    s1, s2 = snapshot("epl", "g1", 1, 0, "live", ev, per), snapshot("epl", "g1", 2, 0, "live", ev + [{"type": "goal", "minute": 9, "player": "P (OG)", "team": "H"}], per)
    write_batches(f"{tmp_path}/in", [[("k", s1), ("k", s1)], [("k", s1), ("k", s2), ("k", snapshot("nba", "g2", 0, 0, "soon"))], [("k", s2)]])
    lake = Lake(spark, f"{tmp_path}/lake", sc.SCHEMAS)
    q = sc.start_scores(stream_source(spark, {"format": "json", "path": f"{tmp_path}/in", "per_trigger": 1}), lake, f"{tmp_path}/cp", {"availableNow": True})
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted((r.game_id, r.home_score) for r in lake.read("game_scores").collect()) == [("g1", 1), ("g1", 2), ("g2", 0)]
    assert lake.read("period_scores").count() == 1
    e = sorted((r.event_type, r.minute or 0, r.player_name or "", r.player_out or "") for r in lake.read("match_events").collect())
    assert e == [("goal", 3, "P", ""), ("goal", 9, "P (OG)", ""), ("substitution", 0, "", "O")]


def test_score_rows_come_from_two_readings(spark, tmp_path):
    """All tables' rows are those of the builders, nulls and empty lists included, and the input is parsed for keyed and unkeyed rows only."""
    ev = [{"type": "goal", "minute": 3, "player": "P", "team": "H"}, {"type": "substitution", "playerIn": "I", "playerOut": "O"}, None]
    values = [snapshot("epl", "g1", 1, 0, "live", ev, [{"period": 1, "homeScore": 1}, None]), snapshot("epl", None, None, 0, "live"),
              '{"league": null, "games": [null, {"gameId": "g3"}]}', '{"games": null}', "no json", None]
    g = sc.games(spark.createDataFrame([(v,) for v in values], "value string"))
    rows = sc.all_rows(g)
    for name, build in sc.BUILDERS.items():
        mine = rows.filter(F.col("table") == name).select(F.from_json("row", sc.SCHEMAS[name]).alias("r")).select("r.*").drop("batch_id", "ingested_at")
        want = build(g).drop("ingested_at").select(*mine.columns)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, want.collect()))
    keys, null_safe = sc.KEYS["match_events"]
    loose = sc.match_events(g).filter(" or ".join(f"{k} is null" for k in keys if k not in null_safe)).count()
    assert rows.filter("not whole and table = 'match_events'").count() == loose > 0
    write_batches(f"{tmp_path}/in", [[("k", values[0])]])
    stream = sc.inserted_once(sc.all_rows(sc.games(stream_source(spark, {"format": "json", "path": f"{tmp_path}/in"}))))
    assert stream._jdf.queryExecution().analyzed().toString().count("from_json(") == 2


def test_changes_only_stream(spark, tmp_path):
    write_batches(f"{tmp_path}/in", [[("a", "1"), ("a", "1"), ("b", "9")], [("a", "1"), ("a", "2"), ("a", "1")]])
    src = stream_source(spark, {"format": "json", "path": f"{tmp_path}/in", "per_trigger": 1})
    d = sc.changes_only_stream(src.select("key", F.col("kafka_offset").alias("ord"), F.col("value").alias("fp"), "value"))
    q = d.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.ord, r.fp) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0, "1"), ("a", 4, "2"), ("a", 5, "1"), ("b", 2, "9")]
