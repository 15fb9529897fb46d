"""Energy sections of a track from framed loudness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import ordered
from touchline.operators.windows import moving_avg3
from touchline.session import materialize

# Fixed values
FRAME_S, EDGE, SPACING = 4.0, 0.15, 2

CHUNK_ROWS = 4096            # frames of a track that one row holds


def framed_rms(samples: DataFrame, track: Sequence[str], index: str, value: str, frame_samples: int) -> DataFrame:
    return samples.groupBy(*track, F.floor(F.col(index) / frame_samples).alias("frame_idx")).agg(
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def _label(pos: Column, energy: Column, trend: Column) -> Column:
    return (F.when((pos < 0.15) & (energy < 0.4), "intro").when((pos > 0.85) & (energy < 0.4), "outro")
            .when(energy >= 0.65, "drop").when(trend > 0.1, "buildup")
            .when((energy < 0.4) & (pos > 0.2) & (pos < 0.8), "breakdown")
            .when(energy >= 0.4, "buildup").otherwise("breakdown"))


def _greedy(start: Column, distance: int) -> Column:
    """The boundaries among a chunk's ``jumps`` if the last one before it is ``distance`` frames before its start."""
    none = F.array().cast("array<bigint>")
    last = lambda cuts: F.coalesce(F.try_element_at(cuts, F.lit(-1)), start - distance)
    return F.aggregate("jumps", none, lambda cuts, i: F.when(i - last(cuts) >= SPACING, F.concat(cuts, F.array(i))).otherwise(cuts))


def boundaries(jumps: DataFrame, track: str, chunk_rows: int) -> DataFrame:
    """(track, a): the greedy choice among jumps (track, frame_idx), each at least ``SPACING`` frames after the one before; the first, 0, included.

    How a chunk of the track goes on depends only on how far before its start the last boundary lies, from 0 (the first chunk) to
    ``SPACING`` frames or more. So each chunk is folded once for each of these, and the chunks of a track are chained by what they leave.
    """
    c = jumps.withColumn("chunk", F.floor(F.col("frame_idx") / chunk_rows)).groupBy(track, "chunk").agg(
        F.array_sort(F.collect_list(F.col("frame_idx").cast("bigint"))).alias("jumps"))
    start = F.col("chunk") * chunk_rows
    c = c.select(track, "chunk", *[_greedy(start, r).alias(f"cuts{r}") for r in range(SPACING + 1)])
    after = lambda r: F.least((F.col("chunk") + 1) * chunk_rows - F.try_element_at(f"cuts{r}", F.lit(-1)), F.lit(SPACING))
    # a chunk without a boundary leaves the last one farther away than any spacing
    c = c.withColumn("leaves", F.array(*[F.coalesce(after(r), F.lit(SPACING)).cast("int") for r in range(SPACING + 1)]))
    # one row per chunk of a track
    chain = c.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("chunk", "leaves"))).alias("x"))
    begin = F.when(F.get("x", F.lit(0))["chunk"] == 0, F.lit(0)).otherwise(F.lit(SPACING))
    state = F.struct(begin.alias("at"), (F.get("x", F.lit(0))["chunk"] - 1).alias("chunk"), F.array().cast("array<struct<chunk:bigint,enters:int>>").alias("out"))

    def step(s, x):
        # chunks without jumps have no row, and leave the boundary far away
        enters = F.when(x["chunk"] == s["chunk"] + 1, s["at"]).otherwise(F.lit(SPACING))
        return F.struct(F.get(x["leaves"], enters).alias("at"), x["chunk"].alias("chunk"),
                        F.concat(s["out"], F.array(F.struct(x["chunk"].alias("chunk"), enters.alias("enters")))).alias("out"))

    enters = chain.select(track, F.explode(F.aggregate("x", state, step, lambda s: s["out"])).alias("o")).select(track, "o.chunk", "o.enters")
    chosen = F.when(F.col("enters") == 0, F.col("cuts0"))
    for r in range(1, SPACING + 1):
        chosen = chosen.when(F.col("enters") == r, F.col(f"cuts{r}"))
    return c.join(enters, [track, "chunk"]).select(track, F.explode(chosen).alias("a"))


def sections(frames: DataFrame, track: str = "track_id", frame_s: float = FRAME_S, smooth: bool = True,
             duration: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sections with start, end, level and label.

    frames: track, frame_idx (0-based, gapless), rms. Every step works on pieces of ``chunk_rows`` frames of a track, so a track of
    any length spreads over many tasks.
    """
    chunk_rows = max(SPACING, chunk_rows)
    chunk = ordered.by_number("frame_idx", chunk_rows)
    n = frames.groupBy(track).agg(F.count(F.lit(1)).alias("n"))
    d = frames
    if smooth:
        # smoothing needs at least three frames
        d = moving_avg3(d, "rms", "_sm", [track], ["frame_idx"], chunk)
        d = d.join(n, track).withColumn("rms", F.when(F.col("n") >= 3, F.col("_sm")).otherwise(F.col("rms"))).drop("_sm", "n")
    extra = [F.max(duration).alias("_dur")] if duration else []
    tracks = d.groupBy(track).agg(F.max("rms").alias("_top"), F.count(F.lit(1)).cast("int").alias("n"), *extra)
    tracks = tracks.withColumn("total_s", F.col("_dur").cast("double") if duration else F.col("n") * F.lit(frame_s))
    silent = tracks.filter(F.col("_top") < 1e-10).select(
        track, F.lit(0).alias("section"), F.lit("silence").alias("label"), F.lit(0.0).alias("start_sec"),
        F.round("total_s", 1).alias("end_sec"), F.lit("low").alias("energy_level"))
    e = d.select(track, F.col("frame_idx").cast("bigint").alias("frame_idx"), "rms").join(tracks.filter(F.col("_top") >= 1e-10), track) \
        .select(track, "frame_idx", "n", "total_s", (F.col("rms") / F.col("_top")).alias("e"))
    e = materialize(ordered.with_lead(e, {"e": "_next"}, [track], ["frame_idx"], chunk), "sections-frames")
    # jump i lies between frames i and i+1
    jumps = e.filter(F.col("frame_idx").between(1, F.col("n") - 2) & (F.abs(F.col("_next") - F.col("e")) > EDGE)).select(track, "frame_idx")
    cuts = boundaries(jumps, track, chunk_rows).unionByName(e.filter("frame_idx = 0").select(track, F.col("frame_idx").alias("a")))
    marked = e.join(cuts.withColumn("_cut", F.lit(True)), (F.col("frame_idx") == F.col("a")) & (e[track] == cuts[track]), "left").select(e["*"], "a")
    marked = ordered.carry_forward(marked, "a", "_a", [track], ["frame_idx"], chunk)
    part = marked.groupBy(track, F.col("_a").alias("a")).agg(
        F.max("frame_idx").alias("_last"), F.avg("e").alias("_energy"), F.min_by("e", "frame_idx").alias("_first_e"),
        F.max_by("e", "frame_idx").alias("_last_e"), F.first("n").alias("n"), F.first("total_s").alias("total_s"))
    part = ordered.with_sequence(part, "section", [track], ["a"], ordered.by_number("a", chunk_rows))
    many = part.groupBy(track).agg(F.count(F.lit(1)).alias("_many"))
    part = part.join(many, track).withColumns({"_b": F.col("_last") + 1, "_trend": F.col("_last_e") - F.col("_first_e")})
    pos = F.col("section") / F.greatest(F.col("_many") - 1, F.lit(1))
    level = F.when(F.col("_energy") < 0.3, "low").when(F.col("_energy") < 0.65, "medium").otherwise("high")
    loud = part.select(track, F.col("section").cast("int").alias("section"), _label(pos, F.col("_energy"), F.col("_trend")).alias("label"),
                       F.round(F.col("a") * frame_s, 1).alias("start_sec"),
                       F.round(F.least(F.col("_b") * frame_s, F.col("total_s")), 1).alias("end_sec"), level.alias("energy_level"))
    return loud.unionByName(silent)
