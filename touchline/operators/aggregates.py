"""Grouped aggregates. All use Spark's partial aggregation, so a hot key is combined before the shuffle."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scoring import with_stats
from touchline.operators import ordered


def contracts_agg(df: DataFrame, keys: Sequence[str], salary: str = "salary") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(salary).alias("salary"))


def injuries_agg(df: DataFrame, keys: Sequence[str], missed: str = "games_missed") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(missed).alias("total_games_missed"), F.count(F.lit(1)).alias("injury_count"))


def coverage(df: DataFrame, source: str = "source_name", entity: str = "player_id", exact: bool = True) -> DataFrame:
    """Distinct entities and rows per source. Sources are few, so entities are made distinct first and the
    distinct rows counted: one source cannot pull all its entities into one task."""
    if not exact:
        return df.groupBy(source).agg(F.approx_count_distinct(entity).alias("unique_players"),
                                      F.count(F.lit(1)).alias("total_records"))
    per = df.groupBy(source, entity).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(source).agg(F.count(entity).alias("unique_players"), F.sum("n").alias("total_records"))


def zone_profile(shots: DataFrame, keys: Sequence[str], made: str) -> DataFrame:
    return (shots.groupBy(*keys).agg(F.count(made).alias("fga"), F.sum(made).cast("bigint").alias("fgm"))
            .withColumn("fg_pct", F.round(F.try_divide("fgm", "fga"), 4)))


def dedup_conflicts(df: DataFrame, by: Sequence[str], content: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key, with how many repeats were dropped and how many of those had other content."""
    first = F.min_by(F.struct(*content), F.struct(*order))
    per_content = df.groupBy(*by, *content).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_o"))
    g = per_content.groupBy(*by).agg(
        F.min_by(F.struct(*content), "_o").alias("_first"), F.sum("_n").alias("_all"),
        F.min_by("_n", "_o").alias("_same"))
    return g.select(*by, *[F.col(f"_first.{c}").alias(c) for c in content],
                    (F.col("_all") - 1).alias("duplicates"), (F.col("_all") - F.col("_same")).alias("conflicts"))


def team_seconds(df: DataFrame, keys: Sequence[str], features: Sequence[str], plain: Sequence[str] = (),
                 sufficient: str = "sufficient", t: str = "t_ms", poss: Column | None = None) -> DataFrame:
    """Per key: first time, rows, means over sufficient frames, plain means, possession share."""
    ok = F.col(sufficient)
    extra = [] if poss is None else [F.avg(poss.cast("double")).alias("poss_share")]
    return df.groupBy(*keys).agg(
        F.min(t).alias("t_ms"), F.count(F.lit(1)).alias("n"),
        *[F.avg(F.when(ok, F.col(c))).alias(c) for c in features], *[F.avg(c).alias(c) for c in plain], *extra)


def player_totals(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """Sums over windows; entities never active are left out."""
    return df.groupBy(key).agg(
        F.min("team_id").alias("team_id"), F.sum("distance_m").alias("distance_m"),
        F.sum("hi_distance_m").alias("hi_distance_m"), F.sum("sprint_count").alias("sprints"),
        F.max("max_speed_mps").alias("max_speed_mps"), F.sum("active_ms").alias("active_ms"),
        F.sum("detected_ms").alias("detected_ms"), F.sum("excluded_gap_ms").alias("excluded_gap_ms"),
        F.count_if("is_final").alias("final_windows"), F.count(F.lit(1)).alias("windows"),
    ).filter(F.col("active_ms") > 0)


def rates(df: DataFrame) -> DataFrame:
    minutes = F.col("active_ms") / 60000
    return df.withColumns({
        "distance_per_active_min_m": F.round(F.try_divide(F.col("distance_m"), minutes), 1),
        "detected_share": F.round(F.try_divide(F.col("detected_ms"), F.col("active_ms")), 3)})


def value_chunks(df: DataFrame, col: str, pieces: int = 64) -> Column:
    """A number that never falls as ``col`` rises and cuts the table's values into about equal pieces.

    The cuts come from one approximate-percentile job; they only decide how rows are spread.
    """
    steps = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), steps, 10_000)).first()[0] or []
    inside = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(inside, lambda c: c < F.col(col).cast("double")))


def _values_at(df: DataFrame, col: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str]) -> DataFrame:
    """The values at 0-based ranks of the sorted column, per group; each rank is a function of the group's count.

    Values are counted first, so the work after the first shuffle is on distinct values, not on rows; ranks come from
    a running sum over those values in chunks, and each pick is a minimum: no task holds a group's values.
    """
    known = df.filter(F.col(col).isNotNull())
    counts = known.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered.running_sum(counts, "_n", "_upto", by, [col], value_chunks(known, col))
    upto = with_stats(upto, by, _total=F.sum("_n"))
    g = upto.groupBy(*by) if by else upto
    return g.agg(F.max("_total").alias("_total"), *[F.min(F.when(F.col("_upto") > r(F.col("_total")), F.col(col))).alias(n) for n, r in ranks.items()])


def exact_quantiles(df: DataFrame, col: str, ps: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Element at rank ``floor(p * n)`` (0-based, last element for p = 1) of the sorted values."""
    ranks = {name: (lambda n, p=p: F.least(F.floor(F.lit(p) * n), n - 1)) for name, p in ps.items()}
    return _values_at(df, col, ranks, by).drop("_total")


def interpolated_quantiles(df: DataFrame, col: str, ps: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles between the two neighbours of ``p * (n - 1)``; null for a group without values."""
    ranks = {}
    for name, p in ps.items():
        ranks[f"_l_{name}"] = lambda n, p=p: F.floor(F.lit(p) * (n - 1))
        ranks[f"_h_{name}"] = lambda n, p=p: F.ceil(F.lit(p) * (n - 1))
    found = _values_at(df, col, ranks, by)

    def between(name, p):
        at, low, high = F.lit(p) * (F.col("_total") - 1), F.col(f"_l_{name}").cast("double"), F.col(f"_h_{name}").cast("double")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.select(*by, *[between(name, p) for name, p in ps.items()])


def with_quantiles(df: DataFrame, col: str, ps: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Attach interpolated quantiles of the row's group; without groups they are one row."""
    q = interpolated_quantiles(df, col, ps, by)
    if not by:
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(q.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    q = q.select(*[F.col(b).alias(f"_q{i}") for i, b in enumerate(by)], *ps)
    same = [F.col(b).eqNullSafe(F.col(f"_q{i}")) for i, b in enumerate(by)]
    return df.join(q, same, "left").drop(*[f"_q{i}" for i in range(len(by))])


def frames_as_arrays(df: DataFrame, frame: Sequence[str], entity: Sequence[str], out: str = "ents") -> DataFrame:
    """One row per frame with its entities as a sorted array. A frame holds at most a few dozen entities."""
    return df.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct(*entity))).alias(out))


def overfull_frames(df: DataFrame, frame: Sequence[str], limit: int = 40) -> DataFrame:
    """Quarantine rows for frames with more entities than the contract allows: the frame, its entities, the reason.

    Counted with a partial aggregate. The frames themselves are not touched; whoever must not take them joins these.
    """
    n = df.groupBy(*frame).agg(F.count(F.lit(1)).alias("entities"))
    return n.filter(F.col("entities") > limit).withColumn("reason", F.lit("too_many_entities"))


def bucket_trend(df: DataFrame, by: Sequence[str], t: str, value: str, width_ms: int) -> DataFrame:
    """Mean per time bucket, then last minus first bucket; keys with fewer than two buckets are left out."""
    b = df.withColumn("bucket", F.floor(F.col(t) / width_ms)).groupBy(*by, "bucket").agg(
        F.avg(value).alias("v"), F.min(t).alias("t0"))
    return (b.groupBy(*by).agg(
        F.count(F.lit(1)).alias("buckets"), F.min_by("v", "bucket").alias("first_v"),
        F.max_by("v", "bucket").alias("last_v"), F.min("t0").alias("first_t"), F.max("t0").alias("last_t"))
        .filter(F.col("buckets") >= 2).withColumn("delta", F.col("last_v") - F.col("first_v")))


def heatmap(dwell: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return dwell.groupBy(*by, "cell_x", "cell_y").agg(F.sum("dwell_ms").alias("dwell_ms"))


def reconcile(dwell: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dwell time against active time without a cell; ``ok`` when they are equal."""
    d = dwell.groupBy(*by).agg(F.sum("dwell_ms").alias("dwell_ms"))
    w = windows.groupBy(*by).agg(F.sum("active_ms").alias("active_ms"), F.sum("no_cell_ms").alias("no_cell_ms"))
    return (w.join(d, list(by), "left").withColumn("dwell_ms", F.coalesce("dwell_ms", F.lit(0)))
            .withColumn("ok", F.col("dwell_ms") == F.col("active_ms") - F.col("no_cell_ms")))


def direction_votes(frames: DataFrame, by: Sequence[str] = ("match_id", "period"), length: float = 94.0,
                    basket: float = 5.25, players: int = 10) -> DataFrame:
    """Attack direction per period from frames with all players in one half.

    In such a frame the team nearer to that half's basket defends it. Input rows are players with
    ``side`` ('home' / 'away') and ``x`` in source units.
    """
    mid = length / 2
    fr = frames.groupBy(*by, "frame").agg(
        F.count(F.lit(1)).alias("n"), F.max("x").alias("hi"), F.min("x").alias("lo"),
        F.avg(F.when(F.col("side") == "home", F.abs(F.col("x") - basket))).alias("home_left"),
        F.avg(F.when(F.col("side") == "away", F.abs(F.col("x") - basket))).alias("away_left"),
        F.avg(F.when(F.col("side") == "home", F.abs(F.col("x") - (length - basket)))).alias("home_right"),
        F.avg(F.when(F.col("side") == "away", F.abs(F.col("x") - (length - basket)))).alias("away_right"))
    left, right = F.col("hi") < mid, F.col("lo") > mid
    home_offense = F.when(left, F.col("home_left") > F.col("away_left")) \
        .when(right, F.col("home_right") > F.col("away_right"))
    v = fr.filter((F.col("n") >= players) & (left | right)).withColumn("home_plus", home_offense == right)
    g = v.groupBy(*by).agg(F.count_if("home_plus").alias("plus"), F.count_if(~F.col("home_plus")).alias("minus"))
    return g.withColumns({
        "home_sign": F.when(F.col("plus") >= F.col("minus"), 1.0).otherwise(-1.0),
        "agreement": F.round(F.greatest("plus", "minus") / (F.col("plus") + F.col("minus")), 3)})


def agreement(df: DataFrame, by: Sequence[str], agrees: Column, threshold: float, strict: bool = True) -> DataFrame:
    """Share of rows that agree, with status validated / conflict."""
    g = df.groupBy(*by).agg(F.avg(agrees.cast("double")).alias("agreement"), F.count(F.lit(1)).alias("checked"))
    ok = F.col("agreement") > threshold if strict else F.col("agreement") >= threshold
    return g.withColumn("status", F.when(ok, "validated").otherwise("conflict"))


def infer_keeper(df: DataFrame, by: Sequence[str], label: str, x: str, order: str, first: int = 125) -> DataFrame:
    """Entity whose mean x over the first frames of the group is farthest from the centre (0.5).

    The first ``first`` frame numbers are found on distinct frames, so only those rows are averaged.
    """
    heads = ordered.top_k(df.select(*by, order).distinct(), by, [F.col(order).asc()], first).drop("rank")
    means = df.join(heads, [*by, order], "left_semi").filter(F.col(x).isNotNull()) \
        .groupBy(*by, label).agg(F.avg(x).alias("mean_x"))
    far = F.struct(F.abs(F.col("mean_x") - 0.5).alias("d"), F.col(label).alias("l"))
    return (means.groupBy(*by).agg(F.max_by(F.struct(label, "mean_x"), far).alias("k"))
            .select(*by, F.col(f"k.{label}").alias("keeper"), F.col("k.mean_x").alias("mean_x"),
                    F.when(F.col("k.mean_x") < 0.5, 1.0).otherwise(-1.0).alias("sign")))


def stat_pairs(stats: DataFrame, synonyms: Sequence[tuple[str, str]], game: str = "game_id", side: str = "side",
               name: str = "name", value: str = "value") -> DataFrame:
    """Home and away value per display name; the first synonym present in either side wins, missing is "0"."""
    show = F.create_map(*[F.lit(x) for api, disp in synonyms for x in (api, disp)])
    rank = F.create_map(*[F.lit(x) for i, (api, _) in enumerate(synonyms) for x in (api, i)])
    d = stats.withColumns({"stat": show[F.col(name)], "_p": rank[F.col(name)]}).filter(F.col("stat").isNotNull())
    per = d.groupBy(game, "stat", "_p").agg(
        F.max(F.when(F.col(side) == "home", F.col(value))).alias("home"),
        F.max(F.when(F.col(side) == "away", F.col(value))).alias("away"))
    return per.groupBy(game, "stat").agg(F.min_by(F.struct("home", "away"), "_p").alias("v")).select(
        game, "stat", F.coalesce("v.home", F.lit("0")).alias("home"), F.coalesce("v.away", F.lit("0")).alias("away"))


def catalog_rollup(assets: DataFrame) -> DataFrame:
    return assets.groupBy("source").agg(
        F.count(F.lit(1)).alias("assets"), F.sum("size_bytes").alias("bytes"),
        F.min("retrieved_at").alias("first_retrieved"), F.max("retrieved_at").alias("last_retrieved"),
        F.count("expected_checksum").alias("publisher_checksums"))


def play_summary(scored: DataFrame) -> DataFrame:
    """Per play: score, hits, accuracy, best streak (input is ``streak_score``)."""
    hit = F.col("quality") != "MISS"
    return (scored.groupBy("play_id").agg(
        F.sum("points").alias("score"), F.count(F.lit(1)).alias("total_notes"), F.count_if(hit).alias("total_hits"),
        F.count_if(F.col("quality") == "PERFECT").alias("perfect_hits"), F.max("streak").alias("max_streak"))
        .withColumn("accuracy", F.col("total_hits") / F.col("total_notes")))


def match_quality(frames: DataFrame, positions: DataFrame, roster: DataFrame, by: str = "match_id") -> DataFrame:
    """Frames without ball or players, detected share, and ids that the roster does not know."""
    f = frames.groupBy(by).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(~F.col("has_ball")).alias("frames_without_ball"),
        F.count_if(F.col("n_players") == 0).alias("frames_without_entities"))
    p = positions.groupBy(by).agg(F.avg(F.col("is_detected").cast("double")).alias("detected_fraction"))
    unknown = (positions.filter(F.col("entity_type") == "player").select(by, "entity_id").distinct()
               .join(roster.select(by, "entity_id"), [by, "entity_id"], "left_anti")
               .groupBy(by).agg(F.count(F.lit(1)).alias("unknown_ids")))
    return f.join(p, by, "left").join(unknown, by, "left").fillna({"unknown_ids": 0})


def presence_span(positions: DataFrame, by: Sequence[str], frame: str, x: str, y: str) -> DataFrame:
    seen = positions.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return seen.groupBy(*by).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))
