"""Similar moments of a match and how well their neighbours agree on possession."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scoring import with_stats, zscore
from touchline.operators import vectors
from touchline.operators.aggregates import interpolated_quantiles
from touchline.operators.windows import moment_vectors

# Fixed values
WINDOW_S, STEP_S, EXCLUDE_S, MIN_SECONDS, MIN_LABELS = 10, 2, 30, 8, 20
SOCCER_FEATURES = ["width_m", "depth_m", "hull_area_m2", "def_line_height_m", "centroid_x"]
BASKETBALL_FEATURES = ["width_m", "depth_m", "hull_area_m2", "centroid_x", "spacing_hull_m2", "mean_pairwise_m",
                       "paint_count", "corner_count"]


def usable_features(sec: DataFrame, features: Sequence[str]) -> list[str]:
    """Features known in more than half of the rows (one small aggregate)."""
    row = sec.agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] > 0.5]


def build_index(team_sec: DataFrame, match: Sequence[str], teams: Sequence[str], features: Sequence[str],
                team: str = "team_id") -> DataFrame:
    """One row per anchor: id, time, possession label and the z-scored vector ``vec``.

    team_sec: match keys, period, sec, team, t_ms, features, poss_share.
    """
    cols = [*features, "poss_share"]
    wide = team_sec.groupBy(*match, "period", "sec").agg(
        F.min("t_ms").alias("t_ms"),
        *[F.avg(F.when(F.col(team) == t, F.col(c))).alias(f"{t}_{c}") for t in teams for c in cols])
    feats = [f"{t}_{c}" for t in teams for c in features]
    m = moment_vectors(wide, match, feats, WINDOW_S, STEP_S, MIN_SECONDS, teams=teams, poss=True)
    parts = [f"{f}__{kind}" for f in feats for kind in ("mean", "trend")]
    z = zscore(m, {p: f"z_{p}" for p in parts}, match)
    z = z.withColumn("vec", F.array(*[F.col(f"z_{p}") for p in parts])).drop(*[f"z_{p}" for p in parts])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in match], F.col("period").cast("string"), F.col("anchor").cast("string"))
    return z.withColumn("mkey", F.concat_ws("|", *[F.col(c).cast("string") for c in match])).withColumn(
        "moment_id", F.xxhash64(key))


def neighbours(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Up to ``k`` neighbours per query moment, none within the exclusion of the query or of each other."""
    pool = vectors.pool_size(k, EXCLUDE_S, STEP_S) + 2 * EXCLUDE_S // STEP_S
    near = vectors.knn_join(
        queries.select(F.col("moment_id").alias("qid"), "mkey", "vec"),
        index.select(F.col("moment_id").alias("cid"), "mkey", "vec"), pool, by="mkey")
    side = lambda p, i: index.select(F.col("moment_id").alias(i), F.col("period").alias(f"{p}_period"), F.col("anchor").alias(f"{p}_sec"))
    near = near.drop("rank").join(side("q", "qid"), "qid").join(side("c", "cid"), "cid")
    local = (F.col("q_period") == F.col("c_period")) & (F.abs(F.col("q_sec") - F.col("c_sec")) < EXCLUDE_S)
    return vectors.suppress(near.filter(~local), ["qid"], "distance", "c_period", "c_sec", "cid", k, EXCLUDE_S)


def similar_moments(index: DataFrame, at: dict, t_ms: int, k: int = 5) -> DataFrame:
    """Moments most like the one at or just before ``t_ms`` (else the first); similarity is exp(-distance / median spread).

    A match without moments gives no rows. Anchor, centre and spread are columns of the plan.
    """
    m = index
    for c, v in at.items():
        m = m.filter(F.col(c) == F.lit(v))
    timed = with_stats(m, [], _at=F.coalesce(F.max(F.when(F.col("t_ms") <= t_ms, F.col("t_ms"))), F.min("t_ms")))
    near = neighbours(m, timed.filter(F.col("t_ms") == F.col("_at")).drop("_at"), k)
    # vectors are centred, so the spread of a moment is the length of its vector minus the small mean left over
    part = m.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))
    centre = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))
    length = F.sqrt(F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    spread = m.select(F.lit(1).alias("one"), "vec").join(F.broadcast(centre.withColumn("one", F.lit(1))), "one").select(length.alias("s"))
    scale = interpolated_quantiles(spread, "s", {"scale": 0.5}).select(
        F.lit(1).alias("one"), F.coalesce(F.nullif("scale", F.lit(0.0)), F.lit(1.0)).alias("scale"))
    info = m.select(F.col("moment_id").alias("cid"), "t_ms", "period", "label")
    found = near.join(info, "cid").withColumn("one", F.lit(1)).join(F.broadcast(scale), "one")
    return found.select("rank", "t_ms", "period", "label", F.round("distance", 3).alias("distance"),
                        F.round(F.exp(-F.col("distance") / F.col("scale")), 3).alias("similarity"))


def lift(index: DataFrame, k: int = 5, circular: bool = False) -> DataFrame:
    """Per match: share of neighbours with the query's label over the chance that two random labels agree."""
    lab = index.filter(F.col("label").isNotNull())
    counts = lab.groupBy("mkey", "label").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("mkey").agg(F.sum("n").alias("labelled"), F.sum(F.col("n") * F.col("n")).alias("_sq"))
    base = tot.withColumn("random_baseline", F.col("_sq") / (F.col("labelled") * F.col("labelled"))).drop("_sq")
    near = neighbours(index, lab, k * 3)
    lq = lab.select(F.col("moment_id").alias("qid"), "mkey", F.col("label").alias("ql"))
    lc = lab.select(F.col("moment_id").alias("cid"), F.col("label").alias("cl"))
    from touchline.operators.ordered import top_k
    hits = top_k(near.join(lq, "qid").join(lc, "cid"), ["qid"], [F.asc("rank")], k, "_r")
    prec = hits.groupBy("mkey").agg(F.avg((F.col("ql") == F.col("cl")).cast("double")).alias("precision"))
    out = base.join(prec, "mkey", "left")
    few = F.col("labelled") < MIN_LABELS
    return out.select(
        "mkey", "labelled", F.when(few, "insufficient_labels").otherwise("ok").alias("status"),
        F.when(~few, F.round("precision", 3)).alias("precision_same_possession"),
        F.when(~few, F.round("random_baseline", 3)).alias("random_baseline"),
        F.when(~few, F.round(F.coalesce("precision", F.lit(0.0)) / F.col("random_baseline"), 3)).alias("lift"),
        F.lit(not circular).alias("valid_evidence"))
