"""Column resolution, repair, pivots, nested data, validation rules and allow-listed filters."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_column(df: DataFrame, *names: str, contains: Sequence[str] = (), exclude: Sequence[str] = ()) -> str | None:
    """First column with one of ``names`` (any case), else the first whose name contains one of ``contains``."""
    low = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n.lower() in low:
            return low[n.lower()]
    for c in df.columns:
        if c.lower() not in {e.lower() for e in exclude} and any(p.lower() in c.lower() for p in contains):
            return c
    return None


def resolve_columns(df: DataFrame, spec: dict[str, dict], default_type: str = "string") -> DataFrame:
    """Select logical columns found by name or substring; a column that is absent becomes a typed null.

    ``spec``: logical name -> {"names": [...], "contains": [...], "type": "double"}.
    """
    out = []
    for logical, how in spec.items():
        found = find_column(df, *how.get("names", [logical]), contains=how.get("contains", ()),
                            exclude=how.get("exclude", ()))
        typ = how.get("type")
        col = F.lit(None).cast(typ or default_type) if found is None else F.col(f"`{found}`")
        out.append((col.try_cast(typ) if typ and found else col).alias(logical))
    return df.select(*out)


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def cast_void(df: DataFrame) -> DataFrame:
    """All-null columns without a type become string, so any sink can store them."""
    return df.select(*[F.col(f.name).cast("string") if isinstance(f.dataType, T.NullType) else F.col(f.name)
                       for f in df.schema.fields])


def fill_existing(df: DataFrame, values: dict) -> DataFrame:
    here = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(here) if here else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select, cast and order columns to the target schema; absent columns become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """As ``conform``, but a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return conform(df, schema)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "component",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def unpivot_tracking(df: DataFrame, ids: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``<label>_x, <label>_y`` pairs -> one row per label; rows with a missing coordinate are off the pitch."""
    pairs = F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"`{l}_x`").cast("double").alias("x"),
                               F.col(f"`{l}_y`").cast("double").alias("y")) for l in labels])
    return (df.select(*ids, F.explode(pairs).alias("p")).select(*ids, "p.*")
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
            .withColumn("entity_order", F.when(F.lower("label") == "ball", 0).otherwise(1)))


def pivot_team_seconds(df: DataFrame, keys: Sequence[str], team: str, teams: Sequence[str],
                       features: Sequence[str]) -> DataFrame:
    """One column per team and feature. The team list is given, so no extra job looks for it."""
    return df.groupBy(*keys).agg(*[
        F.avg(F.when(F.col(team) == t, F.col(f))).alias(f"{t}_{f}") for t in teams for f in features])


def explode_nonempty(df: DataFrame, array: str, alias: str, keep: Sequence = ()) -> DataFrame:
    return df.filter(F.size(array) > 0).select(*keep, F.explode(array).alias(alias))


def event_columns(df: DataFrame, e: str = "e") -> DataFrame:
    """Match events; a substitution has no single player but one in and one out."""
    sub = F.col(f"{e}.type") == "substitution"
    return df.withColumns({
        "event_type": F.col(f"{e}.type"), "minute": F.col(f"{e}.minute"),
        "player_name": F.when(sub, F.lit(None).cast("string")).otherwise(F.col(f"{e}.player")),
        "player_in": F.when(sub, F.col(f"{e}.playerIn")),
        "player_out": F.when(sub, F.col(f"{e}.playerOut")),
        "team": F.col(f"{e}.team")}).drop(e)


def apply_filters(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """``{"GP": (">=", 30)}``; rules on columns the frame lacks are skipped."""
    ops = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}
    for name, (op, v) in rules.items():
        if name in df.columns:
            df = df.filter(ops[op](F.col(name), F.lit(v)))
    return df


def every_nth(df: DataFrame, col: str, step: int) -> DataFrame:
    return df.filter(F.col(col) % step == 0)


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition is true, else null."""
    out = None
    for name, bad in rules:
        out = (F if out is None else out).when(bad, F.lit(name))
    return out


def attribute_by_key(df: DataFrame, key: str, left: str, right: str, have_left: str, have_right: str) -> DataFrame:
    """Fill ids that the payload lacks from a ``left|right`` message key."""
    k = F.col(key)
    from_key = F.instr(k, "|") > 0
    kl = F.when(from_key, F.substring_index(k, "|", 1))
    kr = F.when(from_key, k.substr(F.instr(k, "|") + 1, F.length(k)))
    return df.withColumns({
        left: F.coalesce(F.col(have_left), kl), right: F.coalesce(F.col(have_right), kr),
        "attributed_by_key": F.col(have_right).isNull() & F.coalesce(kr.isNotNull(), F.lit(False))})


def scoped(df: DataFrame, equal: dict, as_of: int | None = None, cut_col: str = "window_end_ms",
           allowed: dict[str, Sequence] | None = None) -> DataFrame:
    """Equality filters with allow-lists checked on the driver, and a hard time cutoff."""
    for c, v in equal.items():
        if v is None:
            continue
        if allowed and c in allowed and v not in allowed[c]:
            raise ValueError(f"{c}={v!r} is not allowed")
        df = df.filter(F.col(c) == F.lit(v))
    return df if as_of is None else df.filter(F.col(cut_col) <= F.lit(as_of))


def cursor_cutoff(df: DataFrame, cursors: DataFrame, by: Sequence[str], t: str, cursor: str,
                  t_to: int | None = None) -> DataFrame:
    """Rows at or before the processed cursor of their session; sessions without a cursor show nothing."""
    c = cursors.groupBy(*by).agg(F.max(cursor).alias("_cut"))
    if t_to is not None:
        c = c.withColumn("_cut", F.least("_cut", F.lit(t_to)))
    return df.join(c, list(by)).filter(F.col(t) <= F.col("_cut")).drop("_cut")


def redistributable_only(df: DataFrame, registry: DataFrame, key: str, flag: str = "redistributable") -> DataFrame:
    return df.join(registry.filter(F.col(flag)).select(key), key, "left_semi")
