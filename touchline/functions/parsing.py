"""Clocks, money, score text, minutes, event types, JSON fields."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_money(col) -> Column:
    return F.trim(F.regexp_replace(_c(col).cast("string"), r"[$,]", "")).try_cast("double")


def parse_clock(col, kind: str) -> Column:
    """Clock text to seconds (``mmss``, ``iso``; -1 when unreadable) or milliseconds (``hms``; null)."""
    c = F.trim(_c(col).cast("string"))
    if kind == "mmss":                       # "5:30" or "17.4"
        m, s = F.split_part(c, F.lit(":"), F.lit(1)), F.split_part(c, F.lit(":"), F.lit(2))
        secs = F.when(c.contains(":"), m.try_cast("int") * 60 + s.try_cast("double")).otherwise(c.try_cast("double"))
        return F.coalesce(secs, F.lit(-1.0))
    if kind == "iso":                        # "PT05M30.00S"
        body = F.regexp_replace(c, "PT|S", "")
        m, s = F.split_part(body, F.lit("M"), F.lit(1)), F.split_part(body, F.lit("M"), F.lit(2))
        secs = m.try_cast("int") * 60 + F.when(body.contains("M"), s.try_cast("double")).otherwise(F.lit(0.0))
        return F.coalesce(secs, F.lit(-1.0))
    if kind == "hms":                        # "00:12:34.50"
        part = [F.split_part(c, F.lit(":"), F.lit(i)) for i in (1, 2, 3)]
        secs = part[0].try_cast("int") * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("double")
        return F.round(secs * 1000).cast("bigint")
    raise ValueError(f"unknown clock kind {kind!r}")


def clock_m_ss(seconds) -> Column:
    """``M:SS`` from whole or fractional seconds."""
    s = F.floor(_c(seconds)).cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), s % 60)


def clock_from_iso(col) -> Column:
    """``PT05M30.00S`` -> ``5:30``; text in another form stays."""
    secs = parse_clock(col, "iso")
    return F.when(secs < 0, _c(col)).otherwise(clock_m_ss(secs))


def clock_from_ms(ms) -> Column:
    return F.coalesce(clock_m_ss(F.floor(_c(ms) / 1000)), F.lit("–"))


def clock_mm_ss_cc(seconds) -> Column:
    """``MM:SS.ss`` remaining-clock text; null stays null."""
    s = _c(seconds).cast("double")
    m = F.floor(s / 60).cast("bigint")
    return F.when(s.isNotNull(), F.format_string("%02d:%05.2f", m, s - m * 60))


def elapsed_game_ms(period, remaining_s) -> Column:
    """Game time since tip-off: four 720 s periods, then 300 s overtimes."""
    p = _c(period)
    length = F.when(p <= 4, 720).otherwise(300)
    before = F.when(p <= 4, (p - 1) * 720).otherwise(2880 + (p - 5) * 300)
    return (before * 1000 + F.bround((length - _c(remaining_s)) * 1000).cast("bigint")).cast("bigint")


def parse_score(score, margin=None) -> Column:
    """``"visitor - home"`` -> struct(home, away, conflict). ``conflict`` marks a margin that disagrees."""
    c = F.trim(_c(score))
    away = F.split_part(c, F.lit(" - "), F.lit(1)).try_cast("int")
    home = F.split_part(c, F.lit(" - "), F.lit(2)).try_cast("int")
    ok = c.contains(" - ")
    home, away = F.when(ok, home), F.when(ok, away)
    if margin is None:
        bad = F.lit(False)
    else:
        m = F.trim(F.coalesce(_c(margin).cast("string"), F.lit("")))
        bad = F.coalesce(ok & (m != "") & (m != "TIE") & (m.try_cast("int") != home - away), F.lit(False))
    return F.struct(home.alias("home"), away.alias("away"), bad.alias("conflict"))


def parse_minute(text, seconds=None) -> Column:
    """``45'+2'`` -> 45; when the text has no number, whole minutes of ``seconds``."""
    head = F.regexp_extract(F.regexp_replace(_c(text), r"^'+|'+$", ""), r"^\s*(\d+)\s*'?\s*(?:[+:].*)?$", 1)
    m = F.nullif(head, F.lit("")).try_cast("int")
    if seconds is None:
        return m
    s = _c(seconds).try_cast("double")
    return F.coalesce(m, F.when(s != 0, F.floor(s / 60).cast("int")))


def classify_event(col) -> Column:
    """Event kind by the first matching word; null when the text names none."""
    t = F.lower(_c(col))
    return (F.when(t.contains("goal"), "goal")
            .when(t.contains("yellow") & ~t.contains("red"), "yellow_card")
            .when(t.contains("red"), "red_card")
            .when(t.contains("substitution"), "substitution"))


def scorer_name(type_text, player) -> Column:
    """Player name with ``(OG)`` after own goals."""
    own = F.lower(_c(type_text)).contains("own goal")
    return F.when(own, F.concat(_c(player), F.lit(" (OG)"))).otherwise(_c(player))


def fmt_shooting(made, att, pct) -> Column:
    m, a = _c(made).cast("bigint"), _c(att).cast("bigint")
    return F.when(a != 0, F.format_string("%d/%d (%.1f%%)", m, a, _c(pct).cast("double"))) \
        .otherwise(F.format_string("%d/%d", m, a))


def json_num(col, path: str) -> Column:
    return F.get_json_object(_c(col), path).try_cast("double")


def to_json_cols(df):
    """Struct, array and map columns become JSON text; other columns stay."""
    from pyspark.sql import types as T

    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema.fields])


def safe_round(col, digits: int = 4) -> Column:
    """Half-even rounding; NaN and infinities become null."""
    c = _c(col).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, F.bround(c, digits))


def join_flags(**conditions: Column) -> Column:
    """Names of the true conditions, comma separated, in the order given."""
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])))


def split_flags(col) -> Column:
    return F.filter(F.split(F.coalesce(_c(col), F.lit("")), ","), lambda x: x != "")


def tokens(col) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(r"([a-z0-9]+)"), 1)


def overlap(a, b) -> Column:
    """Tokens of ``a`` also found in ``b``, in order, repeats kept."""
    other = _c(b)
    return F.filter(_c(a), lambda x: F.array_contains(other, x))


def parse_lrc(df, text: str = "text", keep=()):
    """Lyrics documents with ``[mm:ss.xx] words`` lines -> one row per line with words."""
    rx = r"\[(\d{2}):(\d{2})\.(\d{2,3})\]\s*(.*)"
    line = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)(\[\d{2}:\d{2}\.\d{2,3}\].*)"), 1))
    rows = df.select(*keep, line.alias("_line"))
    part = lambda i: F.regexp_extract("_line", rx, i)
    frac = F.rpad(part(3), 3, "0").cast("bigint")
    return (rows.select(*keep, (part(1).cast("bigint") * 60000 + part(2).cast("bigint") * 1000 + frac).alias("time_ms"),
                        F.trim(part(4)).alias("words"))
            .filter(F.col("words") != ""))


# Pieces removed from a video title, in order
TITLE_NOISE = [
    r"\(official\s*(music\s*)?video\)", r"\(official\s*audio\)", r"\(lyric\s*video\)", r"\(lyrics?\)",
    r"\(live\)", r"\(audio\)", r"\[official\s*(music\s*)?video\]", r"\[.*?\]",
    r"\bft\.?\s+", r"\bfeat\.?\s+", r"\bhd\b", r"\bremastered\b", r"\b\d{4}\b", r"[|]",
]


def clean_title(col) -> Column:
    c = _c(col)
    for rx in TITLE_NOISE:
        c = F.regexp_replace(c, "(?i)" + rx, "")
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


def split_artist(col) -> Column:
    """``artist - title`` -> struct; null when there is no separator after the first character."""
    c = _c(col)
    at = F.instr(c, " - ")
    return F.when(at > 1, F.struct(F.trim(c.substr(F.lit(1), at - 1)).alias("artist"),
                                   F.trim(c.substr(at + 3, F.length(c))).alias("title")))
