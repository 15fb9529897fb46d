"""Names, team codes, seasons and canonical ids as native columns."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name suffixes, in the order they are removed
NAME_SUFFIXES = [" jr.", " jr", " sr.", " sr", " iii", " ii", " iv"]

# Variant team code -> canonical code
TEAM_CODES = {
    "NJN": "BKN", "NJ": "BKN", "BRK": "BKN",
    "NOH": "NOP", "NOK": "NOP", "NO": "NOP",
    "SEA": "OKC",
    "VAN": "MEM",
    "CHA": "CHO",
    "CHH": "CHO",
    "WSB": "WAS", "WSH": "WAS",
    "PHO": "PHX",
    "SAN": "SAS", "SA": "SAS",
    "GS": "GSW",
    "NY": "NYK",
    "NO/OK": "NOP",
    "UTAH": "UTA",
}


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose into one base letter plus marks, found from the Unicode data itself."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _accent_table()


def strip_accents(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    # ASCII text, one byte a character, has nothing to strip
    return F.when(F.octet_length(c) != F.length(c), F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}", "")).otherwise(c)


@F.pandas_udf(T.StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    """Full compatibility decomposition for scripts outside the Latin blocks; Arrow batches, opt-in."""
    return s.map(lambda v: None if v is None else "".join(
        c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def _trimmed(c: Column) -> Column:
    r"""Without the white space of ``\s`` at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_name(col, full_unicode: bool = False) -> Column:
    """Lower case, no accents, no suffix, only ``[a-z0-9 ]``; null becomes the empty string.

    Only names that end in a suffix, or hold another character, go through the replacements.
    """
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    c = _trimmed(F.lower(nfkd_fold(c) if full_unicode else strip_accents(c)))
    cut = c
    for suffix in NAME_SUFFIXES:
        cut = _trimmed(F.regexp_replace(cut, re.escape(suffix) + r"\z", ""))
    c = F.when(c.rlike("(?:" + "|".join(map(re.escape, NAME_SUFFIXES)) + r")\z"), cut).otherwise(c)
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9 ]", ""), " +", " "))
    return F.when(c.rlike("[^a-z0-9 ]|  "), plain).otherwise(c)


def normalize_team(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    code = F.upper(_strip(c))
    table = F.create_map(*[F.lit(x) for kv in TEAM_CODES.items() for x in kv])
    return F.when(c.isNull() | (c == ""), "UNK").otherwise(F.coalesce(table[code], code))


def normalize_season(col) -> Column:
    """``2023``, ``2023-2024`` and ``2023-24`` all become ``2023-24``; other text stays."""
    c = _strip(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")))
    next_year = F.lpad(((F.substring(c, 1, 4).try_cast("int") + 1) % 100).cast("string"), 2, "0")
    return (F.when(c.rlike(r"^\d{4}-\d{2}$"), c)
            .when(c.rlike(r"^\d{4}$"), F.concat_ws("-", F.substring(c, 1, 4), next_year))
            .when(c.rlike(r"^\d{4}-\d{4}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 8, 2)))
            .otherwise(c))


def season_from_any(col) -> Column:
    """Season from a number kept as text (``2023.0``); text that already has a dash stays."""
    c = _strip((F.col(col) if isinstance(col, str) else col).cast("string"))
    year = c.try_cast("double").try_cast("bigint")
    short = F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    return (F.when(c.contains("-") & (F.length(c) >= 5), c)
            .when(year.isNotNull(), F.concat_ws("-", year.cast("string"), short)).otherwise(c))


def _number_id(prefix: str, col, zero_is_empty: bool) -> Column:
    c = _strip((F.col(col) if isinstance(col, str) else col).cast("string"))
    num = c.try_cast("bigint")
    empty = c.isNull() | (c == "") | ((c == "0") if zero_is_empty else F.lit(False))
    # text that is not a number gives null, so the caller can count and quarantine it
    return F.when(empty, "").when(num.isNotNull(), F.concat(F.lit(prefix), num.cast("string")))


def player_id(col) -> Column:
    return _number_id("P", col, zero_is_empty=False)


def team_id(col) -> Column:
    return _number_id("T", col, zero_is_empty=True)


def team_id_from_code(col) -> Column:
    return F.concat(F.lit("TA"), normalize_team(col))


def season_id(col) -> Column:
    s = normalize_season(col)
    return F.when(s == "", "").otherwise(F.concat(F.lit("S"), s))


def game_id(col) -> Column:
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(c.isNull() | (c == ""), "").otherwise(F.concat(F.lit("G"), _strip(c)))


def hash_player_id(name, team, season) -> Column:
    key = F.concat_ws("|", normalize_name(name), normalize_team(team), normalize_season(season))
    return F.concat(F.lit("PX"), F.substring(F.md5(key), 1, 10))


def stable_int_id(col) -> Column:
    """First 8 bytes of SHA-256 as an integer without its top bit."""
    h = F.sha2((F.col(col) if isinstance(col, str) else col).cast("string"), 256)
    top = F.conv(F.substring(h, 1, 1), 16, 10).cast("bigint") % 8
    low = F.conv(F.substring(h, 2, 15), 16, 10).cast("bigint")
    return top * F.lit(2**60) + low


def ns_id(source: str, kind: str, col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(f"{source}:{kind}:"), c.cast("string"))


def valid_id(col, pattern: str = r"^[A-Za-z0-9:_.\-]{1,128}$") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & c.rlike(pattern)


def video_id(col) -> Column:
    """11-character video id from the usual URL forms, or the bare id; null when absent."""
    c = F.col(col) if isinstance(col, str) else col
    forms = r"(?:youtu\.be/|youtube\.com/(?:watch\?v=|embed/|shorts/|v/))([a-zA-Z0-9_-]{11})"
    return F.coalesce(F.nullif(F.regexp_extract(c, forms, 1), F.lit("")),
                      F.nullif(F.regexp_extract(c, r"^([a-zA-Z0-9_-]{11})$", 1), F.lit("")))
