"""Tags, templates and explanations for audio tracks; vector arithmetic on array columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.parsing import overlap, tokens

# Overlapping tempo bands, low <= bpm < high
TEMPO_BANDS = [
    (90, 110, "downtempo"),
    (110, 125, "deep house"),
    (120, 130, "house"),
    (125, 135, "tech house"),
    (130, 145, "techno"),
    (140, 155, "trance"),
    (150, 180, "drum and bass"),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _list(*items: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*items)))


def band_tags(value, bands=TEMPO_BANDS) -> Column:
    """Every band that holds the value, in band order. The band table is a short literal."""
    v = _c(value)
    return F.array_compact(F.array(*[F.when((v >= lo) & (v < hi), F.lit(name)) for lo, hi, name in bands]))


def genre_tags(bpm, centroid, energy_std, onset) -> Column:
    c, s, o = _c(centroid), _c(energy_std), _c(onset)
    rest = _list(F.when(c < 1500, F.lit("dark")).when(c > 3000, F.lit("bright")),
                 F.when(s > 0.05, F.lit("dynamic")).otherwise(F.lit("hypnotic")),
                 F.when(o > 6, F.lit("percussive")).when(o < 2, F.lit("minimal")))
    return F.array_distinct(F.concat(band_tags(bpm), rest))


def _first_intro_s(sections) -> Column:
    intro = F.element_at(F.filter(_c(sections), lambda s: s["label"] == "intro"), 1)
    return F.when(F.exists(_c(sections), lambda s: s["label"] == "intro"), intro["end_sec"] - intro["start_sec"])


def mood_tags(centroid, energy_mean, energy_std, onset, sections) -> Column:
    c, e, s, o, sec = _c(centroid), _c(energy_mean), _c(energy_std), _c(onset), _c(sections)
    has = lambda label: F.exists(sec, lambda x: x["label"] == label)
    return _list(
        F.when(c < 1500, F.lit("dark")).when(c > 3000, F.lit("bright")).otherwise(F.lit("balanced")),
        F.when(c < 1500, F.lit("atmospheric")).when(c > 3000, F.lit("energetic")),
        F.when(e > 0.08, F.lit("driving")).when(e < 0.03, F.lit("subtle")),
        F.when(s < 0.03, F.lit("hypnotic")).otherwise(F.lit("dynamic")),
        F.when(_first_intro_s(sec) >= 45, F.lit("long-intro")),
        F.when(has("drop"), F.lit("peak-time")),
        F.when(has("breakdown"), F.lit("breakdowns")),
        F.when(o > 6, F.lit("percussive")).when(o < 2, F.lit("minimal")))


def _whole(c: Column) -> Column:
    return F.format_string("%.0f", F.bround(c.cast("double"), 0))


def _or(items, default: str) -> Column:
    return F.when(F.size(_c(items)) > 0, F.array_join(_c(items), ", ")).otherwise(F.lit(default))


def search_text(title, bpm, energy, centroid, duration, onset, sections, genres, moods) -> Column:
    """Keyword text used for text search."""
    e, c, o = _c(energy), _c(centroid), _c(onset)
    tone = (F.when(c < 1500, "dark, low spectral energy").when(c > 3000, "bright, high spectral energy")
            .otherwise("mid-range spectral balance"))
    level = F.when(e > 0.08, "high energy").when(e < 0.03, "low energy").otherwise("moderate energy")
    rhythm = (F.when(o > 6, "percussive, high onset density").when(o < 2, "sparse, minimal rhythm")
              .otherwise("steady rhythmic pulse"))
    parts = F.transform(_c(sections), lambda s: F.concat(
        s["label"], F.lit(" ("), s["energy_level"], F.lit(", "), _whole(s["end_sec"] - s["start_sec"]), F.lit("s)")))
    return F.concat(
        _c(title), F.lit(": "), _or(genres, "electronic"), F.lit(" track at "), _whole(_c(bpm)), F.lit(" BPM with "),
        level, F.lit(" and "), tone, F.lit(". Rhythm is "), rhythm, F.lit(". Duration "), _whole(_c(duration)),
        F.lit(" seconds. Structure: "), _or(parts, "unstructured"), F.lit(". Mood: "), _or(moods, "atmospheric"),
        F.lit(". Electronic dance music suitable for DJ sets."))


def summary(title, artist, bpm, duration, sections, genres, moods) -> Column:
    g, m = _or(genres, "electronic"), _or(moods, "atmospheric")
    flow = F.array_join(F.transform(_c(sections), lambda s: s["label"]), " → ")
    intro = F.coalesce(_first_intro_s(sections), F.lit(0.0))
    return F.concat(
        F.lit('"'), _c(title), F.lit('" by '), F.coalesce(F.nullif(_c(artist), F.lit("")), F.lit("Unknown")),
        F.lit(" is a "), _whole(_c(bpm)), F.lit(" BPM "), g, F.lit(" track ("), _whole(_c(duration)),
        F.lit("s) with a "), m, F.lit(" character."),
        F.when(intro >= 20, F.concat(F.lit(" It opens with a "), _whole(intro), F.lit("s intro,"))).otherwise(F.lit("")),
        F.lit(" Energy flow: "), F.when(flow == "", "flat").otherwise(flow),
        F.lit(". Use it where "), g, F.lit(" and "), m, F.lit(" vibes fit the set."))


def explain_delta(bpm, q_bpm, energy, q_energy, centroid, q_centroid, genres=None) -> Column:
    """How a hit differs from the query track, as text."""
    b, qb = _c(bpm), _c(q_bpm)
    gap = F.abs(b - qb)
    sign = F.when(F.bround(b - qb) < 0, F.lit("")).otherwise(F.lit("+"))
    tempo = (F.when(gap <= 3, F.concat(F.lit("near-identical tempo ("), _whole(b), F.lit(" BPM)")))
             .when(gap <= 8, F.concat(F.lit("close tempo ("), _whole(b), F.lit(" vs "), _whole(qb), F.lit(" BPM)")))
             .otherwise(F.concat(F.lit("tempo offset "), sign, _whole(b - qb), F.lit(" BPM"))))
    level = (F.when(F.abs(_c(energy) - _c(q_energy)) < 0.02, "similar energy")
             .when(_c(energy) > _c(q_energy), "higher energy").otherwise("lower energy"))
    tone = (F.when(F.abs(_c(centroid) - _c(q_centroid)) < 400, "similar brightness")
            .when(_c(centroid) < _c(q_centroid), "darker tone").otherwise("brighter tone"))
    parts = [tempo, level, tone]
    if genres is not None:
        parts.append(F.when(F.size(_c(genres)) > 0,
                            F.concat(F.lit("tags: "), F.array_join(F.slice(_c(genres), 1, 3), ", "))))
    return F.concat_ws("; ", *parts)


def explain_text(query: str, score, bpm, energy, centroid, sections, genres, moods, text) -> Column:
    """Why a track matches a free-text query."""
    import re

    words = re.findall(r"[a-z0-9]+", query.lower())
    has = lambda *ws: F.lit(any(w in words for w in ws))
    q = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    pool = tokens(F.concat_ws(" ", _c(genres), _c(moods), _c(text)))
    hits = F.slice(overlap(q, pool), 1, 6)
    intro = _first_intro_s(sections)
    reasons = F.array_compact(F.array(
        F.when(F.size(hits) > 0, F.concat(F.lit("matches terms: "), F.array_join(hits, ", "))),
        F.when(has("techno", "house", "trance", "bass") & (_c(bpm) != 0),
               F.concat(_whole(_c(bpm)), F.lit(" BPM aligns with the genre cue"))),
        F.when(has("intro", "long") & intro.isNotNull(), F.concat(F.lit("intro lasts "), _whole(intro), F.lit("s"))),
        F.when(has("dark") & (_c(centroid) < 2000), F.lit("darker spectral profile")),
        F.when(has("bass", "strong") & (_c(energy) > 0.04), F.lit("solid low-end energy")),
        F.when(has("minimal") & F.array_contains(F.concat(_c(moods), _c(genres)), "minimal"), F.lit("tagged minimal")),
        F.when(has("hypnotic") & F.array_contains(_c(moods), "hypnotic"), F.lit("hypnotic energy curve"))))
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(
        F.concat(F.lit("semantic text similarity ("), F.format_string("%.3f", _c(score).cast("double")), F.lit(")")))


def dot(a, b) -> Column:
    """Dot product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)) \
        .otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def cosine(a, b) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)
