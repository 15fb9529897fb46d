"""Track index: tags, texts and vectors of analysed tracks, and the searches over it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import identity, music
from touchline.operators import vectors
from touchline.operators.joins import new_only
from touchline.sinks.tables import upsert


def describe(tracks: DataFrame) -> DataFrame:
    """Adds point id, tags, search text and summary. tracks: youtube_id, title, artist, features struct, sections."""
    f = lambda n: F.col(f"features.{n}")
    d = tracks.withColumns({
        "point_id": identity.stable_int_id("youtube_id"),
        "genre_tags": music.genre_tags(f("tempo_bpm"), f("spectral_centroid_mean"), f("energy_std"), f("onset_rate")),
        "mood_tags": music.mood_tags(f("spectral_centroid_mean"), f("energy_mean"), f("energy_std"), f("onset_rate"), "sections")})
    return d.withColumns({
        "search_text": music.search_text("title", f("tempo_bpm"), f("energy_mean"), f("spectral_centroid_mean"),
                                         f("duration_seconds"), f("onset_rate"), "sections", "genre_tags", "mood_tags"),
        "summary": music.summary("title", "artist", f("tempo_bpm"), f("duration_seconds"), "sections", "genre_tags", "mood_tags")})


def index(new: DataFrame, existing: DataFrame | None, order: str = "analyzed_at") -> DataFrame:
    """The index after adding tracks; a track analysed again replaces its old entry."""
    return upsert(describe(new), existing, ["youtube_id"], order)


def to_analyse(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    return new_only(candidates, existing, "youtube_id")


def search_text(idx: DataFrame, query: str, query_vec: Sequence[float], k: int = 5) -> DataFrame:
    f = lambda n: F.col(f"features.{n}")
    hits = vectors.vector_topk(idx, query_vec, "text_vec", k, 0.3, "youtube_id")
    return hits.withColumn("why", music.explain_text(query, "score", f("tempo_bpm"), f("energy_mean"), f("spectral_centroid_mean"),
                                                     "sections", "genre_tags", "mood_tags", "search_text"))


def search_similar(idx: DataFrame, track: dict, audio: Sequence[float], k: int = 5) -> DataFrame:
    """track: features of the query track (tempo_bpm, energy_mean, spectral_centroid_mean)."""
    return _why(vectors.vector_topk(idx, audio, "audio", k, 0.3, "youtube_id"), track)


def search_refined(idx: DataFrame, track: dict, audio: Sequence[float], text: Sequence[float], k: int = 5) -> DataFrame:
    return _why(vectors.rerank(idx, audio, text, k, "youtube_id"), track)


def _why(hits: DataFrame, track: dict) -> DataFrame:
    q = lambda n: F.lit(float(track.get(n, 0.0)))
    f = lambda n: F.col(f"features.{n}")
    return hits.withColumn("why", music.explain_delta(
        f("tempo_bpm"), q("tempo_bpm"), f("energy_mean"), q("energy_mean"), f("spectral_centroid_mean"),
        q("spectral_centroid_mean"), "genre_tags"))


def list_tracks(idx: DataFrame, limit: int = 100) -> DataFrame:
    return idx.select("point_id", "youtube_id", "title").orderBy("point_id").limit(limit)


def get_track(idx: DataFrame, youtube_id: str) -> DataFrame:
    return idx.filter(F.col("point_id") == identity.stable_int_id(F.lit(youtube_id)))
