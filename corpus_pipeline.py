"""The corpus pipeline: low-quality documents go, copies are folded exactly and nearly, sources are mixed, texts encoded.

Each stage takes the documents its predecessor kept and returns documents; the last returns what encoding found. A
stage is written as Parquet in the shared folder and read again, so a lost executor costs at most one stage's work.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, exact, kneser, mix, simlong
from touchline.llm.util import drop_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject; it is fitted on this run's labels.

    Null and empty texts and texts at the very limit stay, each repeated row is judged alike, texts of any length are scored whole.
    """
    return kneser.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the smallest id, null ids last; null and empty texts are equal. Of rows that repeat both any one stays."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8, over whole texts of any length.

    That of the smallest id, null ids last; texts without a word are one group.
    """
    return simlong.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, at most twice; a null source is one of its own. Runs agree."""
    return mix.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every mixed row's ids, counted and digested, and decoded again; a null text counts as empty, long ones are encoded whole.

    Every stage carries columns of any name along, but this last one, and gives no rows for an empty table.
    """
    return bpe.round_trip(docs, bpe.production_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mixed), ("encode", encoded)]

# the classifier, the fingerprints and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(docs)
        docs = after
    return docs
