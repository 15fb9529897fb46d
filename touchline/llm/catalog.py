"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import exact, merkle, mix, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_token_counts")
def op1(spark, sf_dir):
    from touchline.llm import tokens

    return tokens.count_tokens(documents(spark, sf_dir), tokens.production_path())


@query("op2_simhash_pigeonring")
def op2(spark, sf_dir):
    from touchline.llm import simhash

    return simhash.classes(documents(spark, sf_dir))


@query("op3_fuzzy_lines")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    from touchline.llm import lines

    return lines.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


@query("op4_patricia_exact", exact.SQL)
def op4(spark, sf_dir):
    return exact.classes(documents(spark, sf_dir))


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    from touchline.llm import bpe

    return bpe.round_trip(documents(spark, sf_dir), bpe.production_path())


@query("op6_ppm_scores")
def op6(spark, sf_dir):
    from touchline.llm import ppm

    return ppm.score(documents(spark, sf_dir))


@query("op7_trigram_secrets", secrets.SQL)
def op7(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


@query("op8_kneser_ney_quality")
def op8(spark, sf_dir):
    from touchline.llm import kneser

    return kneser.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_webp_media")
def op9(spark, sf_dir):
    from touchline.llm import media

    return media.digests(documents(spark, sf_dir))


@query("op10_systematic_mix", mix.SQL)
def op10(spark, sf_dir):
    return mix.plan(documents(spark, sf_dir)).drop("row_hash")


@query("op11_whitening")
def op11(spark, sf_dir):
    from touchline.llm import whiten

    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark, sf_dir):
    return merkle.tampered_proofs(documents(spark, sf_dir))


@query("op13_rans_tokens")
def op13(spark, sf_dir):
    from touchline.llm import token_files

    return token_files.round_trip(documents(spark, sf_dir), token_files.production_path())
