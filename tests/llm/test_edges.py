"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""
from __future__ import annotations

import pytest

import corpus_pipeline
from touchline.llm import bpe, exact, kneser, lines, media, merkle, mix, ppm, secrets, simhash, simlong, token_files, tokens

LONG = "Anst on the rend " * 12_000 + "\nlast line"
TEXTS = [
    (1, "The cat sat on the mat and looked out of the window.", "en", "a"), (2, None, "en", "a"), (None, "The cat sat.", None, None),
    (3, "", "de", "b"), (4, " \t\r\n ", "de", "b"), (5, LONG, "en", "c"), (1, "The cat sat on the mat and looked out of the window.", "en", "a"),
    (6, "Ünï 中文 <|endoftext|> ''s\u0085 x \U0001f600", "fr", ""), (6, "another text of the same id", "fr", None), (None, None, None, "a"),
    (7, "password = \"abcdef0123456789abcdef01\"\nThe cat sat on the mat and looked out of the window.", "en", "b")]
# names that the operators use themselves
CLASH = "kept n_tokens row size copies perplexity lines target root node digest h key id".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, len(t[1] or ""), *["x"] * len(CLASH)) for t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (6, 1, None), (99, 1, 0)], LABELS)


def per_row(labels):
    return {
        "tokens": lambda d: tokens.count_tokens(d, tokens.production_path()), "simhash": simhash.classes, "lines": lines.dedup,
        "exact": exact.classes, "bpe": lambda d: bpe.round_trip(d, bpe.production_path()),
        "encode": lambda d: bpe.encode(d, bpe.production_path()), "ppm": lambda d: ppm.score(d, block_bytes=50_000), "secrets": secrets.scan,
        "kneser": lambda d: kneser.judged(d, labels), "media": media.digests, "mix": mix.plan,
        "merkle": merkle.tampered_proofs, "token_files": lambda d: token_files.round_trip(d, token_files.production_path())}


NAMES = ["tokens", "simhash", "lines", "exact", "bpe", "encode", "ppm", "secrets", "kneser", "media", "mix", "merkle", "token_files"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, docs, labels, name):
    run = per_row(labels)[name]
    out = run(docs)
    rows = out.collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == sorted(t[0] if t[0] is not None else -1 for t in TEXTS)
    empty = run(docs.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    if stage != "encode":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_no_labels_rejects_nothing(spark, docs):
    out = kneser.judged(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(TEXTS) and all(r["kept"] for r in out)


def test_empty_rows_have_the_stated_results(spark, docs, labels):
    of = lambda name: [r for r in per_row(labels)[name](docs).collect() if r["doc_id"] in (2, 3)]
    assert all((r["n_bytes"], r["n_tokens"], r["over_limit"]) == (0, 0, False) for r in of("tokens"))
    assert all(r["fingerprint"] == "0" * 16 and r["component_id"] == 2 for r in of("simhash"))
    assert all(r["keep_id"] == 2 and r["group_size"] == 3 for r in of("exact"))
    assert all(r["n_tokens"] == 1 for r in of("ppm"))
    assert all(r["spans"] == "" for r in of("secrets"))
    assert all(r["size"] == 0 and r["taken"] == 0 for r in of("mix"))
    assert all((r["n_bytes"], r["payload_bytes"]) == (0, 64) for r in of("media"))
    assert all((r["text"], r["n_lines"], r["n_kept"]) == ("", 0, 0) for r in of("lines"))
    assert all(r["n_tokens"] == 0 and r["same"] for r in of("bpe"))
    assert all(r["kept"] for r in of("kneser"))


def test_one_row_of_a_group_stays(spark, docs):
    rows = exact.classes(docs).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text_sha256"], []).append(r["kept"])
    assert all(sum(g) == 1 for g in groups.values())
    assert exact.dedup(docs).count() == len(groups)
    near = simhash.dedup(docs)
    # the two texts of id 6 are two components, each of which has it as its smallest id
    assert near.columns == docs.columns and near.count() == 1 + len({r["component_id"] for r in simhash.classes(docs).collect()})
    assert simlong.dedup(docs).count() <= len(groups)


def test_mix_emits_what_is_planned(spark, docs):
    planned = mix.plan(docs).collect()
    assert mix.mix(docs).count() == sum(r["copies"] for r in planned)
    assert all(r["taken"] <= 2 * r["size"] for r in planned)
