"""Token files against the library, exact round trips of the coder, and damaged files."""
from __future__ import annotations

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import rans, token_files
from touchline.llm.tokens import load
from touchline.llm.util import written

PATH = token_files.production_path()
ODD = ["", "a\x1cb c", "A\u0085b c d　e᠎f", "It's  we'll\tGO\n\n'S", "<|endoftext|>x <|startoftext|>", "ΑΣ ΟΔΟΣ. Σ", "é ́x e ́",
       "中文 字 한국어 ไทย", "\U0001f600\U0001f468‍\U0001f469", "x" * 5000 + " y", "ﬁ ½ ² Ⅷ İI", "\x00 \x1f﻿", "1234567 12,5", "é" * 300 + "\n" + "a " * 4000]


def ids_of(texts):
    t = load(PATH)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_words_alone_give_the_librarys_ids(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] or "" for r in rows] + ODD + [" ".join(ODD)]
    texts += ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x2100, 64)] + [f"Don't {chr(c)}we'LL{chr(c)}x{chr(c)}" for c in range(1, 0x2100)]
    words = token_files.WordEncoder(PATH)
    assert words.merges is not None
    assert [words(t).tolist() + [1] for t in texts] == ids_of(texts)


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 90)
    texts = [" ".join(f"w{(i * j) % 23}é{'x' * (j % 90)}" for j in range(12)) for i in range(60)] + ODD
    words = token_files.WordEncoder(PATH)
    got = [b.tolist() + [1] for a in range(0, len(texts), 7) for b in words.many(pa.array(texts[a:a + 7]))]
    assert got == ids_of(texts)


def test_rows_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "again"), (3, "again"), (-2, None)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, n long").repartition(7)
    got = sorted([tuple(r) for r in token_files.round_trip(df, PATH).collect()], key=lambda r: r[1])
    ids = ids_of([t for _, t in rows])
    want = sorted((d if d is not None else -1 << 62, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids))
    assert sorted((d if d is not None else -1 << 62, n, c) for d, _, n, c in got) == want
    order = [d if d is not None else -1 << 62 for d, *_ in got]
    assert order == sorted(order)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_empty_tables_and_no_end_id(spark):
    df = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert token_files.round_trip(df.limit(0), PATH).collect() == []
    assert sorted(tuple(r) for r in token_files.round_trip(df, PATH, end=None).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert sorted(tuple(r) for r in token_files.round_trip(df, PATH).collect())[0][2] == 1


def test_ids_come_back_from_many_blocks_and_files(spark, tmp_path):
    texts = [(i, f"row {i} " + "word next " * (i % 37)) for i in range(500)]
    tokens = written(token_files.encode(spark.createDataFrame(texts, "doc_id long, text string"), PATH), "t")
    token_files.write(tokens, f"{tmp_path}/f", "<u2", block_ids=300, blocks_a_file=3)
    assert len(glob.glob(f"{tmp_path}/f/blocks/part-*")) > 10
    got = {r["doc_id"]: r["ids"] for r in token_files.read(spark, f"{tmp_path}/f").collect()}
    assert [got[i] for i, _ in texts] == ids_of([t for _, t in texts])


def test_damage_is_noticed(spark, tmp_path):
    tokens = written(token_files.encode(spark.createDataFrame([(i, "some words here " * 50) for i in range(20)], "doc_id long, text string"), PATH), "t")
    table = token_files.write(tokens, f"{tmp_path}/f", "<u2")
    path = max(glob.glob(f"{tmp_path}/f/blocks/part-*"), key=lambda p: len(open(p, "rb").read()))
    data, codec = open(path, "rb").read(), rans.Codec(table)
    assert sum(len(b.doc_ids) for b in rans.read_blocks(data, codec)) > 0
    for at in (0, 30, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            [b.ids(codec) for b in rans.read_blocks(bytes(bad), codec)]
    with pytest.raises(ValueError):
        list(rans.read_blocks(data[:-7], codec))
    other = rans.Codec(rans.scaled(np.arange(1, 100)))
    with pytest.raises(ValueError, match="another frequency table"):
        list(rans.read_blocks(data, other))


def test_any_checkpoint_decodes_alone():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 60_000) - 1, 999).astype(np.uint32)
    table = rans.scaled(np.bincount(ids, minlength=1000))
    codec = rans.Codec(rans.unpack_table(table.pack()))
    block = next(rans.read_blocks(rans.pack_block(codec, 2, 9, [None, 4], [ids[:100], ids[100:]], stretch=8192), codec))
    step = block.every * block.lanes
    assert len(block.places) > 5
    for i in reversed(range(len(block.places))):
        assert (block.stretch(codec, i) == ids[i * step:(i + 1) * step]).all()
    assert block.nulls.tolist() == [True, False] and block.lengths.tolist() == [100, 59_900] and (block.part, block.start) == (2, 9)


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(6)
    ids = np.minimum(rng.zipf(1.3, 400_000) - 1, 4999).astype(np.uint32)
    counts = np.bincount(ids)
    codec = rans.Codec(rans.scaled(counts))
    p = counts[counts > 0] / counts.sum()
    assert len(rans.pack_block(codec, 0, 0, [1], [ids])) < 1.06 * -(p * np.log2(p)).sum() * len(ids) / 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=300), max_size=6), st.integers(1, 500))
def test_every_block_round_trips(docs, stretch):
    arrays = [np.array(d, np.uint32) for d in docs]
    ids = np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.uint32)
    counts = np.bincount(ids, minlength=41)
    if not counts.any():
        counts[0] = 1
    codec = rans.Codec(rans.scaled(counts, bits=8))
    data = rans.pack_block(codec, 0, 0, list(range(len(docs))), arrays, stretch)
    block = next(rans.read_blocks(data, codec))
    assert (block.ids(codec) == ids).all() and block.lengths.tolist() == [len(d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10 ** 12), min_size=1, max_size=300).filter(any))
def test_scaled_counts_fill_the_table(counts):
    table = rans.scaled(np.array(counts, dtype=np.int64), bits=6)
    assert int(table.freq.sum()) == 1 << table.bits
    assert all((c > 0) <= (f > 0) and (c or not f) for c, f in zip(counts, table.freq.tolist()))
