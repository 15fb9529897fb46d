from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from touchline.llm import bpe, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
ALPHABET = st.text(st.one_of(st.sampled_from("aé'sT  \t\n\x0b\x1c\x85   1²½!|<>"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.production_path(), frozenset(tokens.prove_whole_tokens(tokens.production_path())))


@pytest.fixture(scope="module")
def model():
    return bpe.build(bpe.production_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def rank_library():
    ranks = bpe.read_ranks(bpe.production_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_proved_strings_are_most_of_the_vocabulary(counter):
    assert len(counter.whole) > 0.9 * counter.tok.get_vocab_size()


def test_classes_agree_with_the_library(counter):
    for cp in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205f), *range(0x20a0, 0x20c0)]:
        c = chr(cp)
        s = f"a{c}b 1{c}2 !{c}? {c}  {c}{c} x"
        assert tokens.SPLIT.findall(s) == [s[a:b] for _, (a, b) in counter.tok.pre_tokenizer.pre_tokenize_str(s)], hex(cp)


@settings(max_examples=300, deadline=None)
@given(text=ALPHABET, special=st.booleans())
def test_counts_equal_the_library(counter, text, special):
    text = text + "<|endoftext|>" + text if special else text
    assert counter(text)[0] == len(counter.tok.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(text=ALPHABET)
def test_ids_equal_the_rank_library(model, rank_library, text):
    tok, table = model
    e = tok.encode(text, add_special_tokens=False)
    assert e.ids == rank_library.encode_ordinary(text)
    assert bpe.decode_bytes(table, e.ids) == text.encode() and "".join(bpe.decode_text(table, e.ids)) == text
    assert all(0 <= a <= b <= len(text) for a, b in e.offsets)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(ALPHABET, st.text(st.sampled_from("ab1!' \n\t\u00a0\u3000\u200b中é"), max_size=30)), min_size=1, max_size=4))
def test_ids_of_stretches_are_those_of_the_text(model, rank_library, texts):
    stretches = bpe.Stretches(*model, public_tokenizers.PATTERN)
    for _ in range(2):                              # learned, then remembered
        got = [np.frombuffer(x, "<u4").tolist() for x in stretches.many(texts)]
        assert got == [rank_library.encode_ordinary(t) for t in texts]


def test_a_stretch_met_before_is_not_encoded_again(model, monkeypatch):
    """Each different stretch goes through the merges once; what is kept has a bound."""
    class Asked:
        def __init__(self):
            self.texts = []

        def encode_batch_fast(self, texts, add_special_tokens):
            self.texts += texts
            return model[0].encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    asked, text = Asked(), "one two one two " * 50 + "y" * 100
    stretches = bpe.Stretches(asked, model[1], public_tokenizers.PATTERN)
    stretches.many([text, text])
    assert sorted(asked.texts[:-1]) == ["one"] and sorted(asked.texts[-1].split()) == ["one", "two", "y" * 100] and "y" * 100 not in "".join(stretches.known)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for i in range(50):
        stretches.many([f"a{i} b{i}"])
        assert len(stretches.known) <= 10
    own = bpe.Stretches(asked, model[1], "[a-z]+| ")          # of other patterns nothing is known
    own.many(["a b"])
    assert asked.texts[-1] == "a b"


def test_split_characters_wait_for_their_rest(model):
    tok, table = model
    ids = tok.encode("\U0001f9ff", add_special_tokens=False).ids
    assert len(ids) > 1
    parts = list(bpe.decode_text(table, ids))
    assert parts[:len(ids) - 1] == [""] * (len(ids) - 1) and "".join(parts) == "\U0001f9ff"
    assert "".join(bpe.decode_text(table, ids[:1])) == "�"


def test_tables(spark, counter, rank_library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokens.count_tokens(docs, tokens.production_path()).collect():
        n = len(counter.tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len(texts[r["doc_id"]].encode()))
    encoded = bpe.encode(docs, bpe.production_path())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, bpe.production_path()).collect()}
    assert back == texts
    for r in encoded.collect():
        assert r["ids"] == rank_library.encode_ordinary(texts[r["doc_id"]])
        assert all(texts[r["doc_id"]][a:b] for a, b in zip(r["starts"], r["ends"]))
    assert all(r["same"] for r in bpe.round_trip(docs, bpe.production_path()).collect())
