"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file is turned into the library's own model. A token of several bytes is given the pair of parts it is left
with when the merges below its rank have run on its bytes alone; those pairs, in rank order, are the merge list.
Tokens the merges cannot reach are still taken when they are a whole match, as the rank library does
(``ignore_merges``). The library then works on characters: each byte is written as one character of the byte
alphabet, and its offsets are the pieces' places in the text.

``round_trip`` cuts texts where a match begins whatever stands around it, and remembers what the library says about each stretch:
the ids of a text are those of its stretches.

Decoding reverses the byte table: ids give bytes, and bytes give text. A token may end inside a character;
``decode_text`` keeps such bytes until the rest has come and only replaces what never becomes a character.
"""
from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.tokens import byte_alphabet
from touchline.llm.util import text_of

# A blank or line feed between two other characters begins a match, whatever stands around them. Some characters that are no white
# space, but are near it, are taken for it, so texts are not cut there either.
_GAP = r"\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff"
CUT = re.compile(rf"(?:[ \n]?[^{_GAP}]+|[{_GAP}]+[^{_GAP}]*)(?:(?![ \n][^{_GAP}])[{_GAP}]+[^{_GAP}]*)*")
FOLLOWS = re.compile(rf"[ \n][^{_GAP}](?:[\s\S]*[^{_GAP}])?")
CUTTABLE = frozenset([public_tokenizers.PATTERN])   # patterns of which that is known
REMEMBERED, LONGEST = 400_000, 48                   # stretches kept in a worker, and the characters of the longest one kept


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def parts_below(ranks: dict[bytes, int], token: bytes, rank: int) -> list[bytes]:
    """The parts of ``token`` once every merge of a lower rank than its own has run, lowest rank and leftmost first."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
        if best[0] >= rank:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def build(path: str, pattern: str):
    """(tokenizer, bytes of each id) for a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    alphabet = byte_alphabet()
    name = {t: "".join(alphabet[b] for b in t) for t in ranks}
    merges = []
    for t, r in sorted(ranks.items(), key=lambda x: x[1]):
        if len(t) > 1:
            parts = parts_below(ranks, t, r)
            if len(parts) == 2:
                merges.append((name[parts[0]], name[parts[1]]))
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = t
    return tok, table


def decode_bytes(table: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode_text(table: list[bytes], ids: Iterable[int]) -> Iterator[str]:
    """The text each id adds; bytes of a split character wait for the id that completes it."""
    d = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield d.decode(table[i])
    yield d.decode(b"", True)


def _model(spark, path: str, pattern: str):
    """The model's JSON and byte table, built once on the driver; both are bounded by the vocabulary."""
    tok, table = build(path, pattern)
    return spark.sparkContext.broadcast((tok.to_str(), table))


def _load(model: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(model)


class Stretches:
    """Ids of whole texts, as little-endian 32-bit numbers, by remembered stretches; lives in one Python worker.

    New stretches that can follow any other go through the library as one text: no token crosses a cut, so the bytes of the
    tokens tell where each stretch ends.
    """

    def __init__(self, tok, table: list[bytes], pattern: str):
        self.tok, self.known = tok, {}
        self.size = np.array(list(map(len, table)), np.int64)
        self.cut = CUT.findall if pattern in CUTTABLE else lambda text: [text]

    def _learn(self, new: list[str]) -> None:
        after = list(filter(FOLLOWS.fullmatch, new))
        rest = list(set(new).difference(after))
        self.known.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(rest, add_special_tokens=False))))
        if after:
            ids = np.array(self.tok.encode_batch_fast(["".join(after)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(x.encode("utf-8")) for x in after])
            at = np.cumsum(self.size[ids])
            cuts = np.searchsorted(at, ends)
            if not np.array_equal(at[cuts], ends):
                raise ValueError("a token crosses a cut")
            packed, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            self.known.update((x, packed[a:b]) for x, a, b in zip(after, cuts, cuts[1:]))

    def many(self, texts: list[str]) -> list[bytes]:
        cut, known = list(map(self.cut, texts)), self.known
        every = set().union(*cut)
        if len(known) + len(every) > REMEMBERED:
            known.clear()
        new = list(every.difference(known))
        self._learn(new)
        out = [b"".join(map(known.__getitem__, x)) for x in cut]
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return out


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
           text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Each row's ids and, per id, the characters [start, end) of the text it covers. Null texts are empty, and have no ids."""
    shared = _model(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(shared.value[0])
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = tok.encode_batch(part.column("text").to_pylist(), add_special_tokens=False)
                at = [e.offsets if offsets else [] for e in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([e.ids for e in found], pa.list_(pa.int32())),
                     pa.array([[x[0] for x in o] for o in at], pa.list_(pa.int32())),
                     pa.array([[x[1] for x in o] for o in at], pa.list_(pa.int32()))],
                    names=["doc_id", "ids", "starts", "ends"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """Each row's ids as bytes and as text (bytes that form no character become U+FFFD). Null ids are none."""
    shared = _model(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[1]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [x or [] for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([decode_bytes(table, x) for x in ids], pa.binary()),
                     pa.array(["".join(decode_text(table, x)) for x in ids], pa.string())],
                    names=["doc_id", "decoded", "text"])

    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id long, decoded binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, n_tokens, ids_sha256, decoded_sha256, same (decoded bytes are the text's).

    Null and empty texts have no ids and the digests of no bytes; a null id stays null; repeated rows give equal
    rows; an empty table gives none; other columns, whatever their names, are not read. Texts are encoded whole.
    """
    shared = _model(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        stretches = Stretches(_load(model), table, pattern)
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 256):
                texts = b.column("text").slice(i, 256).to_pylist()
                for text, packed in zip(texts, stretches.many(texts)):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    back = decode_bytes(table, ids)
                    out.append((len(ids), hashlib.sha256(packed).hexdigest(),
                                hashlib.sha256(back).hexdigest(), back == text.encode("utf-8")))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


def production_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
