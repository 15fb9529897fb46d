"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary entries that the merges put back together into one token. Which
entries do so is proved once, before any text is read (``prove_whole_tokens``): an entry counts when the library
keeps it as one pre-token and encodes it alone as its own id. While texts are read, a pre-token found in that set
counts as one token without being encoded; only the rest goes through the merges, once per distinct pre-token
while it is remembered.

The proved set holds at most the vocabulary, so it is broadcast. Texts are split with a compiled pattern whose
character classes were compared with the library's over ``COMMON``; a text with any other character is split by
the library's own pre-tokenizer, so the pieces are the library's either way.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import text_of

# fixed values: the byte-level pattern's classes, written out for the characters of COMMON
COMMON = r"\x00-ɏ‐-‧‰-⁞₠-₿"
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = r"\x09-\x0d\x20\x85\xa0"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
ONLY_COMMON = re.compile(rf"[{COMMON}]*")

REMEMBERED = 500_000


def byte_alphabet() -> dict[int, str]:
    """The reversible byte-to-character table of byte-level vocabularies: printable bytes stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b if b in keep else next(other)) for b in range(256)}


def load(path: str):
    """The tokenizer; its added tokens must be plain strings, since texts are cut at them before the splitting."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    for a in t.get_added_tokens_decoder().values():
        if a.lstrip or a.rstrip or a.single_word:
            raise ValueError(f"added token {a.content!r} takes its surroundings along; cutting texts at it would differ")
    return t


def prove_whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that alone are one pre-token and encode as exactly their own id."""
    t = load(path)
    back = {c: b for b, c in byte_alphabet().items()}
    added = [a.content for a in t.get_added_tokens_decoder().values()]
    texts, ids = [], []
    for piece, i in t.get_vocab(with_added_tokens=False).items():
        try:
            s = bytes(back[c] for c in piece).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue                                        # part of a character: never a pre-token by itself
        if s and not any(a in s for a in added) and len(t.pre_tokenizer.pre_tokenize_str(s)) == 1:
            texts.append(s)
            ids.append(i)
    return [s for s, i, e in zip(texts, ids, t.encode_batch(texts, add_special_tokens=False)) if e.ids == [i]]


class Counter:
    """Counts the tokens of one text at a time; lives in one Python worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tok, self.whole, self.known = load(path), whole, {}
        added = sorted((a.content for a in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, added))) if added else None

    def pieces(self, part: str) -> list[str]:
        if ONLY_COMMON.fullmatch(part):
            return SPLIT.findall(part)
        return [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]

    def __call__(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens taken by the shortcut)."""
        parts = self.cut.split(text) if self.cut else [text]
        total, short, whole, known = len(parts) - 1, 0, self.whole, self.known
        for part in parts:
            pieces = self.pieces(part)
            rest = [p for p in pieces if p not in whole]
            new = {p for p in rest if p not in known}
            if new:
                if len(known) > REMEMBERED:
                    known.clear()
                    new = set(rest)
                new = list(new)
                known.update(zip(new, (len(e) for e in self.tok.encode_batch(new, add_special_tokens=False))))
            short += len(pieces) - len(rest)
            total += len(pieces) - len(rest) + sum(map(known.__getitem__, rest))
        return total, short


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), n_whole.

    Null and empty texts have 0 bytes and 0 tokens. A null id stays null. Repeated rows each give a row, with equal
    counts. An empty table gives an empty result. Other columns of the input, whatever their names, are not read.
    A text is counted whole, however long it is.
    """
    sc = docs.sparkSession.sparkContext
    whole = sc.broadcast(frozenset(prove_whole_tokens(path)))       # at most the vocabulary
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = Counter(path, whole.value)
        for b in batches:
            found = [count(t.as_py()) for t in b.column("text")]
            n = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.compute.cast(pa.compute.binary_length(b.column("text")), pa.int64()), n,
                 pa.compute.greater(n, limit), pa.array([x[1] for x in found], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    import pyarrow.compute  # noqa: F401  (bound into ``pa`` for the closure)

    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")


def production_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
