"""Documents as files of token ids, in the order of their ids, and those files read back (format: ``rans``).

Texts are cut at white space, which the vocabulary's library drops, and a word's ids are remembered; what the library says
about a word alone is what it says inside a text. Ids are counted while texts are encoded, the scaled counts are shared by
all blocks, and rows are dealt out by ranges of the order, so that the files of one task hold consecutive documents. A
document's place among all ids is its place in the task's files plus the ids of the tasks before.
"""
from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm.rans import Codec, Table, pack_block, read_blocks, scaled, unpack_table
from touchline.llm.tokens import _L, _N, _S, ONLY_COMMON, byte_alphabet, load
from touchline.llm.util import drop_written, join_small, shared_dir, text_of, written

REMEMBERED, HELD_BYTES = 1_500_000, 1 << 26        # words kept in a worker, and what they and their ids take
NEW_WORDS = 1 << 16                                # words merged in one call
BLOCK_IDS = 1 << 20
BLOCKS_A_FILE = 16


# fixed values: the parts of a vocabulary file whose words can be cut and lower-cased here
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LOWER = _L + "ɐ-ʯⱥⱦ"              # and the letters that some of them become in lower case
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[{_N}]|[^{_S}{_LOWER}{_N}]+")


class WordEncoder:
    """Ids of whole texts by remembered words; lives in one Python worker.

    Words are told apart and numbered by Arrow, column-wise; only those not met before are looked at one by one. A word of
    common characters is lower-cased and cut here, and all pieces of many words go through the library's merges in one
    call: a piece ends with the one token that has the end mark. Other words go through the whole library.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = load(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.tok_size = np.dtype(self.kind).itemsize
        self._forget()
        # characters that Arrow cuts words at and the library would not drop: texts with them are encoded whole
        plain, every = self.tok.encode("a", add_special_tokens=False).ids, [chr(c) for c in range(0x3001)]
        apart = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}a" for c in every]))).to_pylist()
        odd = [c for c, n in zip(every, apart) if n == 2 and self.tok.encode(f"a{c}a", add_special_tokens=False).ids != plain * 2]
        self.odd = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in odd) + "]" if odd else None
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        alphabet = byte_alphabet()
        simple = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PIECES and end and model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.merges = None
        if simple and all(c in model["vocab"] and c + end in model["vocab"] for c in alphabet.values()):
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, end_of_word_suffix=end, cache_capacity=0))
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
            self.last[[i for t, i in model["vocab"].items() if t.endswith(end)]] = True
            self.letters = {b: c for b, c in alphabet.items() if b not in (10, 32)}       # these part words and pieces

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())                       # the words by number
        self.ids = pa.array([], pa.large_binary())                   # and their ids

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _simple(self, word: str) -> bool:
        return ONLY_COMMON.fullmatch(word) is not None and not any(a in word for a in self.added)

    def _learn(self, words: list[str]) -> None:
        """Number the words and keep their ids."""
        rest = words if not self.merges else [] if self._simple("".join(words)) else [w for w in words if not self._simple(w)]
        if rest:
            found = self._encode(rest)
            self._add(rest, np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]))
            taken = set(rest)
            words = [w for w in words if w not in taken]
        if words:
            # one piece a blank, one word a line
            joined = CUT.sub(r"\g<0> ", "\n".join(words).lower())
            counts = [0, *(line.count(" ") for line in joined.split("\n"))]
            joined = joined.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
            pieces = np.cumsum(counts)
            if len(pieces) != len(words) + 1 or len(ends) != pieces[-1] + 1:
                raise ValueError("a piece without exactly one end mark")
            self._add(words, ids, ends[pieces])

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        packed = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64) * self.tok_size), pa.py_buffer(ids)])
        self.known, self.ids = pa.concat_arrays([self.known, pa.array(words, pa.string())]), pa.concat_arrays([self.ids, packed])

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array without nulls."""
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)) if self.odd else []
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if len(self.known) + len(coded.dictionary) > REMEMBERED or self.known.nbytes + self.ids.nbytes > HELD_BYTES:
            self._forget()
        number = pc.index_in(coded.dictionary, self.known)
        if number.null_count:
            missing, first = pc.is_null(number), len(self.known)
            new = coded.dictionary.filter(missing)
            for at in range(0, len(new), NEW_WORDS):
                self._learn(new.slice(at, NEW_WORDS).to_pylist())
            number = pc.replace_with_mask(number, missing, pc.add(pc.index_in(new, self.known.slice(first)), pa.scalar(first, pa.int32())))
        found = self.ids.take(number.take(coded.indices))
        ids = np.frombuffer(found.buffers()[2] or b"", self.kind)
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) // self.tok_size
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in whole:
            out[i] = self._encode([texts[int(i)].as_py()])[0]
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many(pa.array([text]))[0]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary: a worker that is used again still knows its words."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _runs(texts: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, pa.Array]]:
    """(place, texts): slices of about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
        yield a, texts.slice(a, b - a)
        a = b


def encode(docs: DataFrame, path: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n and ids (little-endian, 16 bits where the vocabulary fits, else 32) of every row, ``end`` appended.

    Each task adds one row at its end: how often it met each id, in ``counts`` (64 bits an id), which is null in all others.
    """
    size = max(load(path).get_vocab_size(), (end or 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = encoder(path)
        tail, total = np.array([] if end is None else [end], words.kind), np.zeros(size, dtype=np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        for b in batches:
            for at, texts in _runs(b.column("text")):
                found = words.many(texts)
                length = np.array([len(x) for x in found], np.int64) + len(tail)
                flat = np.concatenate([x for ids in found for x in (ids, tail)])
                total += np.bincount(flat, minlength=size)
                ends = np.concatenate([[0], np.cumsum(length * words.tok_size)])
                packed = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(length), packed.cast(pa.binary()),
                                                  pa.nulls(len(texts), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, from the tasks' own counts; at most the vocabulary comes to the driver."""

    def run(batches):
        for b in batches:
            for c in b.column("counts"):
                total = np.frombuffer(c.as_py(), "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "c"])

    found = tokens.filter("counts is not null").select("counts").mapInArrow(run, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(max([r["id"] for r in found], default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["c"]
    return counts


def write(tokens: DataFrame, folder: str, kind: str, block_ids: int = BLOCK_IDS, blocks_a_file: int = BLOCKS_A_FILE) -> Table | None:
    """Files of a written table of ``encode``, in ascending doc_id order (nulls first; equal ids by ids and then place).

    ``folder``/table holds the frequencies, ``folder``/blocks the blocks. None, and no table, if there are no ids.
    """
    spark = tokens.sparkSession
    counts = count_ids(tokens)
    if not counts.any():
        return None
    table = scaled(counts)
    binary = lambda rows: rows.select(F.col("record").cast("string").alias("value")).write
    binary(spark.createDataFrame([(bytearray(table.pack()),)], "record binary").coalesce(1)).text(f"{folder}/table")
    packed = spark.sparkContext.broadcast(table.pack())          # 4 bytes an id of the vocabulary

    def run(batches):
        from pyspark import TaskContext

        codec, part = Codec(unpack_table(packed.value)), TaskContext.get().partitionId()
        start, held, doc_ids, docs = 0, 0, [], []

        def block():
            nonlocal start, held, doc_ids, docs
            data = pack_block(codec, part, start, doc_ids, docs)
            start, held, doc_ids, docs = start + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["record"])

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(x, kind).astype(np.uint32)
                doc_ids.append(d)
                docs.append(ids)
                held += len(ids)
                if held >= block_ids:
                    yield block()
        if docs:
            yield block()

    keys = ["doc_id", "n", "_sum", "_tie"]       # the last spreads rows that repeat altogether
    ordered = (tokens.filter("counts is null").drop("counts").withColumn("_sum", F.xxhash64("ids")).withColumn("_tie", F.monotonically_increasing_id())
               .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids"))
    binary(ordered.mapInArrow(run, "record binary")).option("maxRecordsPerFile", blocks_a_file).text(f"{folder}/blocks")
    return table


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("content")


def read(spark: SparkSession, folder: str, digests_only: bool = False) -> DataFrame:
    """One row per document of ``folder``: part, place (ids of the part before it), doc_id, n_tokens, ids_crc32 and ids (array).

    Every checksum is asked for; a damaged file raises. With ``digests_only`` the ids themselves are left out.
    """
    table = _files(spark, f"{folder}/table").where(F.length("content") > 0).first()
    packed = spark.sparkContext.broadcast(bytes(table["content"]))
    schema = "part int, place long, doc_id long, n_tokens long, ids_crc32 long" + ("" if digests_only else ", ids array<int>")

    def run(batches):
        codec = Codec(unpack_table(packed.value))
        for b in batches:
            for data in b.column("content"):
                for block in read_blocks(data.as_py(), codec):
                    ids = block.ids(codec)
                    ends = np.cumsum(block.lengths)
                    if len(ends) and int(ends[-1]) != block.n_ids:
                        raise ValueError(f"block at part {block.part}, id {block.start}: lengths differ from its ids")
                    raw = memoryview(ids.astype("<u4").tobytes())
                    begins = ends - block.lengths
                    cols = [pa.array(np.full(len(ends), block.part), pa.int32()), pa.array(begins + block.start, pa.int64()),
                            pa.array(block.doc_ids, pa.int64(), mask=block.nulls), pa.array(block.lengths, pa.int64()),
                            pa.array([zlib.crc32(raw[4 * a:4 * e]) for a, e in zip(begins, ends)], pa.int64())]
                    if not digests_only:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return _files(spark, f"{folder}/blocks").mapInArrow(run, schema)


def placed(docs: DataFrame) -> DataFrame:
    """Rows of ``read`` with start, the number of ids of all documents before; the ids of a part are one row in the running sum."""
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    # one row per task that wrote
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return join_small(docs, parts, "part").withColumn("start", F.col("before") + F.col("place")).drop("before", "part", "place")


def round_trip(docs: DataFrame, path: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every row's ids to files and return, from the files read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone (nothing, if ``end`` is None). Null ids come first and stay null; rows of equal
    id follow each other in the order of length and content, repeated rows each with a start of its own. Texts are encoded
    whole, of any length; a long one fills a block by itself. Other columns, whatever their names, are not read. An empty
    table gives an empty result and no files.
    """
    spark = docs.sparkSession
    kind = "<u2" if load(path).get_vocab_size() <= 1 << 16 else "<u4"
    folder = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    tokens = written(encode(docs, path, end, id_col, text_col), "token-ids")
    table = write(tokens, folder, kind)
    if table is None:
        out = tokens.filter("counts is null").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"))
        return out                                           # no ids at all: every document is empty
    drop_written(tokens)
    back = written(read(spark, folder, digests_only=True), "token-rows")
    return placed(back).select("doc_id", "start", "n_tokens", "ids_crc32")


def production_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
