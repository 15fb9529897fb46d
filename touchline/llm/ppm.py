"""Language-model scores by prediction by partial matching over bytes, learned from the corpus itself.

The byte-context trie is kept as a table of contexts: each position of a training text is counted under its context of
the longest order and the byte that follows, and the shorter contexts are that table's suffixes. A byte's probability
goes down the orders: where the context has not been followed by the byte, the escape is paid for (the number of
different followers against all occurrences), the followers just ruled out are excluded, and the next shorter
context is asked; last, all bytes not yet excluded are equally likely. A text ends with a symbol of its own.

With exclusion a probability depends on nothing but the context of the longest order and the byte. So each such
string gets one number, worked out in shards that each hold the subtree of one two-byte suffix.

Documents are dealt into blocks of bounded size. A block writes down each distinct context string and word once with
its training count; counts are summed over the corpus, turned into log probabilities, and joined back to the blocks
that asked, where the documents are scored. Nothing but two tables of at most 65,536 entries is broadcast; what is
gathered grows with the corpus, and no key has more rows than there are blocks.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import text_of, written

# neither byte occurs in UTF-8 text; the first fills contexts before a text, the second ends it
START, END = 0xFE, 0xFF
ORDER = 4
BLOCK_BYTES = 16 << 20
GRAM, WORD = 0, 1
END_WORD = b"\n"            # no word has white space in it


def context_strings(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first position of each text): for every byte and the end, its last ``order`` bytes and itself."""
    head = bytes([START]) * order
    buf = np.frombuffer(b"".join(head + t + bytes([END]) for t in texts), np.uint8)
    codes = np.zeros(buf.size - order, np.uint64)
    for j in range(order + 1):
        codes |= buf[j:buf.size - order + j].astype(np.uint64) << np.uint64(8 * (order - j))
    sizes = np.array([len(t) + 1 for t in texts])
    return codes[buf[order:] != START], np.r_[0, np.cumsum(sizes)[:-1]]


def _portions(texts: list[bytes], most: int = 2 << 20) -> Iterator[slice]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield slice(a, i + 1)
            a, size = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def _bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t.encode("utf-8") for t in column.to_pylist()]


def word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def asked(texts: list[bytes], learn: list[bool], order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per kind: the distinct keys of a block and their counts in its training texts."""
    found, counts = [], []
    for part in _portions(texts):
        codes, first = context_strings(texts[part], order)
        weight = np.repeat(np.array(learn[part], np.int64), np.diff(np.r_[first, codes.size]))
        keys, at = np.unique(codes, return_inverse=True)
        found.append(keys)
        counts.append(np.bincount(at, weight, keys.size).astype(np.int64))
    grams, at = np.unique(np.concatenate(found), return_inverse=True)
    of_gram = np.bincount(at, np.concatenate(counts), grams.size).astype(np.int64)
    words: dict[bytes, int] = {}
    for t, l in zip(texts, learn):
        for w in t.lower().split():
            words[w] = words.get(w, 0) + l
    words[END_WORD] = sum(learn)
    return {GRAM: (grams.view(np.int64), of_gram), WORD: (word_keys(list(words)), np.array(list(words.values()), np.int64))}


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, at, np.bincount(at, n, u.size)


def log_probabilities(grams: np.ndarray, n: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 P(last byte | the bytes before it) of each distinct string; all strings of a two-byte suffix are present.

    ``pairs[a, b]`` counts byte b after byte a in all training texts: the contexts of orders 1 and 0.
    """
    grams, out, done = grams.view(np.uint64), np.zeros(grams.size), np.zeros(grams.size, bool)
    last = (grams & np.uint64(255)).astype(np.int64)
    single = pairs.sum(axis=0)
    used = (pairs > 0).astype(np.int64)
    excluded, ruled_out = np.zeros(grams.size), np.zeros(grams.size)
    seen_above = None                           # (string of this order, was seen) to sum the next order's exclusion
    for k in range(order, -1, -1):
        if k >= 2:
            keys, at, count = _sums(grams & np.uint64((1 << 8 * (k + 1)) - 1), n)
            ctx, of, total = _sums(keys >> np.uint64(8), count)
            own, ctx_of = count[at], of[at]
            all_n, kinds = total[ctx_of], np.bincount(of, count > 0, ctx.size)[ctx_of]
        elif k == 1:
            before = (grams >> np.uint64(8) & np.uint64(255)).astype(np.int64)
            own, all_n, kinds = pairs[before, last], pairs.sum(axis=1)[before], used.sum(axis=1)[before]
        else:
            own, all_n, kinds = single[last], np.full(grams.size, single.sum()), np.full(grams.size, (single > 0).sum())
        if seen_above is not None:              # occurrences here of the bytes already ruled out above
            u_at, u_seen, u_ctx = seen_above
            mine = np.zeros(u_seen.size)
            mine[u_at] = own                    # every string of the order above has one count at this order
            excluded = np.bincount(u_ctx, mine * u_seen)[u_ctx[u_at]]
        elif k == 0:
            excluded = (used * single).sum(axis=1)[before]
        free, kinds_free = all_n - excluded, kinds - ruled_out
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ~done & (own > 0)
            out[hit] += np.log10(own[hit] / (free + kinds_free)[hit])
            escape = ~done & ~hit & (kinds_free > 0)
            out[escape] += np.log10(kinds_free[escape] / (free + kinds_free)[escape])
        done |= hit
        ruled_out = kinds
        seen_above = (at, (count > 0).astype(float), of) if k >= 2 else None
    out[~done] -= math.log10(255 - int((single > 0).sum()))
    return out


def score_blocks(texts: list[bytes], order: int, grams: tuple, words: tuple) -> list[tuple]:
    """(n_tokens, n_known, sum of log10(c + 0.5), log10 probability) of each text, from sorted keys and their values."""
    keys, values = grams
    probability = np.empty(len(texts))
    for part in _portions(texts):
        codes, first = context_strings(texts[part], order)
        probability[part] = np.add.reduceat(values[np.searchsorted(keys, codes)], first)
    index: dict[bytes, int] = {END_WORD: 0}
    tokens = [[index.setdefault(w, len(index)) for w in t.lower().split()] for t in texts]
    count = words[1][np.searchsorted(words[0], word_keys(list(index)))]
    known, base = (count > 0).astype(np.int64), np.log10(count + 0.5)
    out = []
    for ids, p in zip(tokens, probability):
        a = np.array([*ids, 0])
        out.append((a.size, int(known[a].sum()), float(math.fsum(base[a])), float(p)))
    return out


LOOKUP = "block int, kind byte, key long, n long"
PART = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("base", pa.float64()), ("score", pa.float64()), ("train", pa.int64()), ("kinds", pa.int64())])


def _gram_table(lookups: DataFrame, order: int) -> DataFrame:
    """(key, value): the log probability of every context string that some block asked for."""
    spark = lookups.sparkSession
    grams = lookups.filter(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n"))
    grams = written(grams, "ppm-grams")
    two = grams.groupBy(F.col("key").bitwiseAND(0xFFFF).cast("int").alias("pair")).agg(F.sum("n").alias("n"))
    pairs = np.zeros((256, 256))
    for r in two.collect():                     # at most 65,536 rows
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    shared = spark.sparkContext.broadcast(pairs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if held:
            key, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            value = log_probabilities(key, n, order, shared.value)
            for a in range(0, key.size, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a:a + (1 << 16)]), pa.array(value[a:a + (1 << 16)])], names=["key", "value"])

    suffix = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    return grams.withColumn("suffix", suffix).repartition("suffix").select("key", "n").mapInArrow(work, "key long, value double")


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod ``folds`` is ``fold`` are held out; a null id counts as empty text there. Null
    texts are empty: one token, the end. ``base_score`` is the smoothed word model of the contract, ``score`` the
    log10 probability that this model gives the text, however long it is. Without any training row every byte is equally likely.
    Repeated rows each give a row (and count each time); other columns are not read, whatever their names; an empty
    table gives an empty result. Word counts are joined by 64-bit hashes of the words.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    id_text = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), (F.crc32(id_text) % folds == fold).alias("held_out"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    src = src.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        learn = [not h for h in table.column("held_out").to_pylist()]
        found = asked(_bytes(table.column("text")), learn, order)
        parts = []
        for kind, (keys, n) in found.items():
            parts.append(pa.table({"block": pa.array(np.full(keys.size, key[0].as_py()), pa.int32()),
                                   "kind": pa.array(np.full(keys.size, kind), pa.int8()), "key": pa.array(keys), "n": pa.array(n)}))
        return pa.concat_tables(parts)

    lookups = written(src.groupBy("block").applyInArrow(ask, LOOKUP), "ppm-asked")
    values = lookups.filter(F.col("kind") == GRAM).select("block", "kind", "key").join(_gram_table(lookups, order), "key") \
        .select("block", "kind", "key", "value", F.lit(False).alias("first"))
    same = Window.partitionBy("key")
    words = lookups.filter(F.col("kind") == WORD).select(
        "block", "kind", "key", F.sum("n").over(same).cast("double").alias("value"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first"))
    answers = values.unionByName(words)

    def answer(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return PART.empty_table()
        kind, keys, value = (given.column(c).to_numpy() for c in ("kind", "key", "value"))
        sides = []
        for k, t in ((GRAM, np.uint64), (WORD, np.int64)):
            ks, vs = keys[kind == k].view(t), value[kind == k]
            o = np.argsort(ks)
            sides.append((ks[o], vs[o]))
        held = table.column("held_out").to_pylist()
        rows = score_blocks(_bytes(table.column("text")), order, *sides)
        cols = list(zip(*rows))
        once = (kind == WORD) & given.column("first").to_numpy()
        none = [0] * (len(rows) - 1)
        return pa.table([table.column("doc_id"), pa.array(held), *cols_of(cols), pa.array([int(value[once].sum()), *none], pa.int64()),
                         pa.array([int((value[once] > 0).sum()), *none], pa.int64())], schema=PART)

    def cols_of(cols):
        return [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])]

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, train long, kinds long"
    parts = written(src.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, ddl), "ppm-scores")
    n, v = parts.agg(F.sum("train"), F.sum("kinds")).first()
    n, v = n or 0, v or 0
    return parts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                        (F.col("base") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"), "score")
