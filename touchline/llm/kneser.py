"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Units are the text's bytes, but a word that repeats the word before it is one unit of its own. The model is fitted on
all documents labelled good but those held to set the limits (a bound on them is a parameter, none by default); a text with a word
three times in a row is not trusted, so that runs of a word are strange to the model wherever they stand. Its tables are built by joins sharded on the n-gram and on
its context: counts, the continuation counts of each lower order (different bytes to the left), the three discounts
from the counts of counts, each context's weight for the next order, and the interpolated probability of every
n-gram seen. While the joined table has at most ``MOST_ENTRIES`` entries it is
broadcast, and each document's log probability is summed where the document is, without moving any text. A larger table stays
where it is: the documents' different n-grams are joined with it, order by order, and the sums joined back.

Thresholds cover all data: every document gets a perplexity, and a language's limit follows from two quantiles over
its documents labelled good that the model was not fitted on: ``REACH`` times as far from the median, in bits, as the
upper quantile is. For that one of ``HELD`` texts, chosen by the text's hash so that copies go together, is never in the
sample. With fewer than ``ENOUGH`` different such texts a language takes the limit over all languages, where each text
counts by how far it is from the median of all its language's documents, labelled or not: the model hardly knows such a
language, so its clean documents are strange to it too. With fewer than ``LEAST`` over all languages nothing is rejected.
"""
from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import join_small, text_of, written

N = 5
MOST_ENTRIES = 4_000_000        # of a model that is sent to the tasks, some 100 MB
QUANTILE, REACH, PRIOR = 0.99, 5.0, 16
HELD, ENOUGH, LEAST = 4, 20, 5
START, AGAIN = 0xFE, b"\x02"
RUN = b" " + AGAIN + b" " + AGAIN


def units(text: str) -> bytes:
    """UTF-8 bytes, a word equal to the one before it replaced by the unit for that."""
    words = text.encode("utf-8").split(b" ")
    return b" ".join([words[0], *(AGAIN if w == v and w else w for v, w in zip(words, words[1:]))])


def codes_of(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each unit with the n - 1 before it, number of units of each text). A text begins after START units."""
    head = bytes([START]) * (n - 1)
    buf = np.frombuffer(b"".join(head + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if buf.size < n:
        return np.empty(0, np.int64), sizes
    codes = np.zeros(buf.size - n + 1, np.int64)
    for j in range(n):
        codes |= buf[j:buf.size - n + 1 + j].astype(np.int64) << (8 * (n - 1 - j))
    return codes[buf[n - 1:] != START], sizes


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label row calls good and none toxic."""
    return (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("t_id"))
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).filter((F.col("q") == 1) & (F.col("x") == 0)).select("t_id"))


def held(text: Column) -> Column:
    """Whether a trusted text is kept from the sample, to set the limits."""
    return F.pmod(F.xxhash64(text), F.lit(HELD)) == 0


def sample(docs: DataFrame, labels: DataFrame, most_docs: int | None, most_bytes: int | None, id_col: str, text_col: str) -> DataFrame:
    """All trusted texts that are not held, one per id. With bounds, in an order drawn by a hash of the id, up to them; if they have more
    bytes than the bound, the longest give only their beginnings, all of one size, so that no text shuts out another."""
    drawn = trusted_ids(labels).withColumn("h", F.xxhash64("t_id"))
    if most_docs is not None:
        # more than are taken, for some are held
        drawn = F.broadcast(drawn.orderBy("h", "t_id").limit(most_docs * HELD // (HELD - 1) + 1))
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    text = text.join(drawn, F.col("id") == F.col("t_id")).groupBy("h", "t_id").agg(F.max("text").alias("text")).filter(~held(F.col("text")))
    if most_docs is not None:
        text = text.orderBy("h", "t_id").limit(most_docs)
    if most_bytes is None:
        return text.select("text")
    if most_docs is None:
        raise ValueError("a bound on bytes needs one on documents")
    text = written(text, "kn-drawn")
    # at most ``most_docs`` sizes
    sizes = sorted(r[0] for r in text.select(F.octet_length("text")).collect())
    if sum(sizes) <= most_bytes:
        return text.select("text")
    share = fair_share(sizes, most_bytes)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [t.encode("utf-8")[:share].decode("utf-8", "ignore") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], names=["text"])

    return text.select("text").mapInArrow(begin, "text string")


def fair_share(sizes: list[int], most: int) -> int:
    """The largest share such that the ascending sizes, each cut to it, sum to at most ``most``."""
    left = most
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= size
    return sizes[-1] if sizes else 0


def _discounts(grams: DataFrame) -> list[float]:
    n1, n2, n3, n4 = (float(x) for x in grams.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first())
    if not (n1 and n2 and n3):                      # too little text to estimate them
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(raw, 1)]


def train(texts: DataFrame, n: int = N) -> DataFrame:
    """(size, context, key, value): probabilities of the n-grams seen of each size, and weights of their contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [units(t) for t in b.column("text").to_pylist()]
            codes, _ = codes_of([u for u in read if RUN not in u], n)
            keys, c = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c.astype(np.int64))], names=["key", "c"])

    grams = written(texts.mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "kn-counts")
    by_size = {n: grams}
    for m in range(n - 1, 0, -1):                   # how many different units stand before it
        by_size[m] = written(by_size[m + 1].groupBy(F.col("key").bitwiseAND((1 << 8 * m) - 1).alias("key"))
                             .agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    out, shorter = [], None
    for m in range(1, n + 1):
        g = by_size[m].withColumn("context", F.shiftrightunsigned("key", 8))
        d = _discounts(g)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        ctx = g.groupBy("context").agg(F.sum("c").alias("total"), F.sum(off).alias("cut")).select(
            F.col("context").alias("ctx"), "total", (F.col("cut") / F.col("total")).alias("weight"))
        p = g.join(ctx, F.col("context") == F.col("ctx"))
        own = (F.col("c") - off) / F.col("total")
        if shorter is None:
            p = p.select("key", (own + F.col("weight") / 256).alias("value"))
        else:
            p = p.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (m - 1)) - 1)).join(
                shorter.select(F.col("key").alias("s_key"), F.col("value").alias("s_value")), F.col("suffix") == F.col("s_key"))
            p = p.select("key", (own + F.col("weight") * F.col("s_value")).alias("value"))
        shorter = written(p, "kn-probabilities")
        out += [shorter.select(F.lit(m).alias("size"), F.lit(False).alias("context"), "key", "value"),
                ctx.select(F.lit(m).alias("size"), F.lit(True).alias("context"), F.col("ctx").alias("key"), F.col("weight").alias("value"))]
    model = out[0]
    for t in out[1:]:
        model = model.union(t)
    return model


class Model:
    """The model's sorted tables, at most ``MOST_ENTRIES`` entries."""

    def __init__(self, table: pa.Table, n: int = N):
        size, context, key, value = (table.column(c).to_numpy() for c in ("size", "context", "key", "value"))
        self.n, self.tables = n, {}
        for m in range(1, n + 1):
            for c in (False, True):
                own = (size == m) & (context == c)
                o = np.argsort(key[own])
                self.tables[m, c] = key[own][o], np.log10(np.maximum(value[own][o], 1e-300))

    @staticmethod
    def _find(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not table[0].size:
            return np.zeros(keys.size, bool), np.zeros(keys.size)
        at = np.minimum(np.searchsorted(table[0], keys), table[0].size - 1)
        return table[0][at] == keys, table[1][at]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(codes.size), np.arange(codes.size)
        for m in range(self.n, 0, -1):
            key = codes[left] & ((1 << 8 * m) - 1)
            hit, value = self._find(self.tables[m, False], key)
            out[left[hit]] += value[hit]
            left, key = left[~hit], key[~hit]
            if not left.size:
                return out
            hit, value = self._find(self.tables[m, True], key >> 8)
            out[left[hit]] += value[hit]
        out[left] -= np.log10(256)
        return out

    def perplexities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(per unit, 1 for a text without any; number of units)."""
        result, n_units = np.ones(len(texts)), np.zeros(len(texts), np.int64)
        a = 0
        while a < len(texts):
            part, size, b = [], 0, a
            while b < len(texts) and size < 1 << 20:
                part.append(units(texts[b]))
                size += len(part[-1])
                b += 1
            codes, sizes = codes_of(part, self.n)
            ends = np.cumsum(sizes)
            total = np.r_[0.0, np.cumsum(self.log10(codes))]
            some = sizes > 0
            result[a:b][some] = 10 ** (-(total[ends] - total[ends - sizes])[some] / sizes[some])
            n_units[a:b] = sizes
            a = b
        return result, n_units


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str, rows: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"),
                      held(text_of(text_col)).alias("held"), *([F.struct(*docs.columns).alias("row")] if rows else []))
    names = ["doc_id", "lang", "perplexity", "n_units", "held", *(["row"] if rows else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = shared.value.perplexities(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(p), pa.array(n), b.column("held"), *([b.column("row")] if rows else [])], names=names)

    kind = f", row {src.schema['row'].dataType.simpleString()}" if rows else ""
    return written(src.mapInArrow(run, f"doc_id long, lang string, perplexity double, n_units long, held boolean{kind}"), "kn-scored")


def _scored_by_joins(docs: DataFrame, model: DataFrame, id_col: str, text_col: str, lang_col: str, rows: bool, n: int = N) -> DataFrame:
    """As ``_scored``, with a model of any size: every different n-gram of the documents takes its value from the table's shards once."""
    src = written(docs.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                              text_of(text_col).alias("text"), *([F.struct(*docs.columns).alias("row")] if rows else [])), "kn-documents")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in zip(b.column("at").to_pylist(), b.column("text")):
                codes, _ = codes_of([units(text.as_py())], n)
                keys, c = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, at)), pa.array(keys), pa.array(c.astype(np.int64))], names=["at", "key", "c"])

    grams = written(src.select("at", "text").mapInArrow(count, "at long, key long, c long"), "kn-grams")
    found = grams.select("key").distinct()
    log = lambda c: F.log10(F.greatest(c, F.lit(1e-300)))
    value = F.lit(-float(np.log10(256)))
    for m in range(1, n + 1):
        for context, name in ((False, f"p{m}"), (True, f"w{m}")):
            own = model.filter((F.col("size") == m) & (F.col("context") == context)).select(F.col("key").alias(f"k_{name}"), log(F.col("value")).alias(name))
            masked = F.col("key").bitwiseAND((1 << 8 * m) - 1)
            found = found.join(own, (F.shiftright(masked, 8) if context else masked) == F.col(f"k_{name}"), "left").drop(f"k_{name}")
        value = F.coalesce(F.col(f"p{m}"), F.coalesce(F.col(f"w{m}"), F.lit(0.0)) + value)
    total = grams.join(found.select("key", value.alias("value")), "key").groupBy("at").agg(F.sum(F.col("c") * F.col("value")).alias("total"), F.sum("c").alias("n_units"))
    out = src.join(total.withColumnRenamed("at", "t_at"), F.col("at") == F.col("t_at"), "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    perplexity = F.when(F.col("n_units") > 0, F.pow(F.lit(10.0), -F.col("total") / F.col("n_units"))).otherwise(1.0)
    return written(out.select("doc_id", "lang", perplexity.alias("perplexity"), "n_units", held(F.col("text")).alias("held"), *(["row"] if rows else [])), "kn-scored")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           quantile: float = QUANTILE, reach: float = REACH, most_docs: int | None = None, most_bytes: int | None = None, rows: bool = False,
           most_entries: int = MOST_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, lang, perplexity, threshold, kept (perplexity at most the threshold).

    A null text is empty; an empty text has perplexity 1 and is kept. A null language is a language of its own. A
    language with few documents labelled good takes the relative threshold over all languages; with hardly any label
    over all languages nothing is rejected (null threshold). A perplexity equal to the threshold is kept; very long texts are scored
    whole. Repeated rows each give a row; an empty table gives an empty result. Columns of other
    names are not read, unless ``rows`` asks for the input's row as a struct.
    """
    table = train(sample(docs, labels, most_docs, most_bytes, id_col, text_col))
    entries = table.count()
    if not entries and not trusted_ids(labels).isEmpty():
        warnings.warn("documents are labelled good, but none has text to fit the model on: nothing is rejected")
    if entries <= most_entries:
        scored = _scored(docs, Model(table.toArrow()), id_col, text_col, lang_col, rows)
    else:
        scored = _scored_by_joins(docs, table, id_col, text_col, lang_col, rows)
    # a few units prove little: PRIOR units of the language's median are added to each text
    scored = _by_lang(scored, labels, lambda x: F.percentile_approx(x, 0.5, 10_000), "middle")
    weighed = F.exp((F.col("n_units") * F.log("perplexity") + PRIOR * F.log("middle")) / (F.col("n_units") + PRIOR))
    scored = scored.withColumn("perplexity", F.coalesce(weighed, "perplexity"))

    def limit(x: Column) -> Column:
        q = F.percentile_approx(x, F.array(F.lit(0.5), F.lit(quantile)), 10_000)
        return q[0] * F.pow(q[1] / q[0], F.lit(reach))

    out = _by_lang(scored, labels, limit, "threshold")
    if not entries:                                 # no model, so no evidence against any document
        out = out.withColumn("threshold", F.lit(None).cast("double"))
    kept = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")) | (F.col("n_units") == 0)
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"), *(["row"] if rows else []))


def _by_lang(scored: DataFrame, labels: DataFrame, value: Callable[[Column], Column], name: str) -> DataFrame:
    """Add a statistic of the perplexities of the language's good documents that the model was not fitted on; copies of
    one text, which score alike, count once. With fewer than ``ENOUGH`` of them it is that over all languages, of the
    perplexities as parts of their language's median; with fewer than ``LEAST`` in all it is null."""
    centre = F.percentile_approx("perplexity", 0.5, 10_000)
    all_docs = written(scored.filter("n_units > 0").groupBy(F.col("lang").alias("l_lang")).agg(centre.alias("centre")), "kn-centres")
    good = scored.filter("held and n_units > 0").join(trusted_ids(labels), F.col("doc_id") == F.col("t_id"))
    good = good.select("lang", "perplexity", "n_units").distinct().join(all_docs, F.col("lang").eqNullSafe(F.col("l_lang")))
    overall, n = good.agg(value(F.col("perplexity") / F.col("centre")), F.count(F.lit(1))).first()
    few = F.lit(overall if n >= LEAST else None).cast("double") * F.col("centre")
    by_lang = good.groupBy(F.col("lang").alias("g_lang")).agg(value(F.col("perplexity")).alias("own"), F.count(F.lit(1)).alias("n_own"))
    by_lang = all_docs.join(by_lang, F.col("l_lang").eqNullSafe(F.col("g_lang")), "left")
    by_lang = written(by_lang.select("l_lang", F.when(F.col("n_own") >= ENOUGH, F.col("own")).otherwise(few).alias(name)), "kn-limits")
    return join_small(scored, by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left", 10_000).drop("l_lang")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with the input's columns, whatever their names.

    Decided as by ``judged``: null and empty texts stay, texts at the very threshold stay, very long texts are scored whole, each of
    repeated rows is judged alike. Null ids and languages are carried along; an empty table gives an empty result.
    """
    return judged(docs, labels, rows=True, **options).filter("kept").select("row.*")
