"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

A source's expected copies per document are ``target / size`` of the source. Its documents are put in order of
size, the expected copies are summed along that order from one offset drawn for the source, and a document is
emitted once for each whole number its step passes. Neighbours in that order are alike in size, so the words taken
stay near the target: they are off by about the largest document, whatever the number of documents. Where few large
documents make up a source, that much is not near. So some offsets are drawn, what each would take follows from the counts
of the sizes alone, and the one that comes nearest is the source's.

A source may hold any share of the rows. Its order is cut by size, and equal sizes by 256 digest classes of the id;
rows are numbered inside those pieces and only the pieces' counts are summed along the source.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import NOT_SPACE, join_small, text_of, written
from touchline.operators.ordered import running_sum, with_sequence

GRAIN = 1 << 20
OFFSETS = 64                # offsets a source can choose from


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources take the weights in code point order, null last, starting over after the last weight. What a source
    cannot take is shared again by weight among the rest. The fixed point of that is a common level: a source gets
    ``level * weight`` or its most. Sorted by most / weight, the full sources come first, so running sums of the
    mosts and weights tell which are full; the level follows from two sums.
    """
    first_two = F.coalesce(F.concat(F.lit("0"), F.substring("source", 1, 2)), F.lit("1"))
    s = with_sequence(sizes, "k", [], [F.col("source").asc_nulls_last()], chunk=first_two)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    s = written(s.withColumn("ratio", F.col("top") / F.col("weight")), "mix-weights")
    all_size, all_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = share * float(all_size or 0), float(all_weight or 0)
    octave = F.floor(F.log2(F.col("ratio") + 1) * 16)
    order = [F.col("ratio").asc(), F.col("k").asc()]
    for c in ("top", "weight"):
        s = running_sum(s, c, f"{c}_before", [], order, chunk=octave, include_current=False)
    before = lambda c: F.coalesce(F.col(f"{c}_before"), F.lit(0.0))
    s = s.withColumn("full", F.col("ratio") * (F.lit(all_weight) - before("weight")) + before("top") <= F.lit(total))
    s = written(s.select("source", "source_size", "weight", "top", "full"), "mix-full")
    taken, left = s.agg(F.sum(F.when(F.col("full"), F.col("top"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    level = (total - float(taken or 0)) / float(left) if left else 0.0
    return s.select("source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _nearest_offset(steps: DataFrame, offsets: int) -> DataFrame:
    """(o_source, start): per source, of ``offsets`` evenly spread from the drawn one, that with the words taken nearest to the target.

    All documents of one size take together what the first and the last of their places say.
    """
    tried = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))).alias("j"))
    turned = F.col("offset") + F.col("j") / float(offsets)
    tried = tried.withColumn("u", turned - F.floor(turned))
    words = F.col("t_size") * (F.floor(F.col("rate") * (F.col("smaller") + F.col("n")) + F.col("u")) - F.floor(F.col("rate") * F.col("smaller") + F.col("u")))
    per = tried.groupBy("t_source", "j", "u").agg(F.sum(words).alias("words"), F.first("target").alias("target"))
    off = F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "j", "u")
    return per.groupBy(F.col("t_source").alias("o_source")).agg(F.min(off).alias("x")).select("o_source", F.col("x.u").alias("start"))


def plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", offsets: int = OFFSETS,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken (= copies * size), row_hash.

    A null text has size 0; a null source is a source of its own, last in order; null ids sort after the others.
    Rows that repeat an id are numbered one by one, so each gets its own copies; of documents of one size, those of the later
    id classes and ids come later, and rows that agree in both are ordered by a hash of the whole row. Words of very long
    texts are all counted. A source without words has target 0 and no copies; an empty table gives an empty plan. Input
    columns may have any names. Runs agree: the offsets come from a digest of ``seed`` and the source.
    """
    src = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        n_words(text_of(text_col)).alias("size"), F.xxhash64(*[docs[c] for c in dict.fromkeys(docs.columns)]).alias("row_hash"))
    # digest classes of the id cut rows of one size without following any pattern of the ids
    src = src.withColumn("tie", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))), 1, 2))
    base = written(src, "mix-sizes")
    share_of = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("\0")))), 1, 5), 16, 10)
    share_of = share_of.select(
        F.col("source").alias("s_source"), "source_size", "target", (offset.cast("double") / GRAIN).alias("offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    # documents of smaller size in the source: one row per source and size is summed along the source
    steps = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    steps = running_sum(steps, "n", "smaller", ["source"], [F.col("size")], include_current=False)
    steps = steps.select(F.col("source").alias("t_source"), F.col("size").alias("t_size"), F.coalesce("smaller", F.lit(0)).alias("smaller"), "n")
    steps = written(join_small(steps, share_of, [F.col("t_source").eqNullSafe(F.col("s_source"))]), "mix-steps")
    steps = join_small(steps.drop("n", "offset"), _nearest_offset(steps, offsets), [F.col("t_source").eqNullSafe(F.col("o_source"))])
    rows = with_sequence(base, "at", ["source", "size"], [F.col("tie"), F.col("doc_id").asc_nulls_last(), F.col("row_hash")],
                         chunk=F.col("tie"), start=1)
    rows = rows.join(steps, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")))
    at = F.col("at") + F.col("smaller")
    copies = F.floor(F.col("rate") * at + F.col("start")) - F.floor(F.col("rate") * (at - 1) + F.col("start"))
    return rows.withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_hash")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each input row as often as ``plan`` gives it copies, with the input's columns, whatever their names.

    Rows that repeat each other in full are folded first and emitted as often as they are due together. Texts without words (null,
    empty, blank) are of size 0 and come as often as their source's rate says, as any other; null ids and sources are carried along;
    words of very long texts are all counted. An empty table gives an empty result.
    """
    p = written(plan(docs, **options).filter(F.col("copies") > 0).select("doc_id", "row_hash", "copies"), "mix-copies")
    repeated = not p.groupBy("doc_id", "row_hash").count().filter(F.col("count") > 1).isEmpty()
    names = docs.columns
    key = F.xxhash64(*[docs[c] for c in dict.fromkeys(names)])
    rows = docs.select(F.struct(*names).alias("row"), key.alias("h"))
    if repeated:
        rows = docs.dropDuplicates().select(F.struct(*names).alias("row"), F.xxhash64(*dict.fromkeys(names)).alias("h"))
        p = p.groupBy("row_hash", "doc_id").agg(F.sum("copies").alias("copies"))
    id_col = options.get("id_col", "doc_id")
    same = (F.col("h") == F.col("row_hash")) & F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("doc_id"))
    return rows.join(p, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 2) AS tie FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    2.0::DOUBLE * source_size AS top FROM sizes),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total, sum(weight) AS all_weight FROM weighed),
cut AS (
  SELECT w.*, total, (top / weight) * (all_weight - coalesce(sum(weight) OVER b, 0)) + coalesce(sum(top) OVER b, 0) <= total AS is_full
  FROM weighed w, total WINDOW b AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT (max(total) - coalesce(sum(top) FILTER (WHERE is_full), 0)) / sum(weight) FILTER (WHERE NOT is_full) AS lev FROM cut),
share_of AS (
  SELECT source, source_size, CASE WHEN is_full THEN top ELSE lev * weight END AS target,
    CAST(('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 5)) AS INTEGER)::DOUBLE / 1048576 AS start
  FROM cut, lev),
steps AS (
  SELECT r.source, r.size, r.n, s.target, s.start, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
    coalesce(sum(r.n) OVER (PARTITION BY r.source ORDER BY r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller
  FROM (SELECT source, size, count(*) AS n FROM base GROUP BY source, size) r JOIN share_of s ON r.source IS NOT DISTINCT FROM s.source),
tried AS (SELECT *, start + j / 64.0::DOUBLE - floor(start + j / 64.0::DOUBLE) AS u FROM steps, range(64) AS t(j)),
sums AS (
  SELECT source, j, u, abs(sum(size * (floor(rate * (smaller + n) + u) - floor(rate * smaller + u))) - any_value(target)) AS off
  FROM tried GROUP BY source, j, u),
best AS (SELECT source, u FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1),
placed AS (
  SELECT b.doc_id, b.size, s.source_size, s.target, o.u AS start,
    CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY b.size, b.tie, b.doc_id NULLS LAST) AS pos
  FROM base b JOIN share_of s ON b.source IS NOT DISTINCT FROM s.source JOIN best o ON b.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate * pos + start) - floor(rate * (pos - 1) + start) AS BIGINT) AS copies,
  CAST(floor(rate * pos + start) - floor(rate * (pos - 1) + start) AS BIGINT) * size AS taken
FROM placed"""
