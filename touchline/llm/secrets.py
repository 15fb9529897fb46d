"""Secret scans over a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: every text that matches must hold all
trigrams of at least one alternative. The index is kept on lower-cased text and only for trigrams that some query
names, since no other can be asked for: a posting is (trigram, document). Intersecting the postings of an
alternative leaves its candidates, and only those are searched with the regular expression, on the real text. A
rule from which no mandatory trigram follows (a run of hex digits) is searched in every text.

Places come from the text's pieces: cutting it at a rule's matches gives the lengths between them, and a running sum
of pieces and matches gives each start. The sum runs over one row per match, so the number of matches is not bounded.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int          # characters that ``group`` must have; shorter matches are dropped after matching
    group: int = 0


# fixed values: the contract's rules. A run of hex digits is always matched from its first digit to its last, so
# asking for 24 in the pattern finds just the runs that are long enough.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 20),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 27),
)
MOST_STRINGS = 64


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _absorbed(alternatives) -> list[frozenset[str]]:
    """Without alternatives that ask for more than another one does."""
    kept = set(alternatives)
    return sorted((a for a in kept if not any(b < a for b in kept)), key=sorted)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams of lower-cased text; a match holds all of one. [empty set]: no condition.

    Walking the pattern, the strings that may stand here since the last open end are kept; an unbounded repeat or a
    wide character class ends them, and what they demand is joined to what was demanded before.
    """
    from re import _parser as parser

    def strings(node) -> set[str] | None:
        """All lower-cased strings a node stands for, None if too many."""
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(c).lower() for _, c in arg}
        if name == "SUBPATTERN":
            return several(arg[3])
        if name == "BRANCH":
            found = [several(b) for b in arg[1]]
            return None if None in found else set().union(*found)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != parser.MAXREPEAT:
            one, out = several(arg[2]), set()
            for n in range(arg[0], arg[1] + 1):
                if one is None or len(one) ** n > MOST_STRINGS:
                    return None
                out |= {"".join(x) for x in product(one, repeat=n)}
            return out
        return None

    def several(nodes) -> set[str] | None:
        out = {""}
        for n in nodes:
            s = strings(n)
            if s is None or len(s) * len(out) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in s}
        return out

    demand, here = [frozenset()], {""}

    def close():
        nonlocal demand, here
        demand = _absorbed(d | trigrams(s) for d in demand for s in here)
        here = {""}

    for node in parser.parse(pattern):
        s = strings(node)
        if s is None:
            close()
        else:
            if len(here) * len(s) > MOST_STRINGS:
                close()
            here = {a + b for a in here for b in s}
    close()
    return demand


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc_id, text_hash) for each trigram that a rule's query names."""
    asked = sorted(set().union(*(a for r in rules for a in trigram_query(r.pattern))))
    if not asked:
        asked = ["\0\0\0"]
    low = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hash(text_of(text_col)).alias("text_hash"),
                      F.lower(text_of(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in asked]))
    return low.select("doc_id", "text_hash", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_hash, kinds): the rules whose query a document's postings meet. An array of a document's
    trigrams holds at most those that the rules name."""
    have = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("have"))
    kinds = []
    for r in rules:
        query = trigram_query(r.pattern)
        if query == [frozenset()]:
            continue
        meets = [F.size(F.array_except(F.array(*map(F.lit, sorted(a))), F.col("have"))) == 0 for a in query]
        hit = meets[0]
        for m in meets[1:]:
            hit = hit | m
        kinds.append(F.when(hit, F.lit(r.kind)))
    found = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<string>")
    return have.select("doc_id", "text_hash", found.alias("kinds")).filter(F.size("kinds") > 0)


PLACE = "array<struct<kind:int,at:int,gap:int,n:int,value:int>>"


def _places(rule: Rule, k: int) -> Column:
    """Per match in order: the characters since the one before, its own, and its group's."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    text, p = F.col("text"), F.lit(rule.pattern)
    found = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, p, F.lit(0))).alias("n"),
                         lengths(F.regexp_extract_all(text, p, F.lit(rule.group))).alias("value"))
    named = F.transform(found, lambda z, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), z["gap"].alias("gap"), z["n"].alias("n"), z["value"].alias("value")))
    scans = F.lit(True) if trigram_query(rule.pattern) == [frozenset()] else F.array_contains("kinds", rule.kind)
    return F.coalesce(F.when(scans & text.rlike(rule.pattern), named.cast(PLACE)), F.array().cast(PLACE))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, start, end) of each secret: code points, end exclusive; kind counts from 0 as listed.

    Per rule the matches are leftmost and do not overlap; different rules may. Null texts are empty. A null id stays
    null. Rows that repeat id and text give their spans once.
    """
    found = candidates(postings(docs, rules, id_col, text_col), rules)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hash(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    same = src["doc_id"].eqNullSafe(found["doc_id"]) & (src["text_hash"] == found["text_hash"])
    rows = src.join(found, same, "left").select(src["doc_id"], src["text_hash"], "text", "kinds")
    each = rows.select("doc_id", "text_hash", F.explode(F.flatten(F.array(*[_places(r, k) for k, r in enumerate(rules)]))).alias("m"))
    each = each.select("doc_id", "text_hash", "m.*").filter("n is not null").distinct()
    along = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(along))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    return each.filter(F.col("value") >= least).select("doc_id", "text_hash", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE), id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the matches of each of the first ``base`` rules, base_sha256, spans.

    ``spans`` joins kind:start:end of all rules by comma, in order of start, then of the rules; ``base_sha256`` is the
    digest of those of the base rules alone. Null and empty texts hold nothing: zeros, the digest of the empty string
    and an empty string. Very long texts are searched whole. Repeated rows each give a row; other columns are not read, whatever their names; an empty
    table gives an empty result.
    """
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind") + 1)
    found = spans(docs, rules, id_col, text_col).withColumn("word", F.concat_ws(":", kind, "start", "end"))
    listed = lambda only: F.array_sort(F.collect_list(F.when(only, F.struct("start", "kind", "word"))))
    per = found.groupBy("doc_id", "text_hash").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])],
        listed(F.lit(True)).alias("all"))
    per = per.withColumnsRenamed({"doc_id": "f_id", "text_hash": "f_hash"})
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hash(text_of(text_col)).alias("text_hash"))
    rows = src.join(per, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    words = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["word"]))
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules[:base]],
        F.sha2(F.coalesce(words(F.filter("all", lambda x: x["kind"] < base)), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(words(F.col("all")), F.lit("")).alias("spans"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS kind, '{r.kind}' AS name, {r.least} AS least, generate_subscripts(m, 1) AS i,
    unnest(g) AS gap, unnest(m) AS m, unnest(v) AS v FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m,
      regexp_extract_all(text, '{p}', {r.group}) AS v, string_split_regex(text, '{p}')[:-2] AS g
      FROM documents WHERE regexp_matches(text, '{p}'))""")
    return f"""
WITH each AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM each),
word AS (SELECT doc_id, kind, stop - length(m) AS start, name || ':' || (stop - length(m)) || ':' || stop AS w FROM placed WHERE length(v) >= least),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(w, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
    string_agg(w, ',' ORDER BY start, kind) AS spans FROM word GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id"""


SQL = _sql()
