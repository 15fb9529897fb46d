"""Merkle dataset manifest: digests of all rows in trees of runs of eight, with a proof for every row.

A row's rank within its group, written in base eight, is its place in the tree. Leaves are dealt out once by block (the
ranks that share all but the last ``LEVELS`` digits), and the digits are grouped away one after another inside the block,
each time nesting the child structs in their parent. A block's root is a leaf of the next tier, whose blocks are as
bounded; the roots of all groups are the leaves of a last tree. On the way down a block's own path is put beside its
nested children, and explodes hand it to them with the digests before and after each; no leaf is joined with anything.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.util import drop_written, join_small, written

ARITY, LEVELS = 8, 3
BLOCK = ARITY ** LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before: string, after: string>>"


def field_code(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_code, values)).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with r (0-based rank in its group by ``order``, nulls first) and n (the group's rows).

    Rows are dealt out by ranges of (group, order), so a group of any size spreads over all tasks; ranks are a row's
    place in its task plus the rows of the group in the tasks before. Rows that tie in all of ``order`` are interchangeable.
    """
    # the last key spreads rows that repeat altogether; the input is a written table, so it is the same on a retry
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    placed = written(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                     .withColumn("_at", F.monotonically_increasing_id()), "merkle-ranks")
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    part = placed.groupBy(task.alias("_task"), F.col(group).alias("_group")).agg(F.min(place).alias("_first"), F.count("*").alias("_rows"))
    # one row per task and group: a group's window holds at most as many rows as there are tasks
    by = Window.partitionBy("_group")
    part = part.select(
        F.col("_task"), F.coalesce(F.col("_group"), F.lit("")).alias("_key"), F.col("_group").isNull().alias("_null"),
        (F.coalesce(F.sum("_rows").over(by.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_rows").over(by).alias("n"))
    keyed = placed.select("*", task.alias("_task"), F.coalesce(F.col(group), F.lit("")).alias("_key"), F.col(group).isNull().alias("_null"))
    return join_small(keyed, part, ["_task", "_key", "_null"]).withColumn("r", place + F.col("_base")).drop("_task", "_key", "_null", "_base", "_at")


def rollup(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Blocks of nodes (tree, n, r, h, payload): tree, n, block, h and the nested children.

    A level is hashed while more than one node of the tree remains; above that the single node passes through.
    """
    digits = [F.pmod(F.floor(F.col("r") / ARITY ** i), F.lit(ARITY)).cast("int").alias(f"d{i}") for i in range(LEVELS)]
    df = nodes.select("tree", "n", F.floor(F.col("r") / BLOCK).alias("block"), *digits, F.struct("h", *payload).alias("node"))
    df = df.repartition("tree", "block")              # every grouping below keeps these keys, so nothing moves again
    for i in range(LEVELS):
        left = [f"d{j}" for j in range(i + 1, LEVELS)]
        below = F.ceil(F.col("n") / ARITY ** i)       # nodes of the whole tree on the children's level
        kids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "node"))), lambda x: x["node"])
        df = df.groupBy("tree", "n", "block", *left).agg(kids.alias("kids"))
        h = F.when(below > 1, _sha(_joined(F.col("kids.h")))).otherwise(F.col("kids")[0]["h"])
        df = df.select("tree", "n", "block", *left, F.struct(h.alias("h"), "kids").alias("node"))
    return df.select("tree", "n", "block", F.col("node.h").alias("h"), F.col("node.kids").alias("kids"))


def climb(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The tiers of all trees, lowest first; in the last every tree is one block, whose h is the tree's root."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = []
    while True:
        blocks = written(rollup(nodes, payload), "merkle-tier")
        tiers.append(blocks)
        most = -(-most // BLOCK)
        if most <= 1:
            return tiers
        nodes = blocks.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("r"), "h")
        payload = []


def descend(tiers: list[DataFrame], tops: DataFrame, carried: list[str], payload: list[str]) -> DataFrame:
    """Hand paths down: from tops (tree, block, path, carried) to every node of the lowest tier (tree, h, payload, path, carried).

    A path lists, lowest level first, the digests before and after a node in its run.
    """
    above = tops
    for t in range(len(tiers) - 1, -1, -1):
        blocks = tiers[t]
        # at most two rows a key: the block and its path
        both = blocks.select("tree", "block", "n", "kids").unionByName(above.select("tree", "block", "path", *carried), allowMissingColumns=True)
        df = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ["n", "kids", "path", *carried]])
        for i in range(LEVELS - 1, -1, -1):
            df = df.select("tree", "block", "n", "path", *carried, F.col("kids.h").alias("hs"), F.posexplode("kids").alias("at", "kid"))
            step = F.struct(_joined(F.slice("hs", F.lit(1), F.col("at"))).alias("before"), _joined(F.slice("hs", F.col("at") + 2, F.lit(ARITY))).alias("after"))
            path = F.when(F.ceil(F.col("n") / ARITY ** i) > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
            place = (F.col("block") * ARITY + F.col("at")).alias("block")
            if i:
                df = df.select("tree", place, "n", path.alias("path"), *carried, F.col("kid.kids").alias("kids"))
            else:
                own = payload if t == 0 else []
                df = df.select("tree", place, path.alias("path"), *carried, F.col("kid.h").alias("h"), *[F.col(f"kid.{c}").alias(c) for c in own])
        above = df
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root recomputed from a leaf digest and its path."""
    return F.aggregate(path, leaf, lambda h, x: _sha(F.concat(x["before"], h, x["after"])))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return _joined(F.transform(path, lambda x: F.concat(x["before"], x["after"])))


def manifest(leaves: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Proofs for a table of leaves with columns tree (string), place (long, orders a tree's leaves) and h (hex digest).

    Returns tree, h, payload, path (``PATH``), subroot (of the leaf's tree) and root (of all trees' subroots, nulls first).
    Leaves that tie in place are ordered by digest. Tables below the shared folder stay until the result has been read.
    """
    payload = payload or []
    raw = written(leaves.select("tree", "place", "h", *payload), "merkle-leaves")
    trees = climb(numbered(raw, "tree", ["place", "h"]), payload)
    drop_written(raw)
    subroots = written(trees[-1].select(F.lit("").alias("all"), "tree", "h"), "merkle-subroots")
    forest = climb(numbered(subroots, "all", ["tree"]).select(F.col("all").alias("tree"), "n", "r", "h", F.col("tree").alias("member")), ["member"])
    drop_written(subroots)
    top = forest[-1].select("tree", "block", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("h").alias("root"))
    members = descend(forest, top, ["root"], ["member"])
    tops = members.select(F.col("member").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("h").alias("subroot"), "root")
    return descend(trees, tops, ["subroot", "root"], payload)


def proofs(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
           group_col: str = "lang", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    ``changed`` replaces fields of the rows of ``where`` after the manifest was made; the root is then folded from their
    new leaf and the original siblings, so a change shows as ``verified`` = false. Null ids come first in a group and are
    never in ``where``'s reach if it is null for them; null groups form a group of their own, the first; a null field counts as
    ``-``, an empty text as ``0:``. Texts are hashed whole, of any length. Repeated rows are leaves of their own, with their own
    proofs; rows with the same id are ordered by digest. Other columns, whatever their names, are not read. An empty table
    gives an empty result.
    """
    leaf = digest_of([F.col(c) for c in fields])
    other = F.lit(None).cast("string")
    if changed:
        now = digest_of([changed.get(c, F.col(c)) for c in fields])
        other = F.when(where, now) if where is not None else now
    leaves = docs.select(F.col(group_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("place"), leaf.alias("h"),
                         F.col(id_col).cast("long").alias("doc_id"), other.alias("other"))
    out = manifest(leaves, ["doc_id", "other"])
    again = folded(F.coalesce("other", "h"), F.col("path"))
    return (out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", _sha(siblings(F.col("path"))).alias("proof_sha256"),
                       again.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """``proofs`` after the texts of rows whose id's crc32 is divisible by 3 were lower-cased (A-Z)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return proofs(docs, changed={"text": F.translate(F.col("text"), UPPER, LOWER)}, where=hit)


def _sql(levels: int) -> str:
    """The same rows in SQL, for trees of up to 8 to the ``levels`` leaves."""
    code = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    crc = ("xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), "
           "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))")
    leaf = lambda text: "sha256(" + " || ".join(code(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [f"""WITH base AS (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0
  THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
a0 AS (SELECT lang AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m, h, doc_id, other FROM base)"""]

    def tree(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (SELECT t, i // 8 AS i, (any_value(m) + 7) // 8 AS m,
  CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY t, i // 8)""")
            side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN {rows}), '')"
            parts.append(f"""{name}p{k} AS (SELECT t, i, m > 1 AS used, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b,
  {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}{k})""")

    tree("a")
    parts.append(f"b0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, count(*) OVER () AS m, h, t AS lang FROM a{levels})")
    tree("b")
    steps = [(f"a{k}", f"JOIN ap{k} a{k} ON a{k}.t IS NOT DISTINCT FROM x.t AND a{k}.i = x.i // {8 ** k}") for k in range(levels)]
    steps += [(f"b{k}", f"JOIN bp{k} b{k} ON b{k}.i = y.i // {8 ** k}") for k in range(levels)]
    parts.append("folds0 AS (SELECT x.doc_id, x.h AS leaf, y.h AS subroot, r.h AS root, coalesce(x.other, x.h) AS f, '' AS s"
                 + "".join(f", {n}.used AS u_{n}, {n}.b AS b_{n}, {n}.a AS a_{n}" for n, _ in steps)
                 + f" FROM a0 x JOIN b0 y ON y.lang IS NOT DISTINCT FROM x.t CROSS JOIN b{levels} r " + " ".join(j for _, j in steps) + ")")
    for k, (n, _) in enumerate(steps):
        parts.append(f"folds{k + 1} AS (SELECT * REPLACE (CASE WHEN u_{n} THEN sha256(b_{n} || f || a_{n}) ELSE f END AS f, "
                     f"CASE WHEN u_{n} THEN s || b_{n} || a_{n} ELSE s END AS s) FROM folds{k})")
    return (",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(s) AS proof_sha256, f AS folded_root, f = root AS verified FROM folds{len(steps)}")


SQL = _sql(7)
