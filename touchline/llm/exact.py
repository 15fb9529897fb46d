"""Exact deduplication: every distinct text has an owner, found in compressed radix (Patricia) tries.

Each input task inserts its normalised texts into a trie, so copies meet before anything is moved and a text of
any number of copies leaves a task once. The distinct texts are then dealt out by length and content hash, and each
partition inserts the full byte strings into its trie; a terminal node stores the smallest id and the number of
rows. Texts count as equal only byte for byte. A trie that outgrows its budget writes whole subtrees to the task's
scratch space, sends later strings of those subtrees after them, and takes them up one at a time at the end; no
equal strings are ever parted, because a string belongs to one subtree.
"""
from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import SPACE, text_of, written

BUDGET = 192 << 20
NODE_BYTES = 250


class Node:
    __slots__ = ("label", "kids", "best", "count", "ties")

    def __init__(self, label: bytes):
        self.label, self.kids, self.best, self.count, self.ties = label, {}, None, 0, 0

    def add(self, best, count: int, ties: int) -> None:
        """Rows of this very string: the smallest id (null only if all are), their number, and the rows of that id."""
        if self.count == 0 or (best is not None and (self.best is None or best < self.best)):
            self.best, self.ties = best, ties
        elif best == self.best:
            self.ties += ties
        self.count += count


class Spilled:
    """A subtree on disk: a file of (string, best, count, ties)."""

    HEAD = struct.Struct("<q?qqq")

    def __init__(self):
        self.file = tempfile.TemporaryFile(prefix="trie-")

    def write(self, data: bytes, best, count: int, ties: int) -> None:
        self.file.write(self.HEAD.pack(len(data), best is None, best or 0, count, ties))
        self.file.write(data)

    def read(self) -> Iterator[tuple]:
        self.file.seek(0)
        while head := self.file.read(self.HEAD.size):
            n, none, best, count, ties = self.HEAD.unpack(head)
            yield self.file.read(n), None if none else best, count, ties
        self.file.close()


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` shares with ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    def __init__(self, budget: int = BUDGET):
        self.root, self.budget, self.bytes = Node(b""), budget, 0

    def insert(self, data: bytes, best, count: int = 1, ties: int = 1) -> None:
        node, at = self.root, 0
        while at < len(data):
            kid = node.kids.get(data[at])
            if kid is None:
                kid = node.kids[data[at]] = Node(data[at:])
                self.bytes += NODE_BYTES + len(kid.label)
                node = kid
                break
            if isinstance(kid, Spilled):
                kid.write(data, best, count, ties)
                return
            if not data.startswith(kid.label, at):
                n = common_prefix(kid.label, data, at)
                mid = Node(kid.label[:n])
                node.kids[data[at]] = mid
                kid.label = kid.label[n:]
                mid.kids[kid.label[0]] = kid
                self.bytes += NODE_BYTES
                kid = mid
            at += len(kid.label)
            node = kid
        node.add(best, count, ties)

    def full(self) -> bool:
        return self.bytes > self.budget

    def _under(self, node: Node, path: bytes) -> Iterator[tuple]:
        stack = [(node, path)]
        while stack:
            n, path = stack.pop()
            if isinstance(n, Spilled):
                yield n, path
                continue
            if n.count:
                yield n, path
            stack += [(k, path if isinstance(k, Spilled) else path + k.label) for k in n.kids.values()]

    def spill(self) -> bool:
        """Write the largest subtree of the first branching node to disk; False if there is nothing to part."""
        node, path = self.root, b""
        while len(own := [k for k in node.kids.values() if not isinstance(k, Spilled)]) == 1 and not node.count \
                and len(node.kids) == 1:
            node = own[0]
            path += node.label
        weight = {}
        for key, kid in node.kids.items():
            if not isinstance(kid, Spilled):
                total, stack = 0, [kid]
                while stack:
                    n = stack.pop()
                    if not isinstance(n, Spilled):
                        total += NODE_BYTES + len(n.label)
                        stack += n.kids.values()
                weight[key] = total
        if not weight or (len(weight) == 1 and not node.kids[next(iter(weight))].kids):
            return False
        key = max(weight, key=weight.get)
        out = Spilled()
        kid = node.kids[key]
        for n, data in self._under(kid, path + kid.label):
            if isinstance(n, Spilled):
                for row in n.read():
                    out.write(*row)
            else:
                out.write(data, n.best, n.count, n.ties)
        node.kids[key] = out
        self.bytes -= weight[key]
        return True

    def items(self) -> Iterator[tuple]:
        """(string, smallest id, rows, rows of that id) of each distinct string; spilled subtrees one at a time."""
        parked = []
        for n, data in self._under(self.root, b""):
            if isinstance(n, Spilled):
                parked.append(n)
            else:
                yield data, n.best, n.count, n.ties
        self.root, self.bytes = Node(b""), 0
        for p in parked:
            sub = Trie(self.budget)
            for row in p.read():
                sub.insert(*row)
                if sub.full():
                    sub.spill()
            yield from sub.items()


def normalised(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def _batches(rows: Iterator[tuple], schema: pa.Schema, bytes_of, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += bytes_of(r)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


TEXTS = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("data", pa.binary()), ("best", pa.int64()),
                   ("n", pa.int64()), ("ties", pa.int64())])
OWNERS = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per distinct normalised text: digest, keep_id (smallest id), group_size, ties (rows that have that id)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def out(trie):
            return _batches(((len(d), xxhash.xxh64_intdigest(d) - (1 << 63), d, *rest) for d, *rest in trie.items()), TEXTS,
                            lambda r: r[0] + 64)

        trie = Trie(budget)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("data")):
                trie.insert(t.as_buffer().to_pybytes(), i)
                if trie.full():             # what has met so far goes on; the rest meets after the shuffle
                    yield from out(trie)
        yield from out(trie)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(budget)
        for b in batches:
            for d, *rest in zip(b.column("data"), *(b.column(c).to_pylist() for c in ("best", "n", "ties"))):
                trie.insert(d.as_buffer().to_pybytes(), *rest)
                if trie.full():
                    trie.spill()
        yield from _batches(((hashlib.sha256(d).hexdigest(), *rest) for d, *rest in trie.items()), OWNERS, lambda r: 128)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_of(text_col)).cast("binary").alias("data"))
    return (src.mapInArrow(gather, "length long, hash long, data binary, best long, n long, ties long")
            .repartition("length", "hash")
            .mapInArrow(own, "digest string, keep_id long, group_size long, ties long"))


def _digest(text_col: str) -> Column:
    return F.sha2(normalised(text_of(text_col)), 256)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is an empty one, and equal to it; a text of white space only is one blank. Ids may be null: the
    smallest id is taken among the others, and is null only where all are. Exactly one row of a group is kept: of
    rows that repeat both the text and the smallest id, any one. Very long texts are compared whole. Other columns are not read, whatever their names;
    an empty table gives an empty result.
    """
    own = owners(docs, id_col, text_col).withColumnRenamed("digest", "text_sha256")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("text_sha256"))
    rows = ids.join(own, "text_sha256")
    from pyspark.sql import Window

    # dealt out again by id and digest: left where the join has put them, all copies of a text would be one task's
    turn = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1)))
    rows = rows.repartition("doc_id", "text_sha256").withColumn("turn", turn)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``classes`` keeps, with the input's columns, whatever their names. Only a kept row finds its owner by digest and id.

    Null texts count as empty ones, one of which stays; null ids come after all others; of rows that repeat text and smallest id any
    one stays. Very long texts are compared whole. An empty table gives an empty result.
    """
    own = written(owners(docs, id_col, text_col), "exact-owners")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), _digest(text_col).alias("d"))
    rows = rows.join(own, (F.col("d") == F.col("digest")) & F.col("id").eqNullSafe(F.col("keep_id")))
    if not own.filter(F.col("ties") > 1).isEmpty():         # rows that repeat id and text: any one stays
        rows = rows.groupBy("digest").agg(F.first("row").alias("row"))
    return rows.select("row.*")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t"""
