"""Media columns: documents stored as lossless WebP images, and images of a column read into pixel arrays."""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.util import text_of, written
from touchline.llm.webp import MOST_SIDE, decode, encode_bytes

ROW = 64
ROWS_AT_ONCE = 128


def payload_of(text: str) -> bytes:
    """UTF-8, filled up with zeros to a positive multiple of 64 bytes."""
    b = text.encode("utf-8")
    return b + bytes(-len(b) % ROW or (0 if b else ROW))


def stored(payload: bytes) -> bytes:
    """The stored form: images of 64 pixels across, one after the other, each as high as the format allows."""
    step = ROW * MOST_SIDE
    return b"".join(encode_bytes(payload[a:a + step], ROW) for a in range(0, len(payload), step))


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixels of each image of a stored form; a RIFF file tells its own size."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4:at + 8])[0]
        yield decode(media[at:at + size])
        at += size


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
                      ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media of every row. A null text is empty: one row of zeros. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(i, ROWS_AT_ONCE)
                rows = []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    rows.append((d, len(t.encode("utf-8")), stored(payload_of(t))))
                yield _out(rows, STORED)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Read stored media back: the payload's digests and a feature string from the pixel arrays.

    The string gives width x height, the sum and the number of different samples, and how many fall into each
    sixteenth of the range; it follows from the payload alone, so equal texts have equal ones.
    """

    def one(d, n, media):
        samples = [(p >> np.uint32(8) & np.uint32(255)).astype(np.uint8) for p in images(media)]
        flat = np.concatenate([s.ravel() for s in samples])
        payload = flat.tobytes()
        counts = np.bincount(flat, minlength=256)
        bins = ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
        feature = f"{ROW}x{sum(s.shape[0] for s in samples)}:{int(flat.sum(dtype=np.int64))}:{np.count_nonzero(counts)}:{bins}"
        return (d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
                hashlib.sha256(media).hexdigest(), feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(i, ROWS_AT_ONCE)
                yield _out([one(*r) for r in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")))], FEATURES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text in a media table, read the table back, and return its digests and features, one row per input row.

    Null ids stay null, a null text is empty (one row of zeros), repeated rows each give a row (equal texts, equal values), very long
    texts are stored whole, in several images; other columns are not read, and an empty table gives no rows.
    """
    return features(written(store(docs, id_col, text_col), "media"))


def pixels(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, width, height, argb (row by row, 32 bits a pixel, little-endian) and error for a column of lossless WebP files.

    A null file gives nulls; a file that cannot be decoded gives null pixels and the reason. Ids are returned as text.
    """
    schema = pa.schema([("id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary()), ("error", pa.string())])

    def one(i, data):
        if data is None:
            return i, None, None, None, None
        try:
            a = decode(data)
        except (ValueError, IndexError, struct.error) as e:
            return i, None, None, None, str(e) or type(e).__name__
        return i, a.shape[1], a.shape[0], a.astype("<u4").tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(i, ROWS_AT_ONCE)
                yield _out([one(*r) for r in zip(*(part.column(c).to_pylist() for c in ("id", "media")))], schema)

    src = media.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return src.mapInArrow(run, "id string, width int, height int, argb binary, error string")
