"""Static range asymmetric numeral system: token ids as independent interleaved blocks under shared frequencies.

Counts of all ids are scaled once to a power of two and shared by every block. A block holds whole documents; its ids go
round a number of lanes, each a coder state of its own, so that one step of all lanes is a few array operations. Every so
many steps the states and the place in the stream are kept as a checkpoint, so that a block can be decoded from any of
them; each stretch between two has a checksum of its ids, and the block one of its bytes. A block knows where it stands.

A file is a run of blocks, each followed by a line feed, as Spark's text writer puts them: its commit protocol keeps lost
or repeated tasks from leaving half files, on any file system Spark can write. ``binaryFile`` reads them back.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(31)                      # states stay within [2**31, 2**63)
WORD = np.uint64(32)
HEAD = struct.Struct("<4sBB2x8sQIQIQIIIQ")
MAGIC, TABLE_MAGIC, VERSION = b"ITOK", b"ITAB", 1


@dataclass(frozen=True)
class Table:
    """Scaled frequencies by id; they sum to 2**bits, and every id that was counted has at least 1."""

    bits: int
    freq: np.ndarray                     # uint64 by id

    @property
    def start(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)

    @property
    def name(self) -> bytes:
        return hashlib.sha256(struct.pack("<B", self.bits) + self.freq.astype("<u4").tobytes()).digest()[:8]

    @property
    def slots(self) -> np.ndarray:
        """The id of each slot."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def pack(self) -> bytes:
        body = TABLE_MAGIC + struct.pack("<BI", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))


def unpack_table(data: bytes) -> Table:
    if data[:4] != TABLE_MAGIC:
        raise ValueError("not a frequency table")
    bits, n = struct.unpack_from("<BI", data, 4)
    end = 9 + 4 * n
    if struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
        raise ValueError("frequency table: checksum differs")
    return Table(bits, np.frombuffer(data, "<u4", n, 9).astype(np.uint64))


def scaled(counts: np.ndarray, bits: int = 18) -> Table:
    """Scale counts to 2**bits (more where there are more ids): each counted id at least 1, the rest of rounding to the largest."""
    present = int((counts > 0).sum())
    if not present:
        raise ValueError("no ids were counted")
    while present * 4 > 1 << bits:
        bits += 1
    if bits > 30:
        raise ValueError("too many different ids for a 30-bit table")
    whole, total = 1 << bits, int(counts.sum(dtype=object))
    freq = np.array([0 if c == 0 else max(1, int(c) * whole // total) for c in counts.tolist()], dtype=np.int64)
    spare = whole - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    at = 0
    while spare:
        i = order[at]
        # raise the most frequent, or take from it, leaving at least half of it
        step = spare if spare > 0 else -min(-spare, int(freq[i]) // 2)
        freq[i] += step
        spare -= step
        at = (at + 1) % present
    return Table(bits, freq.astype(np.uint64))


class Codec:
    def __init__(self, table: Table):
        self.table, self.name, self.bits = table, table.name, np.uint64(table.bits)
        self.freq, self.start, self.mask = table.freq, table.start, np.uint64((1 << table.bits) - 1)
        self.slots = table.slots

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, checkpoint places in the words, checkpoint states): the decoder's view at steps 0, every, 2 * every, ..."""
        freq, start = self.freq[ids], self.start[ids]
        if not freq.all():
            raise ValueError("an id the frequency table does not know")
        limit = freq << (np.uint64(63) - self.bits)
        state = np.full(lanes, np.uint64(1) << LOW, dtype=np.uint64)
        chunks, count, places, states = [], 0, [], []
        for step in range(-(-len(ids) // lanes) - 1, -1, -1):
            a = step * lanes
            f, c = freq[a:a + lanes], start[a:a + lanes]
            x = state[:len(f)]
            over = x >= limit[a:a + lanes]
            if over.any():
                out = x[over]
                chunks.append(out.astype(np.uint32))             # the low 32 bits
                count += len(out)
                x[over] = out >> WORD
            q = x // f
            state[:len(f)] = (q << self.bits) + (x - q * f) + c
            if step % every == 0:
                places.append(count)
                states.append(state.copy())
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
        return words, np.array([count - p for p in places[::-1]], dtype=np.uint64), np.array(states[::-1], dtype=np.uint64).reshape(len(states), lanes)

    def decode(self, words: np.ndarray, place: int, state: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids from a checkpoint on."""
        lanes, state, out = len(state), state.copy(), np.empty(n, dtype=np.uint32)
        at = int(place)
        for a in range(0, n, lanes):
            x = state[:min(lanes, n - a)]
            slot = x & self.mask
            ids = self.slots[slot]
            out[a:a + lanes] = ids
            x = self.freq[ids] * (x >> self.bits) + slot - self.start[ids]
            low = (x >> LOW) == 0
            k = int(np.count_nonzero(low))
            if k:
                if at + k > len(words):
                    raise ValueError("stream ends too early")
                x[low] = x[low] << WORD | words[at:at + k]
                at += k
            state[:len(x)] = x
        return out


@dataclass(frozen=True)
class Block:
    """A block's header and arrays; ids are decoded a stretch at a time."""

    part: int
    start: int                           # ids of the part before this block
    doc_ids: np.ndarray
    nulls: np.ndarray
    lengths: np.ndarray
    n_ids: int
    lanes: int
    every: int
    places: np.ndarray
    checks: np.ndarray
    states: np.ndarray
    words: np.ndarray
    size: int

    def stretch(self, codec: Codec, i: int) -> np.ndarray:
        """The ids between checkpoint ``i`` and the next, checked."""
        a = i * self.every * self.lanes
        ids = codec.decode(self.words, self.places[i], self.states[i], min(self.every * self.lanes, self.n_ids - a))
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.checks[i]:
            raise ValueError(f"block at part {self.part}, id {self.start}: stretch {i} has another checksum")
        return ids

    def ids(self, codec: Codec) -> np.ndarray:
        return np.concatenate([self.stretch(codec, i) for i in range(len(self.places))]) if self.n_ids else np.zeros(0, np.uint32)


def lanes_for(n: int, most: int = 1024) -> int:
    """A power of two, so that a small block does not spend its size on states."""
    return max(1, min(most, 1 << max(0, n // 64).bit_length() - 1)) if n >= 64 else 1


def pack_block(codec: Codec, part: int, start: int, doc_ids: list, docs: list[np.ndarray], stretch: int = 1 << 18) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    lanes = lanes_for(len(ids))
    every = max(1, stretch // lanes)
    words, places, states = codec.encode(ids, lanes, every)
    step = every * lanes
    checks = [zlib.crc32(ids[a:a + step].astype("<u4").tobytes()) for a in range(0, len(ids), step)]
    arrays = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([len(d) for d in docs], "<u8").tobytes(), places.astype("<u8").tobytes(), np.array(checks, "<u4").tobytes(),
        states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    head = HEAD.pack(MAGIC, VERSION, codec.table.bits, codec.name, HEAD.size + len(arrays) + 4, part, start, len(docs), len(ids), lanes, every,
                     len(places), len(words))
    return head + arrays + struct.pack("<I", zlib.crc32(arrays, zlib.crc32(head)))


def read_blocks(data: bytes, codec: Codec) -> Iterator[Block]:
    """The blocks of a file's bytes, each checked; what cannot be a block raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        try:
            magic, version, bits, table, size, part, start, n_docs, n_ids, lanes, every, n_marks, n_words = HEAD.unpack_from(data, at)
        except struct.error as e:
            raise ValueError("file ends inside a block") from e
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of token ids")
        if table != codec.name or bits != codec.table.bits:
            raise ValueError("block was written with another frequency table")
        if at + size > len(data) or struct.unpack_from("<I", data, at + size - 4)[0] != zlib.crc32(view[at:at + size - 4]):
            raise ValueError(f"block at part {part}, id {start}: checksum differs")
        pos = at + HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(data, kind, n, pos)
            pos += out.nbytes
            return out

        doc_ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u8", n_docs).astype(np.int64)
        places, checks = take("<u8", n_marks), take("<u4", n_marks)
        states = take("<u8", n_marks * lanes).reshape(n_marks, lanes)
        yield Block(part, start, doc_ids, nulls, lengths, n_ids, lanes, every, places, checks, states, take("<u4", n_words), size)
        at += size
        if data[at:at + 1] == b"\n":
            at += 1
