"""Token-id files in Simple-8b words.

A shard file holds, little-endian: the magic; blocks; the document index; the block index; a tail. A block is a header of
three u32 (values, words, escapes), the word numbers of its escapes (u32) and its 64-bit words. The top four bits of a word
select how many values of how many bits follow in the other 60. Selector 0 is an escape: the next whole word is one value,
so any unsigned 64-bit value can be stored. The block index gives every block's byte offset and first value, so blocks
decode independently and at once. The document index holds ids, their validity and token counts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .encode import encoded
from .warc import located, opened

MAGIC = b"TWS8\x01\0\0\0"
TAIL = struct.Struct("<QQQQ8s")
BLOCK = 1 << 16
#: Fixed values: (values, bits) of the selectors 1 to 15.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths of uint64 values."""
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1]
    return np.where(high > 0, high + 32, low).astype(np.uint8)


def pack(values: np.ndarray) -> bytes:
    """A block of uint64 values: each word takes the longest run that fits, found for all positions at once."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    bits = _bits(values)
    best = np.zeros(n, np.uint8)
    most: dict[int, np.ndarray] = {1: bits}

    def window(size: int) -> np.ndarray:
        """Largest bit length among the size values from each position, cut at the end of the block."""
        if size not in most:
            half = window((size + 1) // 2)
            shift = size - (size + 1) // 2
            out = half.copy()
            np.maximum(out[:-shift], half[shift:], out=out[:-shift]) if n > shift else None
            most[size] = out
        return most[size]

    for selector in range(len(SELECTORS), 0, -1):
        count, width = SELECTORS[selector - 1]
        best[window(count) <= width] = selector
    count_of = np.array([1, *(c for c, _ in SELECTORS)], np.int64)
    after = (np.arange(n) + count_of[best]).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i = after[i]
    at = np.array(at, np.int64)
    chosen = best[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]]).astype(np.int64) if len(at) else at
    out = np.zeros(len(at) + int((chosen == 0).sum()), np.uint64)
    for selector, (count, width) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(chosen == selector)
        if not len(rows):
            continue
        word = np.full(len(rows), np.uint64(selector << 60))
        if width:
            for j in range(count):
                index = at[rows] + j
                word |= np.where(index < n, values[np.minimum(index, n - 1)], 0).astype(np.uint64) << np.uint64(j * width)
        out[place[rows]] = word
    escaped = np.flatnonzero(chosen == 0)
    out[place[escaped] + 1] = values[at[escaped]]
    return struct.pack("<III", n, len(out), len(escaped)) + place[escaped].astype("<u4").tobytes() + out.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The values of a block."""
    n, words, escapes = struct.unpack_from("<III", data)
    escaped = np.frombuffer(data, "<u4", escapes, 12).astype(np.int64)
    word = np.frombuffer(data, "<u8", words, 12 + 4 * escapes)
    plain = np.ones(words, bool)
    plain[escaped + 1] = False
    real = np.flatnonzero(plain)
    chosen = (word[real] >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in SELECTORS)], np.int64)[chosen]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, width) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(chosen == selector)
        if len(rows) and width:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            out[start[rows][:, None] + np.arange(count)] = word[real[rows]][:, None] >> shifts & np.uint64((1 << width) - 1)
    out[start[chosen == 0]] = word[escaped + 1]
    return out[:n]


class Writer:
    """Streams documents into one shard file; holds a block and the index."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.ids, self.valid, self.counts, self.blocks = [], bytearray(), [], []
        self.held, self.n_held, self.values = [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        while self.n_held >= BLOCK:
            everything = np.concatenate(self.held)
            whole = len(everything) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(everything[i : i + BLOCK])
            self.held, self.n_held = [everything[whole:]], len(everything) - whole

    def _block(self, values: np.ndarray) -> None:
        self.blocks.append((self.at, self.values))
        self.values += len(values)
        self._put(pack(values.astype(np.uint64)))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = self.at
        self._put(np.array(self.ids, "<i8").tobytes() + bytes(self.valid) + np.array(self.counts, "<i8").tobytes())
        table = self.at
        self._put(np.array(self.blocks, "<u8").tobytes())
        self._put(TAIL.pack(docs, len(self.ids), table, len(self.blocks), MAGIC))
        self.stream.close()


def documents_of(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids as uint64) of every document of an open shard file, block by block."""
    end = file.size()
    docs, n_docs, table, n_blocks, magic = TAIL.unpack(file.read_at(TAIL.size, end - TAIL.size))
    if magic != MAGIC or file.read_at(8, 0) != MAGIC:
        raise ValueError("not a token file")
    index = file.read_at(17 * n_docs, docs)
    ids, valid, counts = np.frombuffer(index, "<i8", n_docs), index[8 * n_docs : 9 * n_docs], np.frombuffer(index, "<i8", n_docs, 9 * n_docs)
    offsets = [*np.frombuffer(file.read_at(16 * n_blocks, table), "<u8").reshape(-1, 2)[:, 0].tolist(), docs]
    at, held = 0, np.zeros(0, np.uint64)
    for i, n in enumerate(counts.tolist()):
        parts, have = [held], len(held)
        while have < n:
            parts.append(unpack(file.read_at(offsets[at + 1] - offsets[at], offsets[at])))
            have += len(parts[-1])
            at += 1
        everything = np.concatenate(parts) if len(parts) > 1 else held
        yield int(ids[i]) if valid[i] else None, everything[:n]
        held = everything[n:]


def write(documents: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes shard files in ascending id order; returns the table (shard, path, n_docs, n_tokens).

    A shard is a range of ids. Null ids come first, rows that repeat an id stand in the order of their texts, null text is
    empty; a document of any length is written block by block. An empty table gives no file. Other columns do not matter,
    whatever their names. The table names the files of committed tasks only; a task that runs twice leaves an unread file.
    """
    folder = scratch(documents.sparkSession, "tokens")

    def run(batches):
        from pyspark import TaskContext

        path, out, docs, tokens = f"{folder}/{uuid.uuid4().hex}.s8b", None, 0, 0
        for keys, data in encoded(batches, tokenizer, end):
            out = out or Writer(opened(path, "w"))
            for key, ids in zip(keys, data, strict=True):
                out.add(key, np.frombuffer(ids, "<u4"))
                docs, tokens = docs + 1, tokens + len(ids) // 4
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(rows.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "token-index")


def read(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the shard files, decoded; start counts all ids before it.

    The window runs over one row per shard file.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                where, name = located(path)
                rows, at = [], first
                with where.open_input_file(name) as file:
                    for key, ids in documents_of(file):
                        rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])

    dealt = shards.withColumn("first", before).select("path", "first").repartition(max(1, shards.count()), "path")
    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
