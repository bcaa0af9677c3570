"""SHA-256 over all rows of a key, in order, without a task that gathers the key's rows.

A digest of text after text can't be merged from parts, so the last step of a key is one stream. What leads to it is not:
rows come range-partitioned and sorted, and each partition closes the keys that lie wholly inside it. Only the keys at a
partition's ends, and those of over CHUNK bytes, are handed on, as chunks of bytes that one task then streams through the
digest. However many rows a key has, a task holds a chunk of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept

#: Bytes of a run that are held at once.
CHUNK = 1 << 20
_NAMES = ["key", "place", "closed", "counts", "parts"]


def run_schema(key_type: str) -> str:
    return f"key {key_type}, place bigint, closed boolean, counts array<bigint>, parts array<binary>"


def _batches(rows: Iterable[tuple], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [key_type, pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names=_NAMES)

    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row[4]))
        if size >= 2 * CHUNK:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _digest(data: bytes, trim: int) -> bytes:
    return hashlib.sha256(data[:len(data) - trim]).digest()


def run_rows(items: Iterable[tuple], key_type: pa.DataType, trim: int = 0, chunk: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of `run_schema` for a partition's items (key, counts, parts), which come key by key.

    Counts of a key are added up. Each part is a byte string; those of a key follow one another, less `trim` bytes at the
    very end. A closed row has the digests of its key, an open one has bytes.
    """
    chunk = CHUNK if chunk is None else chunk

    def rows() -> Iterator[tuple]:
        place = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        counts = parts = None
        key, first, whole, size = None, True, True, 0
        for item_key, item_counts, item_parts in items:
            if parts is not None and item_key != key:
                closed = whole and not first
                yield key, place, closed, counts, [_digest(p, trim) for p in parts] if closed else [bytes(p) for p in parts]
                place, first, parts = place + 1, False, None
            if parts is None:
                key, whole, size = item_key, True, 0
                counts, parts = [0] * len(item_counts), [bytearray() for _ in item_parts]
            for k, n in enumerate(item_counts):
                counts[k] += n
            for k, piece in enumerate(item_parts):
                parts[k] += piece
                size += len(piece)
            if size >= chunk:
                yield key, place, False, counts, [bytes(p) for p in parts]
                place, whole, size = place + 1, False, 0
                counts, parts = [0] * len(counts), [bytearray() for _ in parts]
        if parts is not None:
            yield key, place, False, counts, [bytes(p) for p in parts]

    return _batches(rows(), key_type)


def joined_runs(rows: DataFrame, trim: int = 0, scratch: list[str] | None = None) -> DataFrame:
    """(key, counts, parts): one row per key of `run_rows`' rows, its parts as 32-byte digests."""
    rows = kept(rows, "runs", scratch)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def chunks() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field("key").type]
                for k in range(batch.num_rows):
                    yield (batch["key"][k].as_py(), batch["counts"][k].as_py(), batch["parts"][k].as_py())

        def closed() -> Iterator[tuple]:
            key = counts = hashes = None
            for chunk_key, more, parts in chunks():
                if hashes is None or chunk_key != key:
                    if hashes is not None:
                        yield key, 0, True, counts, [_closed(*h, trim) for h in hashes]
                    key, counts, hashes = chunk_key, [0] * len(more), [[hashlib.sha256(), b""] for _ in parts]
                counts = [a + b for a, b in zip(counts, more)]
                for h, piece in zip(hashes, parts):
                    piece = h[1] + piece
                    h[0].update(piece[:len(piece) - trim])
                    h[1] = piece[len(piece) - trim:]
            if hashes is not None:
                yield key, 0, True, counts, [_closed(*h, trim) for h in hashes]

        first = next(stream := closed(), None)
        if first is not None:
            yield from _batches(_chained(first, stream), kind[0])

    opened = rows.where("not closed").repartition("key").sortWithinPartitions("key", "place")
    ends = opened.mapInArrow(join, run_schema(rows.schema["key"].dataType.simpleString()))
    return rows.where("closed").union(ends).select("key", "counts", "parts")


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _closed(digest, tail: bytes, trim: int) -> bytes:
    # What is held back is left off, unless there was less than that.
    if len(tail) < trim:
        digest.update(tail)
    return digest.digest()


def hex_digest(parts: str, k: int):
    return F.lower(F.hex(F.col(parts)[k]))
