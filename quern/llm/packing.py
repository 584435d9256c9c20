"""Packing documents into sequences along a Hilbert curve (operator 7).

A document's token ids are hashed into buckets, the bucket counts projected to DIMENSIONS coordinates with fixed
pseudo-random weights, and the coordinates, on a fixed scale, give its key on a Hilbert curve. Documents
are range-sorted by (key, doc_id); each range is one task that lays its documents end to end and cuts them at each
full sequence, so neighbours on the curve share sequences. The number of ranges grows with the ids. What is left at the end of a range is cut into sequences of
decreasing powers of two, which need no padding.

Defined cases. Null or empty text is a document of the end id alone. Equal rows are packed as often as they occur; copies
share a key and are told apart by doc_id, so ranges can cut a large group of them. Null doc_ids sort first. Very
long documents run through as many sequences as they need. An empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, lean, ranges_for, slices, stored
from quern.llm.token_files import serialized
from quern.llm.tokens import END_ID, default_tokenizer, encoder

DIMENSIONS, BITS, BUCKETS = 4, 15, 2048


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of rows of unsigned coordinates below 2 ** bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def projection(ids: int, seed: int = 11) -> np.ndarray:
    """A row of weights for each id: the weights of the bucket that the id is hashed to."""
    weights = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
    bucket = (np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return weights[bucket.astype(np.int64)]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, place (on the curve), n (ids), ids (serialized, with the end id)."""
    path = path or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, weights = encoder(path), struct.pack("<I", END_ID), None
        for batch in batches:
            for piece in slices(batch, 1024, "text"):
                raw = [x + end for x in own.encode([x or "" for x in piece.column(1).to_pylist()])]
                sums = np.empty((len(raw), DIMENSIONS))
                for k, x in enumerate(raw):
                    ids = np.frombuffer(x, dtype="<u4")
                    if weights is None or ids.max() >= len(weights):
                        weights = projection(max(65_536, int(ids.max()) + 1))
                    sums[k] = weights[ids].mean(axis=0)
                scaled = (0.5 + 0.5 * np.tanh(4 * sums)) * ((1 << BITS) - 1)
                cols = [
                    piece.column(0),
                    pa.array(hilbert_keys(scaled), pa.int64()),
                    pa.array([len(x) // 4 for x in raw], pa.int64()),
                    pa.array([serialized(x, own.wide) for x in raw], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "place", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(lean(encode), "doc_id long, place long, n long, ids binary"), "encoded")


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, path: str | None = None, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian 32-bit)."""
    bounded_batches(docs.sparkSession)
    ranged = encoded(docs, path)
    size = ranged.select(F.sum(F.octet_length("ids"))).first()[0]
    order = [F.col("place"), F.col("doc_id").asc_nulls_first()]
    spread = F.rand(5)  # parts rows that are equal in both
    ranged = ranged.repartitionByRange(ranges_for(docs.sparkSession, size), *order, spread).sortWithinPartitions(*order, F.crc32("ids"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        done: list[tuple] = []
        held: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, ids of the document
        filled = 0

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in pieces:
                row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
                done.append(row + (bytes(ids),) * with_ids)
                offset += len(ids) // 4
            sequence += 1

        def take(pieces: list[tuple], count: int) -> list[tuple]:
            """Removes count ids from the front of pieces."""
            out = []
            while count:
                doc_id, start, ids, total = pieces[0]
                n = min(count, len(ids) // 4)
                out.append((doc_id, start, ids[: 4 * n], total))
                count -= n
                pieces[:1] = [(doc_id, start + n, ids[4 * n :], total)] if 4 * n < len(ids) else []
            return out

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for piece in slices(batch, 512, "ids"):
                for doc_id, n, ids in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                    raw = ids if len(ids) == 4 * n else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                    at, raw = 0, memoryview(raw)
                    while at < n:
                        step = min(n - at, length - filled)
                        held.append((doc_id, at, raw[4 * at : 4 * (at + step)], n))
                        at += step
                        filled += step
                        if filled == length:
                            close(held)
                            held, filled = [], 0
                if done:
                    yield flush()
        for size in _powers(filled):
            close(take(held, size))
        if done:
            yield flush()

    shape = ", ".join(f"{x} long" for x in names[:7]) + ", ids binary" * with_ids
    return ranged.select("doc_id", "n", "ids").mapInArrow(lean(lay), shape)
