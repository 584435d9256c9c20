"""Token ids in compressed binary files (operator 10).

A file holds consecutive documents in ascending order of doc_id:

    magic "QTOK0001" | flags u32 (1: 32-bit ids) | n documents u32 | SHA-256 of the dictionary (32 bytes)
    | ids before it in its partition u64 | doc_id i64 * n | null flags u8 * n | ids u32 * n | frame ends u64 * n
    | frames

Each document's id array is one zstandard frame, compressed with one dictionary that was trained on serialized id
arrays of a bounded sample, so a short document can be read alone: index entry, one frame, no other.
Files are cells of a table in the shared folder, because executors reach a shared store only through Spark; its
writer's commit protocol makes them survive lost executors.

Defined cases. Null text is empty and holds the end id only. A null doc_id sorts first. Rows with equal doc_id keep all
their documents, next to each other in any order. Any table without rows gives no file. With too few samples
to train on, the dictionary is empty. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, hash_sample, lean, ranges_for, slices, stored
from quern.llm.tokens import END_ID, default_tokenizer, encoder

_HEAD = struct.Struct("<8sII32sQ")
_MAGIC = b"QTOK0001"
#: Documents that the dictionary is trained on at most, each whole, and its bytes.
SAMPLE_DOCS, DICTIONARY_BYTES = 1500, 65_536
LEVEL = 1
#: Bytes of frames and documents after which a file is closed.
FILE_BYTES, FILE_DOCS = 8 << 20, 20_000
FILES = "part int, file int, first_id long, n_docs int, n_ids long, content binary"


def serialized(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from whole documents of smallest hash, SAMPLE_DOCS of them at most."""
    import zstandard

    rows = hash_sample(docs.select("doc_id", "text"), F.xxhash64("doc_id"), SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: (r["doc_id"] or 0, r["text"] or ""))
    own = encoder(path)
    samples = [serialized(x, own.wide) for x in own.encode([r["text"] or "" for r in rows]) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class FileWriter:
    """Gathers documents and hands out whole files."""

    def __init__(self, dictionary: bytes, wide: bool):
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True).compress
        self._hash, self._wide = hashlib.sha256(dictionary).digest(), wide
        self.before = self._files = 0
        self._clear()

    def _clear(self) -> None:
        self._ids: list[int | None] = []
        self._counts: list[int] = []
        self._frames: list[bytes] = []
        self._bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._compress(serialized(ids, self._wide))
        self._ids.append(doc_id)
        self._counts.append(len(ids) // 4)
        self._frames.append(frame)
        self._bytes += len(frame)

    @property
    def full(self) -> bool:
        return self._bytes >= FILE_BYTES or len(self._ids) >= FILE_DOCS

    def close(self) -> tuple[int, int, int, int, bytes] | None:
        """file, first_id, n_docs, n_ids, content."""
        n = len(self._ids)
        if not n:
            return None
        content = b"".join(
            [
                _HEAD.pack(_MAGIC, int(self._wide), n, self._hash, self.before),
                np.array([x or 0 for x in self._ids], dtype="<i8").tobytes(),
                np.array([x is None for x in self._ids], dtype="u1").tobytes(),
                np.array(self._counts, dtype="<u4").tobytes(),
                np.cumsum([len(x) for x in self._frames], dtype="<u8").tobytes(),
                *self._frames,
            ]
        )
        out = (self._files, self.before, n, sum(self._counts), content)
        self.before += sum(self._counts)
        self._files += 1
        self._clear()
        return out


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, content: bytes, dictionary: bytes):
        import zstandard

        magic, flags, self.n, digest, self.before = _HEAD.unpack_from(content)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        at = _HEAD.size
        self._content, self._kind = content, "<u4" if flags & 1 else "<u2"
        self.doc_ids = np.frombuffer(content, "<i8", self.n, at)
        self.nulls = np.frombuffer(content, "u1", self.n, at := at + 8 * self.n)
        self.counts = np.frombuffer(content, "<u4", self.n, at := at + self.n)
        self._ends = np.frombuffer(content, "<u8", self.n, at := at + 4 * self.n)
        self._frames = at + 8 * self.n
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._decompress = zstandard.ZstdDecompressor(dict_data=data).decompress

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own frame."""
        a, b = int(self._ends[k - 1]) if k else 0, int(self._ends[k])
        return np.frombuffer(self._decompress(self._content[self._frames + a : self._frames + b]), self._kind).astype("<u4")


def write_files(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, bytes]:
    """The table of files (columns of FILES) and the dictionary that reading needs."""
    bounded_batches(docs.sparkSession)
    path = path or default_tokenizer()
    dictionary = train_dictionary(docs, path)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, end = encoder(path), TaskContext.get().partitionId(), struct.pack("<I", END_ID)
        writer = FileWriter(dictionary, own.wide)

        def closed() -> Iterator[pa.RecordBatch]:
            if row := writer.close():
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ["part", "file", "first_id", "n_docs", "n_ids", "content"]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, *row), kinds, strict=True)], names)

        for batch in batches:
            for piece in slices(batch, 512, "text"):
                texts = [x or "" for x in piece.column(1).to_pylist()]
                for doc_id, ids in zip(piece.column(0).to_pylist(), own.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
                    if writer.full:
                        yield from closed()
        yield from closed()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(ranges_for(docs.sparkSession, size), F.col("doc_id").asc_nulls_first(), F.rand(5))  # rand parts equal ids
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    return stored(ordered.mapInArrow(lean(write), FILES), "token-files"), dictionary


def read_files(files: DataFrame, dictionary: bytes, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    spark = files.sparkSession
    base, before = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        base[r["part"]] = before
        before += r["n"]
    starts = spark.createDataFrame(sorted(base.items()), "part int, base long")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = FileReader(content.as_py(), dictionary)
                start = base + file.before + np.concatenate([[0], np.cumsum(file.counts, dtype="i8")])[:-1]
                for a in range(0, file.n, 2000):
                    b = min(file.n, a + 2000)
                    ids = [file.ids(k).tobytes() for k in range(a, b)]
                    cols = [
                        pa.array(file.doc_ids[a:b], pa.int64(), mask=file.nulls[a:b].astype(bool)),
                        pa.array(start[a:b], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names)

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.join(starts, "part").select("base", "content").mapInArrow(lean(read), shape)
