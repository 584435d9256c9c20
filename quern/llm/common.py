"""Shared-folder tables, null-safe keys and small helpers of the operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers each up to which one side of a join is broadcast: some 40 MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is taken, which only a local master can share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, any executor may be lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/quern-" in at.toString():
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is counted and found small enough, to be joined by shuffle beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows and bytes of the Arrow batches that workers get and hand on.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to these bounds, so that the memory of tasks does not follow the length of texts."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch, rows: int = 512, column: str | int | None = None, size: int = BATCH_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of so many rows and, if a column of texts or bytes is named, about so many bytes of it, at most."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        if column is None:
            yield part
            continue
        total = np.cumsum(pc.binary_length(part.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield part.slice(a, b - a)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def lean(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same; what a task has used goes back to the system in the end, since worker processes outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := _trim()) is not None:
                trim(0)

    return run


def hash_sample(df: DataFrame, hashed: Column, rows: int) -> DataFrame:
    """About that many rows, those of smallest hash, and no more; all of a smaller table.

    The cut is taken from a count, so no task sends more than its share.
    """
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows)


#: Bytes that a range should hold at most.
RANGE_BYTES = 64 << 20


def ranges_for(spark: SparkSession, size: int | None) -> int:
    """Ranges for so many bytes: as many as the session's shuffles have partitions, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))


def key_of(column: Column) -> Column:
    """A string that is never null and differs for null and every value."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
