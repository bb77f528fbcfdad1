"""Shared pieces of the training-data operators: tables, shared storage, batches.

Intermediate results that cut lineage are Parquet files below the folder that
``spark.checkpoint.dir`` names, which driver and executors share; they survive
the loss of any executor.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no checkpoint folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/fathomline"

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 400

#: Upper-case ASCII to lower case; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, from ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or LOCAL_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/fathomline-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, as rows of texts are long.

    A batch is held several times over (JVM, pipe, worker).  A number that the
    session's owner has chosen stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def boxed(df: DataFrame, *apart: str) -> Column:
    """All columns but those ``apart`` as one struct, so that their names clash with none.

    What is boxed goes to Python with its text, so batches are made short.
    """
    short_batches(df.sparkSession)
    rest = [f for f in df.columns if f not in apart]
    return F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))


def unboxed(df: DataFrame, columns: list[str], *apart: str, box: str = "row") -> DataFrame:
    """``columns`` in their order, from the struct ``box`` or from those ``apart``."""
    return df.select(*[F.col(f"`{c}`") if c in apart else F.col(f"{box}.`{c}`").alias(c) for c in columns])


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of a key as decimal text, modulo; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gives_back(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A batch function after whose end the (reused) Python worker returns its free memory."""

    @wraps(f)
    def run(*args: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def text_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return data[lo:hi], (offsets - lo) if len(column) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``size`` bytes; a longer row is a run of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def small_batches(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``size`` bytes of text each."""
    if batch.num_rows:
        offsets = text_views(batch.column(batch.schema.get_field_index(column)))[1]
        for a, b in pieces(offsets, size):
            yield batch.slice(a, b - a)
