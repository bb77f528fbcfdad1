"""A written table of text blocks, for operators that pass over all texts again.

A row holds the texts of some documents (a few MB, compressed), their doc_ids
and their offsets.  The table is bucketed by the block's number, so data about
blocks can be joined to it time and again while only that data is shuffled;
the texts move once, into the table.  It lies in the warehouse, which driver
and executors share, and ``drop`` removes it when a result has been written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import short_batches, shuffle_partitions, text_views

#: Stands for a null doc_id in the order of documents: after all others.
LAST = np.iinfo(np.int64).max
SCHEMA = "block long, ids binary, absent binary, offsets binary, texts binary"


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as each may hold some MB."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Block:
    """One row of the table, unpacked."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.absent = np.frombuffer(row["absent"], bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(self.offsets[-1]) + 1)
        self.data = np.frombuffer(self.raw, np.uint8)

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.absent)


def _block_batches(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get(), 0
    own: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def row() -> pa.RecordBatch:
        sizes = np.concatenate([s for _, _, s, _ in own])
        texts = zstandard.ZstdCompressor(level=1).compress(b"".join(d.tobytes() for _, _, _, d in own))
        parts = [np.concatenate([x[0] for x in own]).tobytes(), np.concatenate([x[1] for x in own]).tobytes(), np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes(), texts]
        columns = [pa.array([(task.partitionId() << 32) + number]), *[pa.array([p], pa.binary()) for p in parts]]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "absent", "offsets", "texts"])

    for batch in batches:
        data, offsets = text_views(batch.column("text"))
        ids = batch.column("doc_id")
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(LAST).to_numpy()
        at = 0
        while at < len(ids):  # as many documents as the block still takes, one at least
            to = int(np.searchsorted(offsets, offsets[at] + max(block_bytes - size, 0), side="right")) - 1
            to = min(len(ids), max(at + (not own), to))
            if to > at:
                own.append((ids[at:to].astype(np.int64), absent[at:to], np.diff(offsets[at : to + 1]), data[offsets[at] : offsets[to]].copy()))
                size += int(offsets[to] - offsets[at])
                at = to
            if at < len(ids) or size >= block_bytes or sum(len(x[0]) for x in own) >= 65536:
                yield row()
                own, size, number = [], 0, number + 1
    if own:
        yield row()


class BlockStore:
    """The written table; ``with_data`` reads it beside data about its blocks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def write(cls, docs: DataFrame, block_bytes: int) -> BlockStore:
        spark = docs.sparkSession
        short_batches(spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        buckets = max(shuffle_partitions(spark), rows.rdd.getNumPartitions())
        name = f"text_blocks_{uuid.uuid4().hex[:16]}"
        blocks = rows.mapInArrow(lambda it: _block_batches(it, block_bytes), SCHEMA)
        blocks.write.format("parquet").option("compression", "none").bucketBy(min(buckets, 50_000), "block").saveAsTable(name)
        return cls(spark, name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def beside(self, lists: DataFrame) -> DataFrame:
        """All blocks, each with its row of ``lists`` if there is one."""
        return self.table().join(lists.hint("shuffle_hash"), "block", "left")

    def with_data(self, data: DataFrame) -> DataFrame:
        """All blocks, with the list ``found`` of the blobs that ``data`` (block, blob) has of each."""
        return self.beside(data.groupBy("block").agg(F.collect_list("blob").alias("found")))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
