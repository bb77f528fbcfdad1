"""Token ids as binary files of compressed planes, written and read by Spark.

Documents are dealt by ranges of doc_id, sorted, encoded and appended to files of
bounded size, so files in order of (part, seq) hold the ids in ascending doc_id
order.  A file is one value:

* a head of eight big-endian 8-byte fields: mark, part, seq, documents, ids,
  ids a block, place and size of the index;
* the blocks: ids as 32-bit numbers, transposed so that bit (or byte) k of all ids
  of a block lies together, each plane compressed by zstandard; empty planes, those
  of zeros only, take no bytes;
* the documents: ids, nulls and token counts, compressed;
* the chunk index (zstandard): for each block its place, ids, checksum and the sizes
  of its planes.  A block is read by its range alone (``Reader``);
* a final newline, which Spark's writer of single values appends.

Spark's own writer and committer store the files, on any file system that Spark
knows, and ``binaryFile`` reads them, so a lost executor or a second attempt leaves
no half file.  Where a file starts in the whole sequence is a prefix sum over the
counts in the heads: by part on the driver (as many numbers as partitions), by seq
in a window.

Edge cases: a null or empty text is its end id alone; a null doc_id comes first;
rows of one doc_id follow each other by a hash of their text, equal ones in the
order read, and are dealt to several parts where they are many; a text of any
length lies whole in one file (a file ends with the first document that fills it);
extra columns are ignored; an empty table gives one file without documents or none.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.common import gives_back, shared_dir, short_batches, shuffle_partitions
from fathomline.llm.wordwise import Cut, Words, byte_level, gathered, in_chunks, runs

VOCABULARY, END = "byte_bpe_50k.json", 2
MARK = b"FLPLANES"
HEAD = struct.Struct(">8s7q")
#: Ids of a block and, at most but for the last document, of a file.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 21
#: Bytes of text encoded at once.
CHUNK = 1 << 23
LEVEL = 3


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of some ids: 32 of bits or 4 of bytes."""
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes() if (ids >> np.uint32(k)).any() else b"" for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of planes; an empty plane is one of zeros."""
    out = np.zeros(n, np.uint32)
    width = 32 // len(planes)
    for k, plane in enumerate(planes):
        if plane:
            part = np.frombuffer(plane, np.uint8)
            part = np.unpackbits(part, count=n) if width == 1 else part
            out |= part.astype(np.uint32) << np.uint32(width * k)
    return out


def pack(part: int, seq: int, docs: list[tuple[int | None, np.ndarray]], bits: bool = False, block_ids: int = BLOCK_IDS) -> bytes:
    """A whole file of some documents."""
    zip_ = zstandard.ZstdCompressor(level=LEVEL).compress
    ids = np.concatenate([x for _, x in docs]).astype("<u4") if docs else np.zeros(0, "<u4")
    blobs, index, at = [], [], HEAD.size
    for first in range(0, len(ids), block_ids):
        own = ids[first : first + block_ids]
        planes = [zip_(p) if p.strip(b"\0") else b"" for p in to_planes(own, bits)]
        index.append([at, len(own), zlib.crc32(own.tobytes()), *map(len, planes)])
        blobs += planes
        at += sum(map(len, planes))
    rows = np.array([[0 if i is None else i, i is None, len(x)] for i, x in docs], "<i8").reshape(-1, 3)
    listed = zip_(np.ascontiguousarray(rows.T).tobytes())
    table = zip_(np.array([[at, len(listed), 0, *[0] * (32 if bits else 4)], *index], "<i8").tobytes())
    head = HEAD.pack(MARK, part, seq, len(docs), len(ids), block_ids, at + len(listed), len(table))
    return b"".join([head, *blobs, listed, table])


class Reader:
    """A file by ranges: ``fetch(start, size)`` gives its bytes."""

    def __init__(self, fetch):
        self.fetch, unzip = fetch, zstandard.ZstdDecompressor().decompress
        mark, self.part, self.seq, self.n_docs, self.n_ids, self.block_ids, place, size = HEAD.unpack(fetch(0, HEAD.size))
        if mark != MARK:
            raise ValueError("not a file of planes")
        table = np.frombuffer(unzip(fetch(place, size)), "<i8")
        blocks = -(-self.n_ids // self.block_ids)
        table = table.reshape(blocks + 1, -1)
        self.index = table[1:]
        rows = np.frombuffer(unzip(fetch(int(table[0, 0]), int(table[0, 1]))), "<i8").reshape(3, -1)
        self.doc_ids = [None if null else int(i) for i, null in zip(rows[0], rows[1], strict=True)]
        self.starts = np.r_[0, np.cumsum(rows[2])]

    def block(self, k: int) -> np.ndarray:
        """The ids of one block, from its range alone; its checksum must hold."""
        at, n, crc, *sizes = self.index[k].tolist()
        data, planes, unzip = self.fetch(at, sum(sizes)), [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            planes.append(unzip(data[:size]) if size else b"")
            data = data[size:]
        ids = from_planes(planes, n).astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} of file {self.part}/{self.seq} is damaged")
        return ids

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end`` of the file, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = start // self.block_ids, (end - 1) // self.block_ids
        return np.concatenate([self.block(k) for k in range(a, b + 1)])[start - a * self.block_ids : end - a * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document; a block is decoded once for all documents in it."""
        k, held = 0, np.zeros(0, "<u4")
        for i, n in zip(self.doc_ids, np.diff(self.starts).tolist(), strict=True):
            parts, left = [], n
            while left:
                if not len(held):
                    held, k = self.block(k), k + 1
                parts.append(held[:left])
                held, left = held[left:], left - len(parts[-1])
            yield i, np.concatenate(parts) if parts else np.zeros(0, "<u4")


def encoder(path: str):
    """A function from texts (no nulls) to the ids of each."""
    own = byte_level(path, True)
    words = Words(own.words, own.marks)

    def encode(texts: pa.Array) -> list[np.ndarray]:
        cut = Cut(texts)
        found = words.of(cut.words)
        lost = cut.texts_with(np.array([x is None for x in found], bool))
        ids, ends = gathered([x or b"" for x in found], cut.index)
        ends, out = ends[cut.offsets], []
        for i, first in enumerate(cut.first):
            if lost[i] or any(m in first for m in own.marks):
                out.append(np.frombuffer(b"".join([own.encode(r) for r in runs(texts[i].as_py())]), "<u4"))
            else:
                rest = ids[ends[i] : ends[i + 1]]
                out.append(np.concatenate([np.frombuffer(own.encode(first), "<u4"), rest]) if first else rest)
        return out

    return encode


@gives_back
def _file_batches(batches: Iterator[pa.RecordBatch], path: str, end: int, bits: bool) -> Iterator[pa.RecordBatch]:
    encode, part = encoder(path), TaskContext.get().partitionId()
    held, size, seq, last = [], 0, 0, np.array([end], "<u4")

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(part, seq, held, bits)], pa.binary())], ["value"])

    for some in in_chunks(batches, CHUNK):
        for i, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text")), strict=True):
            held.append((i, np.concatenate([ids, last])))
            size += len(ids) + 1
            if size >= FILE_IDS:
                yield row()
                held, size, seq = [], 0, seq + 1
    if held:
        yield row()


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, bits: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) and write files of planes, in ascending doc_id order, to a new folder."""
    path, spark = path or public_tokenizers.path(VOCABULARY), docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    parts = max(shuffle_partitions(spark), rows.rdd.getNumPartitions())
    key = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    rows = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("doc_id", "text")
    files = rows.mapInArrow(lambda it: _file_batches(it, path, end, bits), "value binary")
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _field(k: int):
    return F.conv(F.hex(F.substring("content", 8 * k + 1, 8)), 16, 10).cast("long")


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, n_docs, n_ids and first id (``start``) of each file."""
    found = spark.read.format("binaryFile").load(folder).where("length > 0")
    files = found.select(_field(1).alias("part"), _field(2).alias("seq"), _field(3).alias("n_docs"), _field(4).alias("n_ids"))
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.r_[0, np.cumsum([n for _, n in totals])].astype(int).tolist()
    firsts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before[:-1], strict=True)], "part long, before long")
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("own", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    return files.join(firsts, "part").select("part", "seq", "n_docs", "n_ids", (F.col("before") + F.col("own")).alias("start"))


@gives_back
def _document_batches(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["part", "seq", "doc_id", "own", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    for batch in batches:
        for i in range(batch.num_rows):
            raw = memoryview(batch.column("content")[i].as_buffer())
            file = Reader(lambda at, n, raw=raw: bytes(raw[at : at + n]))
            docs, size, at = [], 0, 0
            for k, (doc_id, ids) in enumerate(file.documents()):
                docs.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids))
                at, size = at + len(ids), size + len(ids)
                if size >= FILE_IDS // 4 and with_ids or len(docs) >= 10_000 or k == file.n_docs - 1:
                    d, s, n, c, x = zip(*docs, strict=True)
                    columns = [pa.array([v] * len(d), pa.int64()) for v in (file.part, file.seq)] + [pa.array(v, pa.int64()) for v in (d, s, n, c)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(x).astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    docs, size = [], 0


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document of the files in ``folder``."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    schema = "part long, seq long, doc_id long, own long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = files.mapInArrow(lambda it: _document_batches(it, with_ids), schema)
    starts = heads(spark, folder).select("part", "seq", "start")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from files written to the shared folder and read back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/planes-{uuid.uuid4().hex[:12]}"
    write(docs, folder, path)
    return read(spark, folder, with_ids=False)
