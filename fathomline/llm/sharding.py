"""Shards of near-equal bytes by histogram sort, in DataFrame operations alone.

Rows are sorted by a key: the MD5 of the text, then a hash of the doc_id, then
a number of the row, as hexadecimal digits.  Rounds of exact counting refine
the probes: the first histogram counts rows and bytes below every prefix of
the key of a few digits; each later round splits only the *open* prefixes (past
the digits that all their keys share), those that hold a splitter more loosely than the tolerance, or more rows than
one task should sort.  When no prefix is open, every splitter is known, and so
is the number of rows below every remaining prefix (a leaf).  Rows are then
exchanged once, by leaf; a slot is the leaf's offset in its shard plus the
row's place in the leaf.

Equal texts are neighbours in the order, so a group of copies is cut only where
a splitter falls into it; a group with a third of all rows is spread over as
many leaves and shards as its bytes ask for.  The driver sees only counts of
prefixes, at most 16 ** 5 in the first round and 256 for each open one later.

Edge cases: a null text has size 16 and the CRC of no bytes; a null doc_id is
hashed like any value; repeated rows get places of their own; with fewer rows
than shards some shards are empty; an empty table gives no rows; extra columns
are ignored (and kept by ``sharded``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import boxed, materialize

SHARDS = 40
OVERHEAD = 16
#: Bytes by which a splitter may miss its target, as a share of a shard.
TOLERANCE = 0.001
#: Rows of a leaf beyond which it is split (or a thousandth of all rows, if more).
LEAF_ROWS = 50_000
STEP = 2
KEY_DIGITS = 64
BROADCAST_LEAVES = 100_000


class Leaf(NamedTuple):
    prefix: str
    rows: int
    bytes: int
    shard: int
    offset: int  # rows of the shard below it


def _digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.concat(F.md5(raw), _digits(F.xxhash64("doc_id")), _digits(F.monotonically_increasing_id()))
    return docs.select("doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("key"))


def _counts(keys: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    """Prefix, rows, bytes, and the digits that all its keys share."""
    sums = keys.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
    places = F.sequence(F.lit(1), F.lit(KEY_DIGITS))
    shared = F.size(F.filter(places, lambda i: F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i)))
    return [(r.prefix, r.n, r.size, r.shared) for r in sums.select("prefix", "n", "size", shared.alias("shared")).collect()]


def histogram(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, leaf_rows: int = LEAF_ROWS) -> tuple[list[Leaf], list[tuple[int, list[str]]]]:
    """The leaves in key order, and the length of each round's prefixes with the open ones."""
    digits = 3
    bins = _counts(keys, digits)
    n_rows, total = sum(b[1] for b in bins), sum(b[2] for b in bins)
    while digits < 5 and n_rows >> (4 * digits) > leaf_rows // 5:
        digits += 1
        bins = _counts(keys, digits)
    most, loose = max(leaf_rows, n_rows // 1000), tolerance * total / shards
    opened: list[tuple[int, list[str]]] = []
    fresh = {b[0] for b in bins}
    while True:
        bins.sort()
        below, wide = 0, []
        for prefix, rows, size, _ in bins:
            splits = (below * shards) // total != ((below + size) * shards - 1) // total
            if prefix in fresh and rows > 1 and (rows > most or (splits and size > loose)):
                wide.append(prefix)
            below += size
        if not wide or digits >= KEY_DIGITS:
            break
        opened.append((digits, wide))
        inside = keys.where(F.substring("key", 1, digits).isin(wide))
        gone = set(wide)
        digits = min(KEY_DIGITS, min(b[3] for b in bins if b[0] in gone) + STEP)
        parts = _counts(inside, digits)
        fresh = {p[0] for p in parts}
        bins = [b for b in bins if b[0] not in gone] + parts
    leaves, below, shard, offset = [], 0, 0, 0
    for prefix, rows, size, _ in bins:
        own = min(shards - 1, (2 * below + size) * shards // (2 * total))
        shard, offset = own, offset if own == shard else 0
        leaves.append(Leaf(prefix, rows, size, shard, offset))
        below, offset = below + size, offset + rows
    return leaves, [*opened, (digits, [])]


def _leaf(rounds: list[tuple[int, list[str]]]) -> Column:
    """The leaf of a row: its shortest prefix that was not opened."""
    out = F.substring("key", 1, rounds[-1][0])
    for length, prefixes in reversed(rounds[:-1]):
        own = F.substring("key", 1, length)
        out = F.when(own.isin(prefixes), out).otherwise(own)
    return out


def placed(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``keys`` with shard and slot; ``keys`` must be written, for its row numbers to stay."""
    leaves, rounds = histogram(keys, shards, tolerance, leaf_rows)
    known = keys.sparkSession.createDataFrame([(x.prefix, x.shard, x.offset) for x in leaves], "leaf string, shard int, offset long")
    rows = keys.withColumn("leaf", _leaf(rounds))
    rows = rows.join(F.broadcast(known) if len(leaves) <= BROADCAST_LEAVES else known, "leaf")
    place = F.row_number().over(Window.partitionBy("leaf").orderBy("key"))
    return rows.withColumn("slot", F.col("offset") + place - 1).drop("leaf", "offset")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    rows = placed(materialize(keyed(docs), "keys"), shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Struct ``row`` of all columns of a document, its shard and its slot."""
    boxes = docs.select(boxed(docs).alias("row"), F.col("doc_id"), F.col("text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.concat(F.md5(raw), _digits(F.xxhash64("doc_id")), _digits(F.monotonically_increasing_id()))
    rows = boxes.select("row", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), key.alias("key"))
    return placed(materialize(rows, "keyed"), shards).select("row", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """A folder of Parquet files for each shard below ``path``, rows with their slots."""
    sharded(docs, shards).select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
