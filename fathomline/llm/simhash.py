"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is the bitwise majority of the XXH64 values of a text's
word shingles.  Two fingerprints that differ in at most 3 bits have a 32-bit
half in which they differ in at most one.  Each half is covered by a code: the
perfect [31, 26] Hamming code on 31 bits, times both values of the last bit,
so every half lies within one bit (the covering radius) of an anchor.  A half
is *home* at that anchor and is replicated to all (2 or 17) anchors within
radius + 1 bits.  If x and y differ in one bit of the half, y is among the
replicas at x's home, so comparing homes with replicas anchor by anchor finds
every link; each is verified on all 64 bits.

Equal fingerprints are one node from the start, so copies make no pairs.  An
anchor gives a spanning forest of its links, at most one edge a node, which
keeps large groups linear.  Components come from alternating large-star and
small-star steps on written tables.

Edge cases: a null text counts as empty; a wordless text has fingerprint zero
and links like any other; fewer words than a shingle form one shingle; rows
without a doc_id link (and bridge others) like any, but a component_id is null
only if no member has one; repeated rows come back as often as they came;
extra columns are ignored.  ``near`` removes near copies by these links and by
the sets of five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from fathomline.llm.common import LOWER, boxed, gives_back, materialize, small_batches

SHINGLE = 3
SEED = 42
#: Differing bits of a link.  The cover below is made for three.
THRESHOLD = 3
CHUNK = 1 << 19
#: Comparisons of one anchor done at once.
BLOCK_PAIRS = 1 << 20
#: Nodes of a task's forest before it begins anew (which costs links twice, never one less).
FOREST_NODES = 1_000_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    words = text.translate(LOWER).split()
    if len(words) < shingle:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return list(map(xxh64_intdigest, map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)), repeat(SEED)))


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``counts`` hashes: bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.r_[0, np.cumsum(counts[full])[:-1]]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = sums * 2 > counts[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_batches(whole, CHUNK):
            hashes = [shingle_hashes((t or "").encode(), shingle) for t in batch.column("text").to_pylist()]
            counts = np.array([len(h) for h in hashes], np.int64)
            values = np.fromiter((h for own in hashes for h in own), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(majority(values, counts).view(np.int64))], ["row", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The struct ``row`` of a document's other columns, and its fingerprint as long ``fp``."""
    rows = docs.select(boxed(docs, "text").alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, shingle), schema)


# -- the cover ---------------------------------------------------------------


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Position (1 to 31) of the bit that leads to the code word, or 0."""
    out = np.zeros(len(half), np.uint64)
    for j, mask in enumerate((0x55555555, 0x66666666, 0x78787878, 0x7F807F80, 0x7FFF8000)):
        out |= (np.bitwise_count(half & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    return out


def home(half: np.ndarray) -> np.ndarray:
    """The anchor within one bit of each 32-bit value."""
    s = _syndrome(half)
    return np.where(s > 0, half ^ (np.uint64(1) << (np.maximum(s, 1) - np.uint64(1))), half)


def replicas(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``half`` and anchor, for every anchor within two bits."""
    s, own, top = _syndrome(half), home(half), np.uint64(1 << 31)
    at = np.arange(len(half))
    rows, anchors = [at, at], [own, own ^ top]
    away = s > 0
    for i in range(1, 32):  # bits i and i ^ s lead to a code word as well
        j = np.uint64(i) ^ s
        ok = away & (j > i) & (j != 0)
        rows.append(at[ok])
        anchors.append(half[ok] ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (j[ok] - np.uint64(1))))
    return np.concatenate(rows), np.concatenate(anchors)


NODE = "key long, fp long, node long"


@gives_back
def _cover_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Home and replica rows of each (fp, node).

    The key holds half, anchor, and whether the row is a replica, so that rows
    sorted by it have the homes of an anchor first.
    """
    for batch in batches:
        fp, node = np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("node"))
        for k in (0, 1):
            half = (fp >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)
            own = home(half)
            rows, anchors = replicas(half)
            index = np.concatenate([np.arange(len(fp)), rows])
            anchor = np.concatenate([own, anchors]).view(np.int64) | (k << 32)
            columns = [anchor << 1 | (np.arange(len(index)) >= len(fp)), fp[index].view(np.int64), node[index]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "node"])


class Forest:
    """Union-find that tells whether a link is new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _linked(key: np.ndarray, fp: np.ndarray, node: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among whole anchors as (a, b); rows are sorted by key."""

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero((node[x] != node[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= threshold))
        a, b = node[x[i]], node[y[i]]
        return np.minimum(a, b), np.maximum(a, b)

    anchor, replica = key >> 1, (key & 1).astype(bool)
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    homes = np.add.reduceat((~replica).astype(np.int64), starts)
    others = sizes - homes
    small = (homes > 0) & (homes * others <= 256)
    h, o, s = homes[small], others[small], starts[small]
    n = h * o
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    yield near(s[group] + k // o[group], s[group] + h[group] + k % o[group])
    for i in np.flatnonzero((homes > 0) & (homes * others > 256)).tolist():
        first, mid, last = int(starts[i]), int(starts[i] + homes[i]), int(starts[i] + sizes[i])
        step = max(1, BLOCK_PAIRS // (last - mid))
        for p in range(first, mid, step):
            q = min(mid, p + step)
            yield near(np.repeat(np.arange(p, q), last - mid), np.tile(np.arange(mid, last), q - p))


@gives_back
def _compare_batches(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Compare anchor by anchor; the last anchor of a batch waits for the next batch."""
    held: list[list[np.ndarray]] = []
    forest = Forest()

    def emit(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        edges = [(a, b) for found in _linked(*columns, threshold) for a, b in zip(*(x.tolist() for x in found), strict=True) if forest.join(a, b)]
        if len(forest.up) > FOREST_NODES:
            forest.up.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [np.asarray(batch.column("key")), np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("node"))]
        first, last = own[0][0] >> 1, own[0][-1] >> 1
        cut = int(np.searchsorted(own[0], last << 1))
        if first != last or (held and held[-1][0][-1] >> 1 != first):
            yield emit([*held, [x[:cut] for x in own]])
            held = []
        held.append([x[cut:].copy() for x in own])
    if held:
        yield emit(held)


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect all ``node``s whose ``fp`` differ in few bits.

    A forest of each partition's links: no link between different fingerprints
    is lost for the components, and none appears that is not real.
    """
    covered = nodes.select("fp", "node").mapInArrow(_cover_batches, NODE)
    dealt = covered.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _compare_batches(it, threshold), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge but the components themselves; component is the smallest node reachable.

    Alternating large-star and small-star steps; each writes its edges, whose
    number never grows, and the loop ends when a round changes nothing.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).select("a", "b"), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def classes(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Struct ``row``, ``fp`` and ``component_id`` (smallest doc_id reachable) per row of ``docs``."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("row.doc_id").alias("low")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), threshold)).withColumnRenamed("node", "fp")
    labelled = materialize(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "labels")
    lows = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    named = labelled.join(lows, "component").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("row", "fp", "component_id")


def report(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    found = classes(docs.select("doc_id", "text"), threshold, shingle)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
