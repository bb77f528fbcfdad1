"""Near copies by sets of word shingles: SimHash anchors, and exact prefixes for what they miss.

Two texts are near copies if their sets of five-word shingles (64-bit hashes)
have a Jaccard similarity of ``SIMILARITY`` or more.  A class is what links of
near copies connect; ``dedup`` keeps one row of each.

1. Texts are written once as blocks; equal texts are one from here on.
2. One packed exchange of shingle hashes counts, for every shingle, the texts
   that hold it, and returns the power of two of that number to the blocks.  A
   text more than a fifth of whose shingles occur nowhere else has no near
   copy.  Only the others, the *open* texts, go on.
3. The anchor cover of ``simhash`` links open texts whose fingerprints differ in
   at most three bits.  Near copies at a similarity of 0.8 differ in about ten
   bits, more than any cover can reach, so these links do not suffice.
4. Every similar pair shares a shingle of both prefixes: the first
   ``size - ceil(0.8 size) + 1`` shingles in one order, rare ones first.
   Neighbours by size meet at each such shingle.
5. All links so far are verified on the whole sets.  Then texts that share a
   prefix shingle but are of different parts meet, unless a bound on their
   overlap rules them out: sizes, places in the prefixes, and the parities of
   hashed shingle counts, of which no more can differ than shingles do.  The
   closest of two parts come first, in slices that grow until parts are joined
   or all pairs have been tried.

Only verified links connect, and no pair is left out but for being connected
already or by exact bounds on the overlap, so the classes are those of all links.

Edge cases: a null text counts as empty, and texts without words are one class;
fewer words than a shingle form one shingle; rows with a null doc_id stay only
if no member of their class has one; of rows with equal doc_id and text one
stays; an empty table gives none; extra columns stay with their rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import gives_back, materialize, shuffle_partitions
from fathomline.llm.simhash import components, links, majority, shingle_hashes
from fathomline.llm.store import Block, BlockStore, rows

SHINGLE, SIMILARITY = 5, 0.8
BLOCK_BYTES = 8 << 20
#: Bytes of text whose shingles one range of hashes holds, about.
RANGE_BYTES = 8 << 20
#: Bits of a hash that are counted; the others only tell sets apart.
COUNTED = 48
#: The power of two of a shingle's texts from which on they are dealt to several groups, of about half as many.
SPREAD = 11
#: Texts of a shingle in one block; of a shingle with more, texts of different parts meet block by block.
GROUP = 4096
#: Pairs of two parts that meet at a shingle in the first slice, and the growth of slices.
SLICE, GROWTH = 8, 64
#: Pairs looked at at once, and those whose sketches are compared at once.
BLOCK_PAIRS, SKETCH_PAIRS = 1 << 19, 1 << 15
#: Bits of a sketch: the parities of the counts of shingles by hash.
SKETCH = 1024
HELD_ROWS = 1 << 17
FINGERPRINTED = 1 << 17
BROADCAST_ROWS = 200_000
_AT = 20  # bits of a node that count the texts of a block


def shingles(text: bytes) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; one of no words for a text without any."""
    return np.array(shingle_hashes(text, SHINGLE) or shingle_hashes(b"\xff", SHINGLE), np.uint64)


def prefix_size(size: int) -> int:
    return size - int(np.ceil(SIMILARITY * size - 1e-6)) + 1


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted counted hashes as differences, byte by byte."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return _packed(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, : COUNTED // 8].T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data), np.uint8).reshape(COUNTED // 8, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : COUNTED // 8] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


# -- texts -------------------------------------------------------------------


def _name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and number of every text of the blocks."""
    for row in rows(batches):
        block = Block(row)
        cuts = block.offsets.tolist()
        keys = [hashlib.sha256(block.raw[a:b]).digest()[:16] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        part, number = block.block >> 32, block.block & 0xFFFFFFFF
        node = (part << 24 + _AT) + (number << _AT) + np.arange(len(keys))
        columns = [pa.array(keys, pa.binary()), block.doc_ids(), pa.array(node), pa.array(np.full(len(keys), block.block)), pa.array(np.diff(block.offsets))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "node", "block", "size"])


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def distinct_texts(store: BlockStore) -> DataFrame:
    """key, the first row (by doc_id) that has the text, and the number n of rows, of each text.

    ``first.m`` counts the rows that share both the text and the first doc_id.
    """
    names = materialize(store.table().mapInArrow(_name_batches, "key binary, doc_id long, node long, block long, size long"), "names")
    same = names.groupBy("key", "doc_id").agg(F.count("*").alias("m"), F.min(F.struct("node", "block", "size")).alias("place"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "place", "m"))
    return materialize(same.groupBy("key").agg(first.alias("first"), F.sum("m").alias("n")), "texts")


# -- frequencies ---------------------------------------------------------------


def _own_sets(block: Block, own: list[int]) -> list[np.ndarray]:
    """Shingle hashes of the texts of a block that stand for their copies."""
    cuts = block.offsets
    return [shingles(block.raw[cuts[i] : cuts[i + 1]]) for i in (n & (1 << _AT) - 1 for n in own)]


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All counted hashes of the sets, sorted, and the number of sets that hold each."""
    flat = np.concatenate([np.unique(s) for s in sets]) >> np.uint64(64 - COUNTED)
    return np.unique(flat, return_counts=True)


def _range_batches(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of a block, cut into ranges."""
    limits = np.array([(k << COUNTED) // ranges for k in range(1, ranges)], np.uint64)
    for row in rows(batches):
        if not row["own"]:
            continue
        values, counts = _counted(_own_sets(Block(row), sorted(row["own"])))
        cuts = [0, *np.searchsorted(values, limits).tolist(), len(values)]
        own = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
        parts = [slice(cuts[k], cuts[k + 1]) for k in own]
        columns = [pa.array(own, pa.int32()), pa.array([row["block"]] * len(own), pa.int64()), pa.array([pack_sorted(values[p]) for p in parts], pa.binary()), pa.array([_packed(counts[p].astype("<u4").tobytes()) for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["range", "block", "hashes", "counts"])


def _power_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block and range: the power of two (bit length) of the number of texts that hold each hash."""
    held: list[dict] = []

    def answers() -> pa.RecordBatch:
        hashes = [unpack_sorted(r["hashes"]) for r in held]
        sizes = [len(h) for h in hashes]
        flat, counts = np.concatenate(hashes), np.concatenate([np.frombuffer(_unpacked(r["counts"]), "<u4") for r in held])
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        total = np.add.reduceat(counts[order].astype(np.int64), starts)
        powers = np.empty(len(flat), np.uint8)
        powers[order] = np.repeat((np.frexp(total.astype(np.float64))[1]).astype(np.uint8), np.diff(np.r_[starts, len(flat)]))
        blobs = [np.int64(r["range"]).tobytes() + _packed(p.tobytes()) for r, p in zip(held, np.split(powers, np.cumsum(sizes)[:-1]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r["block"] for r in held], pa.int64()), pa.array(blobs, pa.binary())], ["block", "blob"])

    for row in rows(batches):
        if held and row["range"] != held[0]["range"]:
            yield answers()
            held = []
        held.append(row)
    if held:
        yield answers()


NODE = "node long, size int, singles int, fp long, shingles binary, tokens binary, powers binary, sketch binary"


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of a set's hashes by their last bits; sets differ in as many elements at least as sketches in bits."""
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


@gives_back
def _open_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open texts: size, shingles held by no other text, fingerprint, set, and the prefix without the former."""
    for row in rows(batches):
        if not row["own"]:
            continue
        own = sorted(row["own"])
        sets = _own_sets(Block(row), own)
        values, _ = _counted(sets)
        found = sorted((int(np.frombuffer(b, np.int64, 1)[0]), b) for b in row["found"])
        powers = np.frombuffer(b"".join(_unpacked(b[8:]) for _, b in found), np.uint8)
        out: list[tuple] = []
        for node, every in zip(own, sets, strict=True):
            u = np.unique(every)
            power = powers[np.searchsorted(values, u >> np.uint64(64 - COUNTED))]
            singles, size = int((power == 1).sum()), prefix_size(len(u))
            if singles < size:
                shared = np.flatnonzero(power > 1)
                first = shared[np.argsort(power[shared], kind="stable")][: size - singles]
                fp = majority(every, np.array([len(every)])) if len(every) <= FINGERPRINTED else _long_majority(every)
                out.append((node, len(u), singles, int(fp.view(np.int64)[0]), u.tobytes(), u[first].tobytes(), power[first].tobytes(), sketch(u)))
        if out:
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
            names = [x.split()[0] for x in NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _long_majority(values: np.ndarray) -> np.ndarray:
    """The fingerprint of many hashes, bit by bit."""
    bits = [int((values >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(values) for b in range(64)]
    return np.array([sum(1 << b for b, on in enumerate(bits) if on)], np.uint64)


def open_texts(store: BlockStore, texts: DataFrame) -> DataFrame:
    """Texts that may have near copies, written once."""
    partitions = shuffle_partitions(store.spark)
    size = texts.agg(F.sum("first.place.size")).first()[0] or 0
    ranges = max(partitions, int(size) // RANGE_BYTES)
    own = texts.select("first.place.*").groupBy("block").agg(F.collect_list("node").alias("own"))
    blocks = store.beside(own)
    cut = blocks.mapInArrow(lambda it: _range_batches(it, ranges), "range int, block long, hashes binary, counts binary")
    dealt = cut.repartition(partitions, "range").sortWithinPartitions("range")
    powers = materialize(dealt.mapInArrow(_power_batches, "block long, blob binary"), "powers")
    answers = powers.groupBy("block").agg(F.collect_list("blob").alias("found"))
    return materialize(blocks.join(answers.hint("shuffle_hash"), "block").mapInArrow(_open_batches, NODE), "open")


# -- candidates ----------------------------------------------------------------

TOKEN = "token long, salt int, salts int, node long, size int, rest int"


def _mixed(node: np.ndarray) -> np.ndarray:
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)


def _token_batches(batches: Iterator[pa.RecordBatch], spread: int) -> Iterator[pa.RecordBatch]:
    """A row for each shared shingle of a prefix; ``rest`` counts it and those after it in the order.

    Texts of a very frequent shingle are dealt to several groups (``salts``).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            tokens = [np.frombuffer(x, np.int64) for x in part.column("tokens").to_pylist()]
            n = [len(t) for t in tokens]
            power = np.frombuffer(b"".join(part.column("powers").to_pylist()), np.uint8).astype(np.int64)
            node, size, singles = (np.repeat(np.asarray(part.column(c)), n) for c in ("node", "size", "singles"))
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if n else np.zeros(0, np.int32)
            salts = np.int64(1) << np.maximum(power - spread + 1, 0)
            token = np.concatenate(tokens) if n else np.zeros(0, np.int64)
            salt = (_mixed(node ^ token) % salts.astype(np.uint64)).astype(np.int32)  # other groups for each shingle, so neighbours join them
            columns = [token, salt, salts.astype(np.int32), node, size, size - singles - place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in TOKEN.split(", ")])


def _may(size_a: np.ndarray, size_b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray) -> np.ndarray:
    """Exact bounds: whether sets of these sizes, sharing nothing before these places, may be similar."""
    both = 4 * (size_a + size_b)
    return (5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)) & (9 * np.minimum(rest_a, rest_b) >= both)


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts next to each other, by size, within a shingle's group; rows come sorted."""
    last: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [np.asarray(batch.column(c)).astype(np.int64) for c in ("token", "salt", "node", "size", "rest")]
        if last is not None:
            own = [np.r_[x, y] for x, y in zip(last, own, strict=True)]
        last = [x[-1:].copy() for x in own]
        token, salt, node, size, rest = own
        i = np.flatnonzero((token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & _may(size[1:], size[:-1], rest[1:], rest[:-1]))
        pairs = np.unique(np.stack([np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def first_pairs(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Candidates by fingerprint anchors, and neighbours by size at each shingle."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("mate"))
    anchored = links(first.select("fp", F.col("mate").alias("node")))
    equal = nodes.select("fp", "node").join(first, "fp").where("node <> mate").select(F.col("mate").alias("a"), F.col("node").alias("b"))
    dealt = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "node")
    near = dealt.mapInArrow(_neighbour_batches, "a long, b long")
    return anchored.unionByName(equal).unionByName(near).distinct()


def _apart(sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of pairs differ."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), SKETCH_PAIRS):
        part = slice(i, i + SKETCH_PAIRS)
        out[part] = np.bitwise_count(sketches[x[part]] ^ sketches[y[part]]).sum(1, dtype=np.int64)
    return out


def _slices(group: np.ndarray, part_a: np.ndarray, part_b: np.ndarray, gap: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """Of each group and pair of parts, the ``most`` candidates with the least gap; whether there are more."""
    low, high = np.minimum(part_a, part_b), np.maximum(part_a, part_b)
    order = np.lexsort((gap, high, low, group))
    g, lo, hi = group[order], low[order], high[order]
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < most], bool((rank >= most).any())


def across(token: np.ndarray, group: np.ndarray, side: np.ndarray, node: np.ndarray, size: np.ndarray, rest: np.ndarray, part: np.ndarray, sketches: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """Pairs (a, b) of different parts that share a group and may be similar; rows are sorted by token and group.

    Rows of sides 0 and 1 meet those of the other side only, rows of side 2 all of their group.
    """
    starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
    counts = np.diff(np.r_[starts, len(token)])
    number = np.repeat(np.arange(len(starts)), counts)
    found: list[list[np.ndarray]] = []
    more = False

    def take(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal more
        ok = (part[x] != part[y]) & _may(size[x], size[y], rest[x], rest[y])
        x, y = x[ok], y[ok]
        far = _apart(sketches, x, y)
        ok = 9 * far <= size[x] + size[y]
        x, y, far = x[ok], y[ok], far[ok]
        keep, cut = _slices(number[x], part[x], part[y], far, most)
        more |= cut
        found.append([x[keep], y[keep], far[keep]])

    def cross(left: np.ndarray, right: np.ndarray) -> None:
        step = max(1, BLOCK_PAIRS // max(1, len(right)))
        for i in range(0, len(left), step):
            own = left[i : i + step]
            take(np.repeat(own, len(right)), np.tile(right, len(own)))

    small = np.flatnonzero(np.repeat(counts <= 64, counts))
    for d in range(1, 64):
        x = small[small + d < len(number)]
        x = x[number[x] == number[x + d]]
        if not len(x):
            break
        x = x[(side[x] == 2) | (side[x] != side[x + d])]
        take(x, x + d)
    for s, n in zip(starts[counts > 64].tolist(), counts[counts > 64].tolist(), strict=True):
        rows = np.arange(s, s + n)
        if side[s] != 2:
            cross(rows[side[rows] == 0], rows[side[rows] == 1])
            continue
        names, sizes = np.unique(part[rows], return_counts=True)
        largest = part[rows] == names[np.argmax(sizes)]
        minor = rows[~largest]
        cross(minor, rows[largest])
        step = max(1, BLOCK_PAIRS // n)
        for i in range(0, len(minor), step):  # each of these with those after it
            x, y = np.triu_indices(min(step, len(minor) - i), 1, len(minor) - i)
            take(minor[i + x], minor[i + y])
    if not found:
        return np.zeros((0, 2), np.int64), False
    x, y, far = (np.concatenate(c) for c in zip(*found, strict=True))
    keep, cut = _slices(number[x], part[x], part[y], far, most)
    a, b = node[x[keep]], node[y[keep]]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0), more or cut


@gives_back
def _across_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Candidates of different parts; a row (-1, -1) says that some were left for a larger slice."""
    held: list[list[np.ndarray]] = []
    names = ("token", "group", "side", "node", "size", "rest", "part")

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        pairs, more = across(*columns, most)
        out = np.r_[pairs, np.full((int(more), 2), -1)]
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        held.append([np.asarray(batch.column(c)).astype(np.int64) for c in names] + [sketches])
        if sum(len(x[0]) for x in held) >= HELD_ROWS and (held[0][0][0], held[0][1][0]) != (held[-1][0][-1], held[-1][1][-1]):
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            cut += int(np.searchsorted(whole[1][cut:], whole[1][-1]))
            yield emit([x[:cut] for x in whole])
            held = [[x[cut:].copy() for x in whole]]
    if held:
        yield emit([np.concatenate(x) for x in zip(*held, strict=True)])


def dealt_across(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """The prefix shingles at which different parts meet, each row once for every group that it takes part in.

    Only shingles of different parts matter, and of these only those of three
    texts or more, as two in one group have met.

    The texts of a shingle are one group up to ``GROUP`` of them.  Those of a
    more frequent one are cut into blocks of about that many, the largest part
    apart from the others, and each two blocks are a group, but no two of the
    largest part.  So every pair of different parts meets in one group alone,
    no group has more than about two blocks, and n texts send a row for each of
    about n / GROUP blocks at most.
    """
    own = tokens.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    sums = own.groupBy("token", "part").agg(F.count("*").alias("n"), F.max("salts").alias("salts")).groupBy("token").agg(F.sum("n").alias("n"), F.max("salts").alias("salts"), F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("largest"))
    blocks = lambda n: F.when(F.col("n") > GROUP, F.ceil(n / GROUP)).otherwise(0)
    several = sums.where("(n > 2 or salts > 1) and parts > 1").select("token", F.col("largest.part").alias("major"), blocks(F.col("largest.n")).alias("majors"), blocks(F.col("n") - F.col("largest.n")).alias("minors"))
    several = materialize(several, "several")
    own = own.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "token")
    ours = F.when(F.col("part") == F.col("major"), F.col("majors")).otherwise(F.col("minors"))
    own = own.withColumn("home", F.pmod(F.xxhash64("node", "token"), F.greatest(ours, F.lit(1))))

    def met(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct((F.lit(kind << 60) + i * (1 << 30) + j).alias("group"), side.cast("int").alias("side"))

    def each(n: str, f: object) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)

    home = F.col("home")
    others = each("minors", lambda k: met(2, F.least(home, k), F.greatest(home, k), F.when(home == k, 2).otherwise((home > k).cast("int"))))
    groups = (
        F.when(F.col("majors") == 0, F.array(met(0, F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(2))))
        .when(F.col("part") == F.col("major"), each("minors", lambda k: met(1, home, k, F.lit(0))))
        .otherwise(F.concat(each("majors", lambda k: met(1, k, home, F.lit(1))), others))
    )
    return own.select("token", "node", "size", "rest", "part", F.explode(groups).alias("met")).select("token", "met.group", "met.side", "node", "size", "rest", "part")


def pairs_across(tokens: DataFrame, nodes: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """Candidates of different parts, up to ``most`` of each two parts in each group of ``dealt_across``."""
    own = dealt_across(tokens, parts).join(nodes.select("node", "sketch"), "node")
    dealt = own.repartition("token", "group").sortWithinPartitions("token", "group", "size", "node")
    return dealt.mapInArrow(lambda it: _across_batches(it, most), "a long, b long")


# -- links ---------------------------------------------------------------------


@gives_back
def _similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets have the similarity asked for."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (written) that are similar by their whole sets."""
    sets = nodes.select("node", "shingles")
    if pairs.count() <= BROADCAST_ROWS:  # then only the sets of their texts move
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(_similar_batches, "a long, b long"), "links")


def near_links(nodes: DataFrame) -> DataFrame:
    """Verified edges (a, b) that connect what all links of open texts connect."""
    spread = SPREAD
    tokens = nodes.select("node", "size", "singles", "tokens", "powers").mapInArrow(lambda it: _token_batches(it, spread), TOKEN)
    tried = materialize(first_pairs(nodes, tokens), "candidates")
    found, most = verified(tried, nodes), SLICE
    while True:
        met = materialize(pairs_across(tokens, nodes, components(found), most), "met")
        new = materialize(met.where("a >= 0").distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
        if not new.isEmpty():
            found, tried = found.unionByName(verified(new, nodes)), tried.unionByName(new)
        if met.where("a < 0").isEmpty():
            return found
        most *= GROWTH


def _verdicts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Of every text with copies: whether it stays, for which doc_id, and whether several rows have both."""
    own = texts.select("key", "n", "first", F.col("first.place.node").alias("node"))
    own = own.join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    kept = own.groupBy("class").agg(F.min(F.struct("first.absent", "first.doc_id", "node")).alias("kept"), F.sum("n").alias("total")).where("total > 1")
    stays = F.col("node") == F.col("kept.node")
    out = own.join(kept, "class").select("key", stays.alias("stays"), F.col("first.doc_id").alias("stays_as"), (stays & (F.col("first.m") > 1)).alias("again"))
    return materialize(out, "verdicts")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies, that with the smallest doc_id (null last)."""
    store = BlockStore.write(docs, BLOCK_BYTES)
    try:
        texts = distinct_texts(store)
        nodes = open_texts(store, texts)
        verdicts = _verdicts(texts, components(near_links(nodes)))
    finally:
        store.drop()
    own = [f"own_{uuid.uuid4().hex[:8]}_{c}" for c in ("key", "stays", "as", "again")]  # clash with no column
    key, stays, stays_as, again = own
    count, several = verdicts.agg(F.count("*"), F.coalesce(F.max(F.col("again").cast("int")), F.lit(0))).first()
    verdicts = verdicts.toDF(*own)
    marked = docs.withColumn(key, _key(F.col("text"))).join(F.broadcast(verdicts) if count <= BROADCAST_ROWS else verdicts, key, "left")
    left = marked.where(F.col(stays).isNull() | (F.col(stays) & F.col("doc_id").cast("long").eqNullSafe(F.col(stays_as))))
    if several:
        repeated = F.coalesce(F.col(again), F.lit(False))
        left = left.where(~repeated).unionByName(left.where(repeated).dropDuplicates(["doc_id", key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
