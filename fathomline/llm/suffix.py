"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or same document and earlier start).  Not every suffix need
be sorted: each window of LENGTH bytes has one *anchor*, the start of its
smallest 32-byte gram by hash, leftmost on ties.  Equal windows have equal
anchors at equal offsets, so sorting the suffixes at anchors (about one byte
in 35) and knowing the bytes left of them decides every window.

1. Texts are written once as blocks.  Anchors whose gram occurs nowhere else
   cannot have a repeated window; one exchange of gram hashes finds them.
2. Each task sorts the suffixes at the other anchors into runs.  Anchors with
   equal surroundings are decided within the run: only the earliest goes on.
3. The runs are *front-coded* (shared prefix length and rest) and exchanged
   once, dealt by gram, so all suffixes that share 32 bytes meet.  A gram of
   ``HOT`` records or more is dealt by more of its surroundings: for every few
   offsets of a window, a record is cut to what these windows cover and dealt
   by the bytes that all of them hold.
4. A loser tree merges the runs.  It keeps, for each run, the length of the
   prefix shared with the last output: suffixes of different lengths shared
   are ordered without looking at a byte, and equal ones are compared from
   there on, so no known prefix is compared again.  The merge yields the
   suffix order and its common-prefix (LCP) array.
5. For each offset o of a window before its anchor, the windows with equal
   text are those in one LCP interval of at least LENGTH - o bytes whose
   bytes to the left agree for o bytes (likewise from a sorted order of
   reversed left sides and its LCP array).  All but the earliest are repeats.
6. Repeated windows go back to their blocks and bytes are removed.

Hashes only choose what is sorted and where it is dealt: equal windows always
meet, and equality is decided on bytes, so the result is exact.

Edge cases: a null text counts as empty; texts shorter than LENGTH keep all
bytes; documents longer than a chunk are cut into overlapping chunks, each
window lying in one; rows that share a doc_id are ordered by their place in
the input, null ids come last; repeated rows are documents of their own;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, pieces, shuffle_partitions
from fathomline.llm.store import Block, BlockStore, rows

LENGTH = 100
GRAM = 32
#: Grams in a window, so also one more than the largest offset of an anchor.
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 18
#: Suffixes that a task sorts into one run, and suffixes dealt to one merge, about.
RUN_RECORDS, MERGE_RECORDS = 200_000, 150_000
#: Records of a gram from which on it is dealt by its surroundings, for so many offsets together.
HOT, OFFSETS = 20_000, 4

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_LOW32 = np.uint64(0xFFFFFFFF)


# -- anchors -----------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of each anchor, first and last start of its windows, hash of its gram."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    h, reach = data.astype(np.uint64) + np.uint64(1), 1
    for multiplier in _MULTIPLIERS:  # hashes of 2, 4, 8, 16, 32 bytes
        h = h[:-reach] * multiplier + h[reach:]
        reach *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least, reach = (h & ~_LOW32) | np.arange(len(h), dtype=np.uint64), 1
    while reach * 2 <= SPAN:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[SPAN - reach :])
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= LENGTH
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - LENGTH + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[: n - LENGTH + 1], dtype=np.int8))
    at = (least[start] & _LOW32).astype(np.int64)
    if not len(at):
        return at, at, at, at.astype(np.uint64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(at) - 1]
    place = at[first]
    return place, start[first], start[last], h[place]


def block_anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all documents of a block, in block coordinates."""
    out = []
    for a, b in pieces(block.offsets, CHUNK):
        lo, hi = int(block.offsets[a]), int(block.offsets[b])
        if b - a > 1 or hi - lo <= 2 * CHUNK:
            cuts = [(lo, hi, block.offsets[a : b + 1] - lo)]
        else:  # one long document
            cuts = [(s, e := min(hi, s + CHUNK + LENGTH - 1), np.array([0, e - s])) for s in range(lo, max(lo + 1, hi - LENGTH + 1), CHUNK)]
        for s, e, offsets in cuts:
            place, first, last, h = anchors(block.data[s:e], offsets)
            out.append((place + s, first + s, last + s, h))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else anchors(block.data[:0], np.zeros(1, np.int64))


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows(batches):
        block = Block(row)
        grams, times = np.unique(block_anchors(block)[3], return_counts=True)
        for i in range(0, len(grams), 65536):
            part = slice(i, i + 65536)
            columns = [grams[part].view(np.int64), np.full(len(grams[part]), block.block), times[part].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "block", "times"])


def _repeated_batches(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of all (gram, block, times) of a partition: by block, the grams that other blocks have too; hot ones count twice."""
    own = [tuple(np.asarray(b.column(c)) for c in ("gram", "block", "times")) for b in batches if b.num_rows]
    if not own:
        return
    gram, block, times = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.argsort(gram, kind="stable")
    gram, block, times = gram[order], block[order], times[order]
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    sizes = np.diff(np.r_[starts, len(gram)])
    total = np.repeat(np.add.reduceat(times.astype(np.int64), starts), sizes)
    again = np.repeat(sizes, sizes) > 1
    twice = again & (total >= hot)
    gram, block = np.r_[gram[again], gram[twice]], np.r_[block[again], block[twice]]
    order = np.argsort(block, kind="stable")
    gram, block = gram[order], block[order]
    for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(block[part[:1]]), pa.array([gram[part].tobytes()], pa.binary())], ["block", "blob"])


# -- runs --------------------------------------------------------------------

_FIXED = [("doc", np.int64), ("block", np.int64), ("row", np.int32), ("pos", np.int64), ("prefix", np.uint8), ("right", np.uint8), ("left", np.uint8)]


def shared_prefixes(strings: list[bytes], width: int) -> np.ndarray:
    """Length of the prefix that each string shares with the one before it."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    out = np.zeros(len(strings), np.int64)
    for i in range(1, len(strings), 65536):
        j = min(len(strings), i + 65536)
        differ = flat[i:j] != flat[i - 1 : j - 1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out[i:j] = np.minimum(first, np.minimum(sizes[i:j], sizes[i - 1 : j - 1]))
    return out


class Run:
    """Sorted suffixes with what is known of their anchors."""

    def __init__(self, right: list[bytes], left: list[bytes], doc: np.ndarray, block: np.ndarray, row: np.ndarray, pos: np.ndarray, prefix: np.ndarray | None = None):
        self.right, self.left, self.doc, self.block, self.row, self.pos = right, left, doc, block, row, pos
        self.prefix = shared_prefixes(right, LENGTH) if prefix is None else prefix

    def take(self, index: np.ndarray) -> Run:
        own = index.tolist()
        return Run([self.right[i] for i in own], [self.left[i] for i in own], self.doc[index], self.block[index], self.row[index], self.pos[index])

    def pack(self) -> bytes:
        """Front-coded: shared prefix length and the rest of each suffix."""
        prefix = self.prefix.tolist()
        columns = {"doc": self.doc, "block": self.block, "row": self.row, "pos": self.pos, "prefix": self.prefix, "right": np.fromiter(map(len, self.right), np.int64), "left": np.fromiter(map(len, self.left), np.int64)}
        parts = [np.int64(len(self.right)).tobytes(), *[columns[c].astype(t).tobytes() for c, t in _FIXED]]
        parts += [b"".join([s[p:] for s, p in zip(self.right, prefix, strict=True)]), b"".join(self.left)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def unpack(cls, packed: bytes) -> Run:
        data = zstandard.ZstdDecompressor().decompress(packed)
        n, at, columns = int(np.frombuffer(data, np.int64, 1)[0]), 8, {}
        for c, t in _FIXED:
            columns[c] = np.frombuffer(data, t, n, at)
            at += n * np.dtype(t).itemsize
        right, last = [], b""
        for p, size in zip(columns["prefix"].tolist(), columns["right"].tolist(), strict=True):
            last = last[:p] + data[at : at + size - p]
            right.append(last)
            at += size - p
        left = []
        for size in columns["left"].tolist():
            left.append(data[at : at + size])
            at += size
        return cls(right, left, columns["doc"], columns["block"], columns["row"], columns["pos"], columns["prefix"].astype(np.int64))


def _intervals(block: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, blob) rows with the repeated windows of each block: row, start, end."""
    order = np.argsort(block, kind="stable")
    block, spans = block[order], np.stack([row, start, end], 1).astype(np.int64)[order]
    for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(block[part[:1]]), pa.array([spans[part].tobytes()], pa.binary())], ["part", "block", "blob"])


def _cut(right: bytes, left: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    """A hot record for each few offsets that its windows have: what these windows cover, and a hash of what all of them hold."""
    low, high = LENGTH - len(right), len(left)
    for a in range(low - low % OFFSETS, high + 1, OFFSETS):
        b = min(a + OFFSETS, SPAN) - 1
        first, last = max(a, low), min(b, high)
        held = right[: LENGTH - b] + left[len(left) - a :]  # so long in every record that has such a window
        yield right[: LENGTH - first], left[len(left) - last :], zlib.crc32(held, a)


def _run_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    count = 0

    def runs() -> Iterator[pa.RecordBatch]:
        right, left = ([s for x in held for s in x[k]] for k in (0, 1))
        doc, block, row, pos, gram, hot = (np.concatenate([x[k] for x in held]) for k in range(2, 8))
        deal = (gram % np.uint64(parts)).astype(np.int64)
        if hot.any():
            usual, copies = np.flatnonzero(~hot), [(i, *cut) for i in np.flatnonzero(hot).tolist() for cut in _cut(right[i], left[i])]
            index = np.r_[usual, np.array([c[0] for c in copies])]
            right, left = [right[i] for i in usual.tolist()] + [c[1] for c in copies], [left[i] for i in usual.tolist()] + [c[2] for c in copies]
            deal = np.r_[deal[usual], np.array([c[3] for c in copies]) % parts]
            doc, block, row, pos = doc[index], block[index], row[index], pos[index]
        seen: dict[tuple[bytes, bytes], int] = {}
        again = []
        for i in np.lexsort((pos, row, block, doc)).tolist():  # the earliest of equal surroundings goes on
            if seen.setdefault((right[i], left[i]), i) != i:
                again.append(i)
        if again:
            i = np.array(again)
            size = [np.fromiter((len(own[j]) for j in again), np.int64, len(again)) for own in (left, right)]
            yield from _intervals(block[i], row[i], pos[i] - size[0], pos[i] + size[1])
        order = np.array(sorted(seen.values(), key=right.__getitem__))
        whole = Run(right, left, doc, block, row, pos, np.zeros(0))
        part = deal[order]
        for p in np.unique(part).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([-1]), pa.array([whole.take(order[part == p]).pack()], pa.binary())], ["part", "block", "blob"])

    for r in rows(batches):
        block = Block(r)
        place, first, last, gram = block_anchors(block)
        known, listed = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in r["found"]]), return_counts=True) if r["found"] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        values, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(((times > 1) | np.isin(values, known))[inverse])
        if len(open_):
            place, first, last, gram = place[open_], first[open_], last[open_], gram[open_]
            row = np.searchsorted(block.offsets, place, side="right") - 1
            raw, p, f, e = block.raw, place.tolist(), first.tolist(), (last + LENGTH).tolist()
            held.append(([raw[a:b] for a, b in zip(p, e, strict=True)], [raw[a:b] for a, b in zip(f, p, strict=True)], block.ids[row], np.full(len(p), block.block), row, place - block.offsets[row], gram, np.isin(gram, known[listed > 1])))
            count += len(p) * (1 + 16 * float(held[-1][7].mean()))
        if count >= RUN_RECORDS:
            yield from runs()
            held, count = [], 0
    if held:
        yield from runs()


# -- merge -------------------------------------------------------------------


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over runs of (strings, shared prefixes): run, index, LCP of each output."""
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    shared = [0 if s is not None else -1 for s in now]  # with the last output; -1: the run has ended
    losers = [0] * size

    def beats(x: int, y: int) -> bool:
        """Whether x's suffix comes first, for equal ``shared``; the loser learns what they share."""
        a, b, at = now[x], now[y], shared[x]
        if a is None or b is None:
            return b is None
        n = min(len(a), len(b))
        while at < n and a[at : at + 16] == b[at : at + 16]:
            at += 16
        at = min(at, n)
        while at < n and a[at] == b[at]:
            at += 1
        first = (len(a), x) < (len(b), y) if at == n else a[at] < b[at]
        shared[y if first else x] = at
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size
        x, y = play(2 * node), play(2 * node + 1)
        ahead = shared[x] > shared[y] if shared[x] != shared[y] else beats(x, y)
        losers[node] = y if ahead else x
        return x if ahead else y

    winner, out, which, lcp = play(1), [], [], []
    while now[winner] is not None:
        which.append(winner)
        out.append(at[winner])
        lcp.append(shared[winner])
        strings, prefixes = runs[winner]
        at[winner] += 1
        if at[winner] < len(strings):
            now[winner], shared[winner] = strings[at[winner]], prefixes[at[winner]]
        else:
            now[winner], shared[winner] = None, -1
        node, mine = (winner + size) >> 1, shared[winner]
        while node:
            other = losers[node]
            its = shared[other]
            if its > mine or (its == mine and not beats(winner, other)):
                losers[node], winner = winner, other
            mine = shared[winner]
            node >>= 1
    return which, out, lcp


def repeats(right_lcp: np.ndarray, left: list[bytes], low: np.ndarray, high: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Which window of each suffix (its offsets are columns) has an earlier equal.

    Suffixes are in sorted order; ``low`` to ``high`` are the offsets of its
    windows, ``age`` its rank by document and place.
    """
    n = len(left)
    mirrored = [s[::-1] for s in left]
    by_left = np.array(sorted(range(n), key=mirrored.__getitem__))
    left_lcp = shared_prefixes([mirrored[i] for i in by_left.tolist()], SPAN)
    old = np.argsort(age, kind="stable")
    low, high = low[old], high[old]
    out = np.zeros((n, SPAN), bool)
    left_class = np.zeros(n, np.int64)
    for o in range(SPAN):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        left_class[by_left] = np.cumsum(left_lcp < o)
        right_class = np.cumsum(right_lcp < LENGTH - o)
        place = old[own]
        key = right_class[place] * (n + 1) + left_class[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        later = order[1:][key[1:] == key[:-1]]
        out[place[later], o] = True
    return out


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = []
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if part >= 0:
                runs.append(Run.unpack(blob))
    if not runs:
        return
    which, index, lcp = merge([(r.right, r.prefix.tolist()) for r in runs])
    base = np.cumsum([0, *[len(r.right) for r in runs]])
    order = base[np.array(which)] + np.array(index)
    column = lambda name: np.concatenate([getattr(r, name) for r in runs])[order]
    doc, block, row, pos = (column(c) for c in ("doc", "block", "row", "pos"))
    left = [s for r in runs for s in r.left]
    right = np.concatenate([np.fromiter(map(len, r.right), np.int64) for r in runs])[order]
    left = [left[i] for i in order.tolist()]
    high = np.fromiter(map(len, left), np.int64, len(left))
    age = np.empty(len(left), np.int64)
    age[np.lexsort((pos, row, block, doc))] = np.arange(len(left))
    found = repeats(np.array(lcp, np.int64), left, LENGTH - right, high, age)
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, first = np.nonzero(edges == 1)
    _, after = np.nonzero(edges == -1)
    for out in _intervals(block[i], row[i], pos[i] - after + 1, pos[i] - first + LENGTH):
        yield out.select(["block", "blob"])


# -- removal -----------------------------------------------------------------


def _covered(block: Block, found: list[bytes] | None) -> np.ndarray:
    change = np.zeros(len(block.data) + 1, np.int32)
    for blob in found or ():
        row, start, end = np.frombuffer(blob, np.int64).reshape(-1, 3).T
        np.add.at(change, block.offsets[row] + start, 1)
        np.add.at(change, block.offsets[row] + end, -1)
    return np.cumsum(change[:-1]) > 0


def _report_batches(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for r in rows(batches):
        block = Block(r)
        gone = _covered(block, r["found"])
        offsets = block.offsets.tolist()
        sums = np.r_[0, np.cumsum(gone)]
        opens = gone & ~np.r_[False, gone[:-1]]
        heads = block.offsets[:-1][np.diff(block.offsets) > 0]
        opens[heads] = gone[heads]
        spans = np.r_[0, np.cumsum(opens)]
        removed, n_spans = np.diff(sums[block.offsets]), np.diff(spans[block.offsets])
        kept = [block.data[a:b][~gone[a:b]].tobytes() if k else block.raw[a:b] for a, b, k in zip(offsets[:-1], offsets[1:], removed.tolist(), strict=True)]
        columns = {"doc_id": block.doc_ids(), "n_bytes": pa.array(np.diff(block.offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
        if texts:
            columns["kept"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def report(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes ``kept``) per document."""
    spark = docs.sparkSession
    store = BlockStore.write(docs, BLOCK_BYTES)
    try:
        grams, hot = store.table().mapInArrow(_gram_batches, "gram long, block long, times int"), HOT
        dealt = grams.repartition("gram").mapInArrow(lambda it: _repeated_batches(it, hot), "block long, blob binary")
        repeated = materialize(dealt, "grams")
        records = repeated.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        parts = max(shuffle_partitions(spark), int(records) // 8 // MERGE_RECORDS)
        runs = materialize(store.with_data(repeated).mapInArrow(lambda it: _run_batches(it, parts), "part long, block long, blob binary"), "runs")
        within = runs.where("part < 0").select("block", "blob")
        merged = runs.where("part >= 0").repartition(parts, "part").mapInArrow(_merge_batches, "block long, blob binary")
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
        return materialize(store.with_data(within.unionByName(merged)).mapInArrow(lambda it: _report_batches(it, texts), schema), "kept")
    finally:
        store.drop()
