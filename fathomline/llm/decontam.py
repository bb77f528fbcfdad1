"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of the benchmark (runs of ``n`` item words; a shorter item is one
window) are broadcast in blocks of a bounded size, and every document's word
windows are looked up by a 64-bit hash.  A hash hit is verified on the words
themselves, so results are exact.  A benchmark beyond the bound takes several
passes, one a block; hits of earlier blocks travel along with the rows, so no
join or shuffle of texts is needed at any size.

Edge cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; rows that share an item_id are one item; an item
row whose item_id is null still marks words but is never listed; repeated
document rows are judged one by one; a very long text is scanned whole, by the
task that reads it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import LOWER, boxed, gives_back, materialize, pieces, text_views, unboxed

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 20

_NORMAL = np.frombuffer(LOWER, np.uint8).copy()
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _NORMAL[_a : _b + 1] = 0x20
_TABLE = _NORMAL.tobytes()
_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)
_POWERS = {"n": 0}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        n = max(n, CHUNK + (CHUNK >> 1))
        up, down = np.full(n, _B, np.uint64), np.full(n, _BINV, np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and its hash; words end where documents do."""
    inside = data != 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return starts, ends, _mixed((sums[ends] - sums[starts]) * down[starts])


class Windows:
    """The windows of one benchmark block, in arrays: some 28 bytes a window beside the text.

    ``of[m]`` has the distinct windows of m words in order of their hashes: the
    hash, the place of the words in ``raw``, and the numbers of the items.
    """

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.n = n
        ids: dict[str, int] = {}
        parts, numbers = [], []
        for item_id, text in items:
            if own := words(text):
                parts.append(b" ".join(own))
                numbers.append(-1 if item_id is None else ids.setdefault(str(item_id), len(ids)))
        self.names, self.raw = list(ids), b"".join(parts)
        offsets = np.r_[0, np.cumsum([len(x) for x in parts], dtype=np.int64)]
        place = np.int32 if len(self.raw) < 1 << 31 else np.int64
        data, found = np.frombuffer(self.raw, np.uint8), []
        for a, b in pieces(offsets, CHUNK):
            starts, ends, w = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found.append(((starts + offsets[a]).astype(place), (ends + offsets[a]).astype(place), w))
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        if not found:
            return
        starts, ends, w = (np.concatenate(c) for c in zip(*found, strict=True))
        del found, parts
        first = np.searchsorted(starts, offsets)
        count = np.diff(first)
        rolling, done = np.zeros(len(w), np.uint64), 0
        for m in np.unique(np.minimum(count, n)).tolist():
            while done < m:
                rolling = rolling[: len(w) - done] * _C + w[done:]
                done += 1
            own = np.flatnonzero(count >= m) if m == n else np.flatnonzero(count == m)
            each = count[own] - m + 1
            word = (np.repeat(first[own] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())).astype(place)
            self.of[m] = self._distinct(m, rolling[word], starts[word], ends[word + m - 1], np.repeat(np.array(numbers, np.int32)[own], each))

    def _distinct(self, m: int, h: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes, places and items of the windows that differ in their words."""
        order = np.argsort(h, kind="stable")
        h, start, end, item = h[order], start[order], end[order], item[order]
        raw = self.raw
        new = np.r_[True, h[1:] != h[:-1]]
        same = np.flatnonzero(~new)
        places = (x.tolist() for x in (start[same - 1], end[same - 1], start[same], end[same]))
        unlike = [k for k, (a, b, c, d) in zip(same.tolist(), zip(*places, strict=True), strict=True) if raw[a:b] != raw[c:d]]
        for k in unlike:  # other words of one hash: put equal ones together
            lo, hi = (int(np.searchsorted(h, h[k], side)) for side in ("left", "right"))
            own = sorted(range(lo, hi), key=lambda i: raw[start[i] : end[i]])
            start[lo:hi], end[lo:hi], item[lo:hi] = start[own], end[own], item[own]
            new[lo + 1 : hi] = [raw[start[i - 1] : end[i - 1]] != raw[start[i] : end[i]] for i in range(lo + 1, hi)]
        window = np.cumsum(new) - 1
        pairs = np.unique((window * (len(self.names) + 1) + item)[item >= 0])
        held = np.searchsorted(pairs, np.arange(int(new.sum()) + 1) * (len(self.names) + 1))
        return h[new], start[new], end[new], held.astype(np.int32 if len(pairs) < 1 << 31 else np.int64), (pairs % (len(self.names) + 1)).astype(np.int32)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Words per document, hit flag of each word, items by document."""
        starts, ends, w = word_hashes(data, offsets)
        first = np.searchsorted(starts, offsets[:-1])
        count = np.diff(np.r_[first, len(starts)])
        last = np.repeat(first + count, count)
        hit, items, raw = np.zeros(len(w) + 1, np.int64), {}, self.raw
        rolling, done = np.zeros(len(w), np.uint64), 0
        for m, (known, start, end, held, numbers) in self.of.items():
            while done < m:  # hash of the done + 1 words from here on
                rolling = rolling[: len(w) - done] * _C + w[done:] if done < len(w) else rolling[:0]
                done += 1
            flags = np.zeros(1 << 16, bool)
            flags[(known >> np.uint64(48)).astype(np.int64)] = True
            near = np.flatnonzero(flags[(rolling >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(known, rolling[near])
            ok = (known[np.minimum(at, len(known) - 1)] == rolling[near]) & (near + m <= last[near])
            near, at = near[ok], at[ok]
            docs = np.searchsorted(first, near, side="right") - 1
            found: dict[int, set[int]] = {}
            for i, k, doc in zip(near.tolist(), at.tolist(), docs.tolist(), strict=True):
                key = b" ".join(data[starts[i] : ends[i + m - 1]].tobytes().split())
                while k < len(known) and known[k] == rolling[i]:
                    if raw[start[k] : end[k]] == key:
                        hit[i] += 1
                        hit[i + m] -= 1
                        found.setdefault(doc, set()).add(k)
                        break
                    k += 1
            for doc, own in found.items():
                listed = np.unique(np.concatenate([numbers[held[k] : held[k + 1]] for k in own]))
                if len(listed):
                    items.setdefault(doc, set()).update(self.names[j] for j in listed.tolist())
        return count, np.cumsum(hit[:-1]) > 0, items


@gives_back
def _scan_batches(batches: Iterator[pa.RecordBatch], block, keep_text: bool) -> Iterator[pa.RecordBatch]:
    windows = block.value
    for batch in batches:
        data, offsets = text_views(batch.column("text"))
        data = _NORMAL[data]
        for a, b in pieces(offsets, CHUNK):
            part = batch.slice(a, b - a)
            count, hit, items = windows.scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.cumsum(count)
            before = part.column("hits").to_pylist()
            listed = part.column("items").to_pylist()
            n_hit, masks = [], []
            for i, (end, n) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)):
                own = hit[end - n : end]
                if before[i]:
                    own = own | np.unpackbits(np.frombuffer(before[i], np.uint8), count=n).astype(bool)
                n_hit.append(int(own.sum()))
                masks.append(np.packbits(own).tobytes() if n_hit[-1] else b"")
            rows = {
                "row": part.column("row"),
                "n_words": pa.array(count.astype(np.int64)),
                "n_hit": pa.array(n_hit, pa.int64()),
                "hits": pa.array(masks, pa.binary()),
                "items": pa.array([sorted(set(x or ()) | items.get(i, set())) for i, x in enumerate(listed)], pa.list_(pa.string())),
            }
            if keep_text:
                rows["text"] = part.column("text")
            yield pa.RecordBatch.from_pydict(rows)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a checked size."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = -(-int(total) // block_bytes)
    if n <= 1:
        yield [tuple(r) for r in items.collect()]
        return
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark")
    for i in range(n):
        yield [tuple(r) for r in items.where(F.col("block") == i).drop("block").collect()]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Each document's n_words, n_hit, hits, items, with its other columns in ``row``.

    ``hits`` has a bit for each word (empty: none); ``items`` the item_ids.
    """
    spark = docs.sparkSession
    rows = docs.select(boxed(docs, "text").alias("row"), F.col("text"))
    rows = rows.withColumns({"hits": F.lit(b""), "items": F.lit(None).cast("array<string>")})
    blocks = _blocks(benchmark, block_bytes)
    own: list | None = next(blocks)
    while own is not None:
        following = next(blocks, None)
        block, keep = spark.sparkContext.broadcast(Windows(own, n)), keep_text or following is not None
        fields = [rows.schema["row"], *T.StructType.fromDDL("n_words long, n_hit long, hits binary, items array<string>" + ", text string" * keep)]
        rows = rows.mapInArrow(lambda it, block=block, keep=keep: _scan_batches(it, block, keep), T.StructType(fields))
        if following is not None:
            rows = materialize(rows, "decontam")
        own = following
    return rows


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    return hits(docs.select("doc_id", "text"), benchmark, n, block_bytes).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, unchanged."""
    return unboxed(hits(docs, benchmark, n, block_bytes, True).where("n_hit = 0"), docs.columns, "text")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, mask in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if mask:
                raw = text.encode()
                starts, ends, _ = word_hashes(_NORMAL[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
                hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(starts)).astype(bool)
                keep, at = [], 0
                for s, e in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True):
                    keep.append(raw[at:s])
                    at = e
                text = b"".join([*keep, raw[at:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every hit word cut from its text; other columns stay."""
    found = hits(docs, benchmark, n, block_bytes, True).select("row", "text", "hits")
    return unboxed(found.mapInArrow(_cut, T.StructType([found.schema["row"], found.schema["text"]])), docs.columns, "text")
