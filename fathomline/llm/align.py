"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level vocabulary over space + text, B a sentence-piece model over the
text (it adds the space).  Within a task, DuckDB holds the tokens of some texts as
interval tables: every byte where a token ends bounds one overlap, whose two tokens
are found by ASOF joins (the first end at or after it), whose word is found by a
range join, and whose group is the windowed sum of the common ends before it.  As both
sides cover the same bytes, a pair of tokens overlaps in exactly one such stretch.

A text is cut before its spaces (see ``wordwise``): both sides end a token there, so
groups and links do not cross, and DuckDB sees each distinct word once.  Texts where
a cut is not sure go to DuckDB whole.

Corpus-wide counts: each block of texts has its distinct id pairs and how many of
its documents hold them.  Spark sums these partial counts by pair, takes the largest
count of each A id, joins both to the blocks' pairs, and gathers them by block,
whose size is bounded.  The blocks' own lists were written once, so nothing is
encoded again.

Edge cases: null and empty texts, and texts whose tokens' bytes are not space + text
on either side (the piece mark in a text, say), have no tokens: zeros and an empty
``groups_sha256``; special tokens' strings are plain text; repeated rows count as
documents of their own; a null doc_id is kept; very long texts are whole, in a block
of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import gives_back, materialize, short_batches
from fathomline.llm.wordwise import Cut, Words, byte_level, in_chunks, runs, spread

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a block, about.
BLOCK_BYTES = 4 << 20
#: Words that DuckDB gets at once, and that a task keeps.
TOGETHER, CACHE = 20_000, 200_000
MARK = "▁"

BLOCK = "block long, doc_ids array<long>, stats array<long>, shas array<string>, pairs array<long>, documents array<int>, sizes array<long>, entries binary"
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: Tokens of A and B by their ends, texts (or words) by theirs: one row an overlap.
LINKS = """
with ends as (
  select e, bool_or(is_a) as is_a, bool_or(is_b) as is_b
  from (select e, true as is_a, false as is_b from a union all select e, false, true from b) group by e
), linked as (
  select ends.e, is_a, is_b, a.id as aid, b.id as bid
  from ends asof join a on ends.e <= a.e asof join b on ends.e <= b.e
)
select w.n as n, aid, bid, is_a, is_b, coalesce(sum(cast(is_a and is_b as int)) over (order by l.e rows between unbounded preceding and 1 preceding), 0) as g
from linked l join w on l.e > w.lo and l.e <= w.hi
order by l.e
"""


class Pieces:
    """A sentence-piece model, with the bytes of its pieces."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path} has a piece with a space inside")


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Linked:
    """What DuckDB finds of one word (or whole text): links as id pairs, groups as text, counts."""

    __slots__ = ("links", "groups", "counts")

    def __init__(self, links: bytes, groups: str, counts: tuple[int, int, int]):
        self.links, self.groups, self.counts = links, groups, counts


EMPTY = Linked(b"", "", (0, 0, 0))


class Aligner:
    """Encodes with both sides and aligns in DuckDB; one a task."""

    def __init__(self, first: str, second: str):
        self.a, self.b = byte_level(first, False), pieces(second)
        self.con = duckdb.connect()
        self.con.execute("set threads = 1")
        self.con.execute("set memory_limit = '300MB'")
        self.words = Words(self._words, most=CACHE)
        self.digits = [np.array([f"{i}{c}" for i in range(max(len(self.a.lengths), len(self.b.lengths)))], object) for c in ",|;"]

    def _spelt(self, tokens: list[bytes], ids: list[int], ends: list[int], want: list[bytes]) -> np.ndarray:
        """Whether the tokens of each byte string, which end at ``ends``, spell it."""
        parts = [tokens[k] for k in ids]
        bounds = [0, *ends]
        return np.fromiter((b"".join(parts[a:b]) == w for a, b, w in zip(bounds, ends, want, strict=False)), bool, len(want))

    def linked(self, a: list[bytes], b: list[list[int]], want: list[bytes]) -> list[Linked | None]:
        """Alignments of the tokens of some byte strings; ``None`` where they do not spell them."""
        found: list[Linked | None] = [None] * len(want)
        ia, ib = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        na, nb = np.fromiter(map(len, a), np.int64, len(a)) // 4, np.fromiter(map(len, b), np.int64, len(b))
        ok = self._spelt(self.a.tokens, ia.tolist(), np.cumsum(na).tolist(), want) & self._spelt(self.b.tokens, ib.tolist(), np.cumsum(nb).tolist(), want)
        if not ok.any():
            return found
        ia, ib = ia[np.repeat(ok, na)], ib[np.repeat(ok, nb)]
        good = np.flatnonzero(ok).tolist()
        hi = np.cumsum([len(want[i]) for i in good])
        tables = {
            "a": {"e": np.cumsum(self.a.lengths[ia]), "id": ia}, "b": {"e": np.cumsum(self.b.lengths[ib]), "id": ib},
            "w": {"n": np.arange(len(good)), "lo": np.r_[0, hi[:-1]], "hi": hi},
        }
        for name, columns in tables.items():
            self.con.register(name, pa.table(columns))
        r = self.con.execute(LINKS).fetchnumpy()
        for name in tables:
            self.con.unregister(name)
        cuts = np.searchsorted(r["n"], np.arange(len(good) + 1)).tolist()
        codes = (r["aid"] << 32 | r["bid"]).astype("<i8").tobytes()
        before = np.r_[0, np.cumsum(r["is_a"])], np.r_[0, np.cumsum(r["is_b"])], np.r_[r["g"], r["g"][-1:] + 1]
        counts = np.stack([np.diff(x[cuts]) for x in before], 1).tolist()
        parts, starts = self._groups(r), (before[0] + before[1])[cuts].tolist()
        for k, i in enumerate(good):
            found[i] = Linked(codes[8 * cuts[k] : 8 * cuts[k + 1]], "".join(parts[starts[k] : starts[k + 1]])[:-1], tuple(counts[k]))
        return found

    def _groups(self, r: dict[str, np.ndarray]) -> list[str]:
        """``a1,a2|b1;`` of all groups in order, token by token."""
        ga, gb = r["g"][r["is_a"]], r["g"][r["is_b"]]
        ia, ib = r["aid"][r["is_a"]], r["bid"][r["is_b"]]
        out = np.empty(len(ga) + len(gb), object)
        comma, bar, end = self.digits
        out[np.arange(len(ga)) + np.searchsorted(gb, ga)] = np.where(np.r_[ga[1:] != ga[:-1], True], bar[ia], comma[ia])
        out[np.arange(len(gb)) + np.searchsorted(ga, gb, "right")] = np.where(np.r_[gb[1:] != gb[:-1], True], end[ib], comma[ib])
        return out.tolist()

    def _words(self, words: list[str]) -> Iterator[Linked | None]:
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            yield from self.linked(self.a.words(own), self.b.library.encode(own, num_threads=1), [b" " + w.encode() for w in own])

    def whole(self, text: str) -> Linked | None:
        """A text where a cut is not sure."""
        if not text:
            return None
        return self.linked([b"".join([self.a.encode(r) for r in runs(" " + text)])], [self.b.library.encode(text, num_threads=1)], [b" " + text.encode()])[0]

    def texts(self, texts: pa.Array) -> tuple[list[Linked], np.ndarray, np.ndarray]:
        """Alignments of words and of whole odd texts, those that make each text end to end, and where each text begins."""
        cut = Cut(texts, space_first=True)
        known = self.words.of(cut.words)
        lost = cut.texts_with(np.array([x is None for x in known], bool))
        sizes = np.diff(cut.offsets)
        index, every = cut.index[~np.repeat(lost, sizes)], [x for x in known if x is not None]
        place = np.cumsum([x is not None for x in known]) - 1  # among those that have one
        index = place[index]
        if lost.any():
            own = [self.whole(texts[int(i)].as_py()) or EMPTY for i in np.flatnonzero(lost)]
            at = np.r_[0, np.cumsum(np.where(lost, 0, sizes))][:-1][lost]
            index = np.insert(index, at, len(every) + np.arange(len(own)))
            every += own
        used, index = np.unique(index, return_inverse=True)
        return [every[i] for i in used.tolist()], index, np.r_[0, np.cumsum(np.where(lost, 1, sizes))]


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns))


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return data.reshape(columns, 4, -1).transpose(0, 2, 1).copy().view("<i4")[:, :, 0]


@gives_back
def _block_batches(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    own, task, number = Aligner(first, second), TaskContext.get().partitionId(), 0
    for some in in_chunks(batches, BLOCK_BYTES):
        parts, index, offsets = own.texts(some.column("text"))
        pairs, inside = np.unique(np.frombuffer(b"".join([x.links for x in parts]), "<i8"), return_inverse=True)
        counts = np.array([(*x.counts, len(x.links) // 8) for x in parts], np.int64).reshape(-1, 4)
        stats = np.diff(np.r_[np.zeros((1, 4), np.int64), np.cumsum(counts[index], 0)][offsets], axis=0)
        names = np.array([x.groups for x in parts], object)
        shas = [hashlib.sha256(t.encode()).hexdigest() if (t := ";".join(names[index[a:b]].tolist())) else "" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        at, ends = spread(inside, counts[:, 3], index)
        doc = np.repeat(np.arange(len(shas)), np.diff(ends[offsets]))
        keys, times = np.unique(doc * max(1, len(pairs)) + at, return_counts=True)
        doc, at = np.divmod(keys, max(1, len(pairs)))
        lists = [pairs.astype(np.int64), np.bincount(at, minlength=len(pairs)).astype(np.int32), np.bincount(doc, minlength=len(shas)).astype(np.int64)]
        blob = _pack(np.diff(at, prepend=0), times)
        columns = [pa.array([(task << 32) + number]), pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([stats.ravel()], pa.list_(pa.int64())), pa.array([shas], pa.list_(pa.string()))]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists] + [pa.array([blob], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])
        number += 1


def blocks(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Aligned blocks of documents, written once: counts, group hashes, distinct pairs and who holds them."""
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(lambda it: _block_batches(it, first, second), BLOCK), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b and how many documents of the corpus hold the pair linked (``n``), and whether no pair of a has more (``best``)."""
    partial = aligned.select(F.inline(F.arrays_zip("pairs", "documents")).alias("pair", "own"))
    counts = partial.groupBy("pair").agg(F.sum("own").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", (F.col("n") == F.col("most")).alias("best"))


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            flat = {c: row.column(c).flatten() for c in ("doc_ids", "stats", "shas", "sizes", "found")}
            stats, sizes = flat["stats"].to_numpy().reshape(-1, 4), flat["sizes"].to_numpy()
            n = np.zeros(len(flat["found"]), np.int64)
            best = np.zeros(len(n), bool)
            k, own, top = (flat["found"].field(f).to_numpy(zero_copy_only=False) for f in ("k", "n", "best"))
            n[k], best[k] = own, top
            step, times = _unpack(row.column("entries")[0].as_py(), 2)
            at, times = np.cumsum(step), times.astype(np.int64)
            ends = np.r_[0, np.cumsum(sizes)]
            sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (times * best[at], times * n[at])]
            columns = [flat["doc_ids"], *[pa.array(stats[:, c]) for c in range(4)], *[pa.array(s.astype(np.int64)) for s in sums], flat["shas"]]
            yield pa.RecordBatch.from_arrays(columns, names)


def report(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Counts of tokens, groups and links of each document, and how common its links are in the corpus."""
    aligned = blocks(docs, first, second)
    wanted = aligned.select("block", F.posexplode("pairs").alias("k", "pair"))
    counts = pair_counts(aligned).select("pair", "n", "best")
    found = wanted.join(counts.hint("shuffle_hash"), "pair").groupBy("block").agg(F.collect_list(F.struct("k", "n", "best")).alias("found"))
    rows = aligned.select("block", "doc_ids", "stats", "shas", "sizes", "entries").join(found, "block", "left")
    rows = rows.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<k:int,n:bigint,best:boolean>>)")))
    return rows.mapInArrow(_report_batches, REPORT)
