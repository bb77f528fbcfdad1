"""Document log-likelihood by a gated recurrent language model.

Counts cover the whole corpus: every block of texts counts its words, the
counts meet by word (one row for a word and block, at most), and go back to
the blocks that hold the word.  They give the add-one unigram score (base) and
the distribution of words within the tail classes of the model.

The model is a GRU over words with a class-factored softmax,
P(w | h) = P(class | h) P(w | class, h).  The ``SHORT`` most frequent words are
split into classes of about equal mass, with a softmax of their own in each.
All other words are one more class, whose softmax gives their shape (length,
last byte, ASCII or not); within a shape, P(w) = (c + 1) / (mass + types + 1),
the rest being an unseen word.  So probabilities sum to one over all known
words and an unseen one of each shape.

Its weights are learned by truncated backpropagation in numpy from all words
of every training document, each once.  Groups of documents are learned on
executors from common weights, which are averaged by words seen after each of
``ROUNDS`` rounds; a round takes its share of the documents, by a hash of their place.
Scoring reads whole documents, many abreast, in windows of ``WINDOW`` words,
and carries the state from window to window.

Edge cases: a null or wordless text is one end token; a null doc_id hashes as
empty text and is scored like any; repeated rows count and are scored each;
without any training document the counts are zero and the untrained model
gives its uniform start; extra columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import LOWER, materialize, shuffle_partitions
from fathomline.llm.store import Block, BlockStore, rows

MODULUS, HELD = 7, 2
#: Upper-case ASCII to lower case, and white space to a space.
PLAIN = bytes(0x20 if b in b"\t\n\v\f\r" else c for b, c in enumerate(LOWER))
#: No word holds a space, so it can stand for the end of a document.
END = b" "
SHORT, SHORT_CLASSES = 1000, 32
HIDDEN = 24
ROUNDS, BACK, RATE = 2, 16, 1e-2
#: Steps that a group learns in, about: so many words abreast, within these limits.
STEPS, FEW_LANES, LANES = 120, 64, 512
#: Words that one group learns from in a round, and of one row of them, about.
GROUP_WORDS, PIECE_WORDS = 1_000_000, 250_000
SCORE_LANES, WINDOW = 256, 32
#: Rows of a window from which an input counts as frequent.
OFTEN = 64
BLOCK_BYTES = 12 << 20
#: Rows that the driver collects at once from partial sums, top lists or weights.
COLLECT = 16
LOG10 = float(np.log(10))

# Shapes of tail words: four lengths, seven kinds of last byte, ASCII or not.
_LAST = np.full(256, 6, np.uint8)
for _kind, _bytes in enumerate((range(0x61, 0x7B), b".", b",", b"!", range(0x30, 0x3A), range(0x80, 0x100))):
    _LAST[list(_bytes)] = _kind
SHAPES = 56
_LAST_KIND = _LAST.tolist()


def shape(word: bytes) -> int:
    size = len(word)
    wide = 0 if size <= 4 else 1 if size <= 8 else 2 if size <= 12 else 3
    return (wide * 7 + _LAST_KIND[word[-1]]) * 2 + (not word.isascii())


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shapes(names: pa.Array) -> np.ndarray:
    """``shape`` of each of many words, none of them empty."""
    data, offsets = _views(names)
    size, last = np.diff(offsets), data[offsets[1:] - 1]
    wide = (size > 4).astype(np.int64) + (size > 8) + (size > 12)
    other = np.add.reduceat(data >= 128, offsets[:-1], dtype=np.int64) > 0 if len(names) else np.zeros(0, bool)
    return (wide * 7 + _LAST[last]) * 2 + other


def _views(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words end to end, and n + 1 offsets."""
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    data = np.frombuffer(names.buffers()[2], np.uint8) if len(names) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _array(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of the sizes, which lie end to end in ``data``."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a block, each once; which of them its texts have, end to end; and how many each text has."""
    data = np.frombuffer(block.raw.translate(PLAIN), np.uint8)
    real = data != 0x20
    first, last = real.copy(), real.copy()
    first[1:] &= ~real[:-1]
    last[:-1] &= ~real[1:]
    begins, ends = block.offsets[:-1], block.offsets[1:] - 1  # words do not go from text to text
    begins, ends = begins[begins < len(data)], ends[ends >= 0]
    first[begins], last[ends] = real[begins], real[ends]
    starts = np.flatnonzero(first)
    found = _array(data[real], np.flatnonzero(last) + 1 - starts).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.diff(np.searchsorted(starts, block.offsets))


def _with_ends(values: np.ndarray, end: int, sizes: np.ndarray) -> np.ndarray:
    """Values of words with that of an end after each text."""
    return np.insert(values, np.cumsum(sizes), end)


def _named(data: bytes) -> pa.Array:
    """The words that ``data`` holds, joined by line feeds."""
    raw = np.frombuffer(data + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 0x0A)
    return _array(raw[raw != 0x0A], np.diff(np.r_[-1, ends]) - 1)


def held_out(doc_id: int, absent: bool) -> bool:
    return zlib.crc32(b"" if absent else str(doc_id).encode()) % MODULUS == HELD


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _row(kind: int, bucket: int, block: int, names: bytes, values: bytes) -> pa.RecordBatch:
    columns = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([names], pa.binary()), pa.array([values], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "block", "names", "values"])


ROW = "kind int, bucket int, block long, names binary, values binary"


# -- counts ------------------------------------------------------------------


def trained(block: Block) -> np.ndarray:
    """Whether each document of a block is learned from."""
    return np.array([not held_out(i, a) for i, a in zip(block.ids.tolist(), block.absent.tolist(), strict=True)], bool)


def vocabulary(block: Block, buckets: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """The words of a block by bucket, sorted, and their counts in its training documents."""
    names, index, sizes = distinct(block)
    own = trained(block)
    counts = np.append(np.bincount(index[np.repeat(own, sizes)], minlength=len(names)), own.sum())
    names = pa.concat_arrays([names, pa.array([END], pa.large_binary())])
    order = pc.sort_indices(names).to_numpy()
    names = names.take(pa.array(order)).to_pylist()
    bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
    dealt = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[dealt], np.arange(buckets + 1)).tolist()
    for b in range(buckets):
        at = dealt[cuts[b] : cuts[b + 1]]
        if len(at):
            yield b, [names[i] for i in at.tolist()], counts[order[at]]


def _count_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: words and counts of a block and bucket."""
    for r in rows(batches):
        block = Block(r)
        for bucket, names, counts in vocabulary(block, buckets):
            yield _row(0, bucket, block.block, _packed(b"\n".join(names)), _packed(counts.astype(np.int64).tobytes()))


def _total_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 2: words and counts back to a block.  Kind 3: the most frequent words.  Kind 4: sums by shape.

    Rows come sorted by bucket, and one bucket is held at a time.
    """
    held: list[tuple[int, int, bytes, bytes]] = []
    top: dict[bytes, int] = {}
    sums = np.zeros((SHAPES, 2), np.int64)

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal top
        parts = [_unpacked(names) for _, _, names, _ in held]
        found = _named(b"\n".join(parts)).dictionary_encode()
        names, index = found.dictionary, found.indices.to_numpy()
        total = np.zeros(len(names), np.int64)
        np.add.at(total, index, np.frombuffer(b"".join(_unpacked(values) for _, _, _, values in held), np.int64))
        at = 0
        for (bucket, block, packed, _), part in zip(held, parts, strict=True):
            to = at + part.count(b"\n") + 1
            yield _row(2, bucket, block, b"", np.int64(len(packed)).tobytes() + packed + _packed(total[index[at:to]].tobytes()))
            at = to
        most = np.flatnonzero(total >= max(1, np.partition(total, -SHORT)[-SHORT] if len(total) > SHORT else 1))
        seen = dict(zip(names.take(pa.array(most)).to_pylist(), total[most].tolist(), strict=True))
        top = dict(nlargest(SHORT, (top | seen).items(), key=_rank))
        kinds = shapes(names)
        np.add.at(sums, (kinds, 0), total)
        sums[:, 1] += np.bincount(kinds[total > 0], minlength=SHAPES)

    for r in rows(batches):
        if held and r["bucket"] != held[0][0]:
            yield from answers()
            held = []
        held.append((r["bucket"], r["block"], r["names"], r["values"]))
    if held:
        yield from answers()
        yield _top_row(top)
        yield _row(4, 0, 0, b"", sums.tobytes())


def _rank(word: tuple[bytes, int]) -> tuple[int, bytes]:
    """Largest for the most frequent word, the first in the alphabet among ties."""
    return word[1], bytes(255 - b for b in word[0]) + b"\xff"


def _top_row(seen: dict[bytes, int]) -> pa.RecordBatch:
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SHORT]
    return _row(3, 0, 0, b"\n".join(w for w, _ in top), np.array([c for _, c in top], np.int64).tobytes())


def _listed(row: dict) -> dict[bytes, int]:
    counts = np.frombuffer(row["values"], np.int64).tolist()
    return dict(zip(row["names"].split(b"\n"), counts, strict=True)) if counts else {}


def _merge_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _top_row({w: c for r in rows(batches) for w, c in _listed(r).items()})


def _merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _row(4, 0, 0, b"", sum((np.frombuffer(r["values"], np.int64) for r in rows(batches)), np.zeros(2 * SHAPES, np.int64)).tobytes())


def _few(rows: DataFrame, n: int, merge: Callable) -> list[dict]:
    """At most COLLECT rows for the driver; ``n`` partial rows are merged on executors before, if more."""
    if n > COLLECT:
        rows = rows.repartition(COLLECT).mapInArrow(merge, rows.schema)
    return [r.asDict() for r in rows.collect()]


# -- the model ---------------------------------------------------------------


class Lexicon:
    """Classes of words: the short list, and the shapes of all others."""

    def __init__(self, top: dict[bytes, int], sums: np.ndarray):
        chosen = sorted(top.items(), key=lambda x: (-x[1], x[0]))[:SHORT]
        if END not in dict(chosen):
            chosen = [*chosen[: SHORT - 1], (END, 0)]
        self.short = {w: i for i, (w, _) in enumerate(chosen)}
        self.tokens, self.types = (int(x) for x in sums.sum(0))
        mass = np.sqrt([c + 1.0 for _, c in chosen])
        self.of_short = np.minimum(SHORT_CLASSES - 1, (np.cumsum(mass) - mass) * SHORT_CLASSES // mass.sum()).astype(np.int64)
        self.members = [*[np.flatnonzero(self.of_short == k) for k in range(SHORT_CLASSES)], len(chosen) + np.arange(SHAPES)]
        rest = sums.copy()
        for w, c in chosen:
            rest[shape(w)] -= (c, 1 if c else 0)
        self.tail = np.maximum(rest, 0)
        counts = np.array([c for _, c in chosen], np.float64)
        by_class = np.bincount(self.of_short, weights=counts + 1, minlength=SHORT_CLASSES)
        shapes = self.tail.sum(1) + 1.0
        self.start_member = np.log(np.r_[(counts + 1) / by_class[self.of_short], shapes / shapes.sum()])
        self.start_class = np.log(np.maximum(np.r_[by_class, shapes.sum()], 1e-9) / (by_class.sum() + shapes.sum()))
        self.bos = len(chosen) + SHAPES  # as an input

    def kinds(self, numbers: np.ndarray) -> np.ndarray:
        """Classes of words by their input numbers."""
        return np.r_[self.of_short, np.full(SHAPES, SHORT_CLASSES)][numbers]

    def look_up(self, names: list[bytes] | pa.Array, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number (of the word or its shape), class, and log P(w | shape) of tail words (0 for others)."""
        n, names = len(self.short), pa.array(names, pa.large_binary())
        known = pc.fill_null(pc.index_in(names, pa.array(list(self.short), pa.large_binary())), -1).to_numpy().astype(np.int64)
        kinds = shapes(names)
        kind = np.where(known >= 0, self.of_short[np.maximum(known, 0)], SHORT_CLASSES)
        inside = np.zeros(len(names))
        if counts is not None:
            inside = np.where(known >= 0, 0.0, np.log(counts + 1.0) - np.log(self.tail.sum(1) + 1.0)[kinds])
        return np.where(known >= 0, known, n + kinds), kind, inside


class _Room(dict):
    """Working arrays by name, used again from call to call: fresh memory of this size costs as much as the arithmetic in it."""

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype = np.dtype(np.float32)) -> np.ndarray:
        size, own = int(np.prod(shape)), self.get((name, kind))
        if own is None or own.size < size:
            own = self[name, kind] = np.empty(size, kind)
        return own[:size].reshape(shape)


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no exponential of logits ``weights @ h + bias`` can overflow nor a whole row vanish.

    States lie between -1 and 1, so the weights alone tell.
    """
    reach = np.abs(weights).sum(1)
    return bool((reach + bias).max(initial=0) <= 60 and (bias - reach).min(initial=0) >= -60)


class Gru:
    """Weights, scoring and one learner of the model.

    X, U and x hold the reset gate, the update gate and the candidate one after the other.
    """

    def __init__(self, lexicon: Lexicon, seed: int = 5):
        rng, n = np.random.default_rng(seed), len(lexicon.short)
        self.lexicon, self.room = lexicon, _Room()
        self.w = {
            "X": rng.normal(0, 0.1, (3, n + SHAPES + 1, HIDDEN)), "U": rng.normal(0, HIDDEN**-0.5, (3, HIDDEN, HIDDEN)), "x": np.zeros((3, HIDDEN)),
            "C": np.zeros((HIDDEN, SHORT_CLASSES + 1)), "c": lexicon.start_class, "S": np.zeros((n + SHAPES, HIDDEN)), "s": lexicon.start_member,
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    def load(self, data: bytes) -> Gru:
        self.w = dict(np.load(io.BytesIO(data)))
        return self

    def _exponents(self) -> tuple[np.ndarray, np.ndarray]:
        """X (with its bias) and U such that the gates are 1 / (1 + exp(.)), the candidate 2 / (1 + exp(.)) - 1."""
        scale = np.array([-1, -1, -2], self.w["U"].dtype)[:, None, None]
        return (self.w["X"] + self.w["x"][:, None]) * scale, self.w["U"] * scale

    def _steps(self, tables: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, hs: np.ndarray, gates: np.ndarray, mixed: np.ndarray) -> None:
        """Fills in the states after ``hs[0]``, the gates and candidates, and the reset states (of the last step only, if there is room for one)."""
        table, u = tables
        add, more = (self.room(k, (n, *hs.shape[1:]), hs.dtype) for k, n in (("add", 2), ("more", 1)))
        with np.errstate(over="ignore"):  # an infinite exponential gives its limit
            for t in range(len(inputs)):
                own, rh, h, new = gates[t % len(gates)], mixed[t % len(mixed)], hs[t], hs[t + 1]
                rz, c = own[:2], own[2]
                for k in range(3):
                    np.take(table[k], inputs[t], axis=0, out=own[k], mode="clip")
                rz += np.matmul(h, u[:2], out=add)
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                np.multiply(own[0], h, out=rh)
                c += np.matmul(rh, u[2], out=more[0])
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                np.subtract(c, h, out=new)
                new *= own[1]
                new += h

    def states(self, inputs: np.ndarray, h: np.ndarray, back: bool = True) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States after each step (steps, lanes, HIDDEN), and what the way back needs."""
        n, lanes = inputs.shape
        hs, gates, mixed = np.empty((n + 1, lanes, HIDDEN), h.dtype), np.empty((n if back else 1, 3, lanes, HIDDEN), h.dtype), np.empty((n if back else 1, lanes, HIDDEN), h.dtype)
        hs[0] = h
        self._steps(self._exponents(), inputs, hs, gates, mixed)
        return hs[1:], (hs, gates, mixed)

    def _read(self, inputs: np.ndarray, offsets: np.ndarray, lanes: int, steps: int, back: bool) -> Iterator[tuple]:
        """Windows of documents with states carried, and beside a window those that follow it as far as lanes are free.

        Yields places of tokens, which of them are real, the document of each lane, and what the way back needs.
        On the way back the weights may change between what is yielded.
        """
        hs, gates, mixed = np.empty((steps + 1, lanes, HIDDEN), np.float32), np.empty((steps if back else 1, 3, lanes, HIDDEN), np.float32), np.empty((steps if back else 1, lanes, HIDDEN), np.float32)
        tables, held, used, last = self._exponents(), [], 0, None

        def all_held() -> tuple:
            idx, mask = (np.concatenate([x[k] for x in held], 1) for k in (0, 1))
            return idx, mask, np.concatenate([x[2] for x in held]), (hs[:, :used], gates[:, :, :used], mixed[:, :used])

        for idx, mask, fresh, docs, keep in _abreast(offsets, lanes, steps):
            n = len(docs)
            h = np.zeros((n, HIDDEN), np.float32) if last is None else last[keep]
            h[fresh] = 0
            if used + n > lanes:
                yield all_held()
                held, used = [], 0
                tables = self._exponents() if back else tables
            own = slice(used, used + n)
            hs[0, own] = h
            self._steps(tables, inputs[idx], hs[:, own], gates[:, :, own], mixed[:, own])
            last, used = hs[-1, own], used + n
            held.append((idx, mask, docs))
        if held:
            yield all_held()

    def outputs(self, h: np.ndarray, word: np.ndarray, kind: np.ndarray, grads: bool = False, at: np.ndarray | None = None) -> tuple[np.ndarray, tuple | None]:
        """log P(class) + log P(member | class) of each target, and gradients.

        ``at``: the rows of ``h`` that have targets, if not all do.  The gradient by ``h`` is valid until the next call.
        """
        w, room = self.w, self.room
        order = np.argsort(kind.astype(np.int16), kind="stable")
        rows, words, kinds = order if at is None else at[order], word[order], kind[order]
        n, real = len(rows), np.result_type(h, w["C"])
        hs = np.take(h, rows, axis=0, out=room("hs", (n, HIDDEN), h.dtype), mode="clip")
        near = np.arange(n)
        p = np.matmul(hs, w["C"], out=room("p", (n, w["C"].shape[1]), real))
        p += w["c"]
        if not _tame(w["C"].T, w["c"]):
            p -= p.max(1, keepdims=True)
        logs = p[near, kinds]
        np.exp(p, out=p)
        ones, tame = np.ones(max(map(len, self.lexicon.members)), real), _tame(w["S"], w["s"])
        total = p @ np.ones(p.shape[1], real)
        logs -= np.log(total)
        if grads:
            p[near, kinds] -= total
            part = np.reciprocal(total)[:, None]
            dhs = np.matmul(p, w["C"].T, out=room("dhs", (n, HIDDEN), real))
            dhs *= part
            scaled = room("scaled", (n, HIDDEN), real)
            dC, dc = np.multiply(hs, part, out=scaled).T @ p, part[:, 0] @ p
            dS, ds = np.zeros_like(w["S"]), np.zeros_like(w["s"])
        cuts = np.searchsorted(kinds, np.arange(SHORT_CLASSES + 2)).tolist()
        for k, own in enumerate(self.lexicon.members):
            i = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1] and len(own) > 1:
                first, last = int(own[0]), int(own[-1]) + 1  # members of a class are neighbours in the list
                table = w["S"][first:last]
                q = np.matmul(hs[i], table.T, out=room("q", (i.stop - i.start, last - first), real))
                q += w["s"][first:last]
                if not tame:
                    q -= q.max(1, keepdims=True)
                spot = near[: len(q)], words[i] - first
                picked = q[spot]
                np.exp(q, out=q)
                sums = q @ ones[: last - first]
                logs[i] += picked - np.log(sums)
                if grads:
                    q[spot] -= sums
                    part = np.reciprocal(sums)[:, None]
                    more = np.matmul(q, table, out=room("more", (len(q), HIDDEN), real))
                    more *= part
                    dhs[i] += more
                    dS[first:last] = q.T @ np.multiply(hs[i], part, out=more)
                    ds[first:last] = part[:, 0] @ q
        out = np.empty_like(logs)
        out[order] = logs
        if not grads:
            return out, None
        dh = room("dh", h.shape, real)
        if n < len(h):
            dh[:] = 0
        dh[rows] = dhs
        return out, (dh, dC, dc, dS, ds)

    def _back(self, inputs: np.ndarray, dstates: np.ndarray, trail: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        """Backpropagation through the steps of one window."""
        w, room, (hs, gates, mixed) = self.w, self.room, trail
        into = np.ascontiguousarray(w["U"].transpose(0, 2, 1))
        one = dstates.shape[1:]
        dx = room("dx", (3, *dstates.shape), dstates.dtype)
        dh, dhz, drh, rest = room("back", (4, *one), dstates.dtype)
        dh[:] = 0
        for t in range(len(inputs) - 1, -1, -1):
            (r, z, c), (dr, dz, dc) = gates[t], dx[:, t]
            dh += dstates[t]
            np.multiply(dh, z, out=dhz)
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= dhz
            np.matmul(dc, into[2], out=drh)
            np.subtract(1, r, out=dr)
            dr *= mixed[t]
            dr *= drh
            np.subtract(c, hs[t], out=dz)
            dz *= dhz
            dz *= np.subtract(1, z, out=rest)
            drh *= r
            dh -= dhz
            dh += drh
            dh += np.matmul(dr, into[0], out=rest)
            dh += np.matmul(dz, into[1], out=rest)
        flat, ids = dx.reshape(3, -1, HIDDEN), inputs.ravel()
        du = np.concatenate([np.matmul(hs[:-1].reshape(-1, HIDDEN).T, flat[:2]), (mixed.reshape(-1, HIDDEN).T @ flat[2])[None]])
        return {"X": self._by_input(flat, ids), "U": du, "x": flat.sum(1)}

    def _by_input(self, flat: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Sums of rows by input number: products with ones for frequent numbers, ``reduceat`` for the others."""
        order = np.argsort(ids.astype(np.int16), kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(ids, minlength=self.w["X"].shape[1]))]
        size = np.diff(cuts)
        often, seldom = np.flatnonzero(size >= OFTEN), np.flatnonzero((size > 0) & (size < OFTEN))
        table, own = np.zeros_like(self.w["X"]), self.room("sorted", flat.shape[1:], flat.dtype)
        ones = np.ones(int(size.max(initial=0)), flat.dtype)
        few = order[np.repeat(size, size) < OFTEN]
        starts = np.r_[0, np.cumsum(size[seldom])][:-1]
        for gate in range(3):
            np.take(flat[gate], order, axis=0, out=own, mode="clip")
            for k, a, b in zip(often.tolist(), cuts[often].tolist(), cuts[often + 1].tolist(), strict=True):
                np.matmul(ones[: b - a], own[a:b], out=table[gate, k])
            if len(few):
                table[gate, seldom] = np.add.reduceat(np.take(flat[gate], few, axis=0), starts, axis=0)
        return table

    def learn(self, inputs: np.ndarray, word: np.ndarray, kind: np.ndarray, offsets: np.ndarray, rate: float) -> None:
        """One pass over runs of words, many abreast, by Adam on windows of ``BACK`` words."""
        first, second, scratch = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(3))
        steps, lanes = 0, int(np.clip(offsets[-1] // (BACK * STEPS), FEW_LANES, LANES))
        total = max(1, int(offsets[-1]) // (lanes * BACK))
        for idx, mask, _, trail in self._read(inputs, offsets, lanes, BACK, True):
            at, ids = np.flatnonzero(mask), idx.ravel()
            every = ids if len(at) == len(ids) else ids[at]
            _, (dh, dC, dc, dS, ds) = self.outputs(trail[0][1:].reshape(-1, HIDDEN), word[every], kind[every], True, at)
            grads = self._back(inputs[idx], dh.reshape(*mask.shape, HIDDEN), trail) | {"C": dC, "c": dc, "S": dS, "s": ds}
            steps += 1
            share = 1 / max(1, len(at))
            now = rate * max(0.1, 1 - steps / (total + 1))
            for k, g in grads.items():
                m, v, x = first[k], second[k], scratch[k]
                g *= share
                m *= 0.9
                m += np.multiply(g, 0.1, out=x)
                v *= 0.99
                g *= g
                g *= 0.01
                v += g
                np.sqrt(np.multiply(v, 1 / (1 - 0.99**steps), out=x), out=x)
                x += 1e-6
                np.divide(m, x, out=x)
                x *= now / (1 - 0.9**steps)
                self.w[k] -= x

    def score(self, inputs: np.ndarray, word: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log of each document's classes and short words, states carried over windows."""
        out = np.zeros(len(offsets) - 1)
        for idx, mask, docs, (hs, *_) in self._read(inputs, offsets, SCORE_LANES, WINDOW, False):
            at, ids = np.flatnonzero(mask), idx.ravel()
            logs = np.zeros(mask.size)
            logs[at] = self.outputs(hs[1:].reshape(-1, HIDDEN), word[ids[at]], kind[ids[at]], at=at)[0]
            np.add.at(out, docs, logs.reshape(mask.shape).sum(0))
        return out


def _abreast(offsets: np.ndarray, lanes: int, steps: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of documents read in lanes, the longest first.

    Yields places of tokens (steps, lanes), which of them are real, the lanes
    that begin a document, the document of each lane, and the lanes of the
    window before that go on.
    """
    size = np.diff(offsets)
    queue = np.argsort(-size, kind="stable")
    queue = queue[size[queue] > 0]
    n = min(lanes, len(queue))
    docs, following = queue[:n].copy(), n
    at, left = offsets[docs].copy(), size[docs].copy()
    fresh, keep, step = np.ones(n, bool), np.arange(n), np.arange(steps)[:, None]
    while len(docs):
        mask = step < left
        yield np.minimum(at + step, at + left - 1), mask, fresh, docs, keep
        at, left = at + steps, left - steps
        done = np.flatnonzero(left <= 0)
        fresh = np.zeros(len(docs), bool)
        more = min(len(done), len(queue) - following)
        if more:
            lane = done[:more]
            docs = docs.copy()
            docs[lane] = queue[following : following + more]
            following += more
            at[lane], left[lane], fresh[lane] = offsets[docs[lane]], size[docs[lane]], True
        keep = np.flatnonzero(left > 0)
        docs, at, left, fresh = docs[keep], at[keep], left[keep], fresh[keep]


# -- learning ----------------------------------------------------------------


def _number_batches(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    """Training documents as numbers of their words and end, and their sizes, in rows of about PIECE_WORDS."""
    for r in rows(batches):
        block = Block(r)
        names, index, sizes = distinct(block)
        own = trained(block)
        number, end = lexicon.value.look_up(names)[0].astype(np.int16), lexicon.value.short[END]
        flat = _with_ends(number[index[np.repeat(own, sizes)]], end, sizes[own])
        sizes = sizes[own] + 1
        ends, at, piece = np.cumsum(sizes), 0, 0
        while at < len(sizes):
            done = int(ends[at] - sizes[at])
            to = min(len(sizes), int(np.searchsorted(ends, done + PIECE_WORDS)) + 1)
            yield _row(1, piece, block.block, flat[done : int(ends[to - 1])].tobytes(), sizes[at:to].astype(np.int32).tobytes())
            at, piece = to, piece + 1


def _learn_batches(batches: Iterator[pa.RecordBatch], lexicon, weights, rate: float) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def learned() -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum(np.concatenate([sizes for _, sizes in held]))]
        word = np.concatenate([flat for flat, _ in held]).astype(np.int64)
        inputs = np.r_[lexicon.value.bos, word[:-1]]
        inputs[offsets[:-1]] = lexicon.value.bos
        model = Gru(lexicon.value).load(weights.value)
        model.learn(inputs, word, lexicon.value.kinds(word), offsets, rate)
        return _row(5, 0, int(offsets[-1]), model.dump(), b"")

    for r in rows(batches):
        held.append((np.frombuffer(r["names"], np.int16), np.frombuffer(r["values"], np.int32)))
        if sum(len(flat) for flat, _ in held) >= GROUP_WORDS:
            yield learned()
            held = []
    if held:
        yield learned()


def _mean(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """Mean of weights by words seen; sums run in a fixed order."""
    total, sums = 0, {}
    for n, data in sorted(rows):
        total += n
        for k, v in np.load(io.BytesIO(data)).items():
            sums[k] = sums.get(k, 0) + v.astype(np.float64) * n
    out = io.BytesIO()
    np.savez(out, **{k: (v / total).astype(np.float32) for k, v in sums.items()})
    return total, out.getvalue()


def _mean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(r["block"], r["names"]) for r in rows(batches)]
    if parts:
        n, data = _mean(parts)
        yield _row(5, 0, n, data, b"")


def fit(store: BlockStore, lexicon: Lexicon) -> Gru:
    """Learn from all training documents, in rounds of parallel groups whose weights are averaged."""
    spark, model = store.spark, Gru(lexicon)
    shared, groups = spark.sparkContext.broadcast(lexicon), shuffle_partitions(spark)
    runs = materialize(store.table().mapInArrow(lambda it: _number_batches(it, shared), ROW), "runs")
    for i in range(ROUNDS):
        weights, rate = spark.sparkContext.broadcast(model.dump()), RATE * 0.5**i
        own = runs.where(F.pmod(F.xxhash64("block", "bucket"), F.lit(ROUNDS)) == i)
        dealt = own.repartition(groups, "block", "bucket").sortWithinPartitions("block", "bucket")
        learned = materialize(dealt.mapInArrow(lambda it, w=weights, rate=rate: _learn_batches(it, shared, w, rate), ROW), "weights")
        found = _few(learned, learned.count(), _mean_batches)
        if found:
            model.load(_mean([(r["block"], r["names"]) for r in found])[1])
    return model


# -- scoring -----------------------------------------------------------------


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    lexicon, weights = shared.value
    model = Gru(lexicon).load(weights)
    for r in rows(batches):
        block = Block(r)
        listed, counts = [], []
        for blob in r["found"]:
            cut = 8 + int(np.frombuffer(blob, np.int64, 1)[0])
            listed.append(_unpacked(blob[8:cut]))
            counts.append(np.frombuffer(_unpacked(blob[cut:]), np.int64))
        names, index, size = distinct(block)
        names = pa.concat_arrays([names, pa.array([END], pa.large_binary())])
        counts = np.concatenate(counts)[pc.index_in(names, _named(b"\n".join(listed))).to_numpy()]
        number, kind, inside = lexicon.look_up(names, counts)
        base = np.log10(counts + 1.0) - np.log10(lexicon.tokens + lexicon.types + 1.0)
        flat = _with_ends(index, len(names) - 1, size)
        size = size + 1
        cuts = np.r_[0, np.cumsum(size)]
        inputs = np.r_[lexicon.bos, number[flat[:-1]]]
        inputs[cuts[:-1]] = lexicon.bos
        score = model.score(inputs, number[flat], kind[flat], cuts) + np.add.reduceat(inside[flat], cuts[:-1])
        yield pa.RecordBatch.from_pydict({
            "doc_id": block.doc_ids(),
            "held_out": pa.array(~trained(block)),
            "n_tokens": pa.array(size.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64)[flat], cuts[:-1])),
            "train_tokens": pa.array(np.full(len(size), lexicon.tokens)),
            "base_score": pa.array(np.add.reduceat(base[flat], cuts[:-1])),
            "score": pa.array(score / LOG10),
        })


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per document."""
    spark = docs.sparkSession
    store = BlockStore.write(docs, BLOCK_BYTES)
    try:
        partitions = shuffle_partitions(spark)
        buckets = max(partitions, store.table().select("block").count())  # a bucket holds about as much as a block
        counted = store.table().mapInArrow(lambda it: _count_batches(it, buckets), ROW)
        dealt = counted.repartition(partitions, "bucket").sortWithinPartitions("bucket", "block")
        totals = materialize(dealt.mapInArrow(_total_batches, ROW), "totals")
        top: dict[bytes, int] = {}
        for r in _few(totals.where("kind = 3"), partitions, _merge_top):
            top |= _listed(r)
        sums = sum((np.frombuffer(r["values"], np.int64) for r in _few(totals.where("kind = 4"), partitions, _merge_sums)), np.zeros(2 * SHAPES, np.int64))
        lexicon = Lexicon(top, sums.reshape(SHAPES, 2))
        model = fit(store, lexicon)
        shared = spark.sparkContext.broadcast((lexicon, model.dump()))
        back = totals.where("kind = 2").select("block", F.col("values").alias("blob"))
        schema = T.StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return materialize(store.with_data(back).mapInArrow(lambda it: _score_batches(it, shared), schema), "scores")
    finally:
        store.drop()
