"""Byte-level BPE encoding and decoding by a monoid tree reduction.

The ranks of a public vocabulary decide the merges: in each match of the
pattern, the adjacent pair of lowest rank merges first, the leftmost on ties.
A match is encoded as a tree: leaves of a few bytes are merged directly, and
two neighbours join by re-encoding a window of tokens around their seam.  The
window grows until the token left of it and its first token, and its last
token and the token right of it, are *stable* pairs: a pair is stable if its
joint bytes encode to just that pair.  No merge can then cross those seams,
since the first to do so would also occur in the pair on its own, so the
tokens outside are those of the whole (a sequence is the encoding of its bytes
exactly if each adjacent pair is stable).  Empty is the identity and joining
is associative; decoding concatenates the tokens' bytes up the same tree.

Texts are cut before their spaces where that is a boundary of matches
(``wordwise.Cut``), and each distinct word of a chunk is encoded once; other
texts go match by match.  Words and matches are kept in caches of bounded size;
they and the vocabulary last as long as a worker.  Nothing is trained.

Edge cases: a null text counts as empty (no tokens, hash of nothing); a match
that is itself a token is that token; texts of any length are whole; repeated
rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import boxed, gives_back, small_batches
from fathomline.llm.wordwise import Cut, Words, gathered, in_chunks, splitter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 24
#: Words, matches and stable pairs kept; beyond it a cache starts anew.
CACHE = 400_000
#: Bytes of text encoded at once, and with their ids as a column.
DIGEST_CHUNK, CHUNK = 1 << 22, 1 << 18
#: Above all ranks: the pair does not merge.
NEVER = 1 << 62

Tokens = tuple[int, ...]


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.tokens = {i: b for b, i in ranks.items()}
        self.stable_pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> Tokens:
        """All merges of a run of bytes."""
        if len(data) > 4 * self.leaf:
            return self._merge_long(data)
        rank, cuts = self.ranks.get, list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]  # of each part and the next
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], NEVER)
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NEVER)
        return tuple([self.ranks[data[a:b]] for a, b in pairwise(cuts)])

    def _merge_long(self, data: bytes) -> Tokens:
        """The same from a heap of candidate pairs (rank, start, end)."""
        ranks, n = self.ranks, len(data)
        end, back = list(range(1, n + 1)), list(range(-1, n))  # by start of a part: its end; by end of a part: its start
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, j = heappop(heap)
            mid = end[i]
            if mid < 0 or mid >= j or end[mid] != j:
                continue
            end[i], end[mid], back[j] = j, -1, i
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heappush(heap, (r, i, end[j]))
            if i > 0 and (r := ranks.get(data[back[i] : j])) is not None:
                heappush(heap, (r, back[i], j))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to (a, b)."""
        known = self.stable_pairs.get((a, b))
        if known is None:
            if len(self.stable_pairs) > CACHE:
                self.stable_pairs.clear()
            known = self.stable_pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == (a, b)
        return known

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """Encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of each side in the window
        while True:
            window = self.merge(self.decode(left[len(left) - i :] + right[:j]))
            before = i == len(left) or self.stable(left[len(left) - i - 1], window[0])
            after = j == len(right) or self.stable(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i = i if before else min(len(left), 2 * i)
            j = j if after else min(len(right), 2 * j)

    def tree(self, data: bytes) -> Tokens:
        """Halves encoded recursively and joined; the depth is that of a balanced tree."""
        if len(data) <= self.leaf:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.tree(data[:mid]), self.tree(data[mid:]))

    def encode_match(self, data: bytes) -> Tokens:
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    def decode(self, tokens: Sequence[int]) -> bytes:
        if len(tokens) <= 4096:
            return b"".join([self.tokens[t] for t in tokens])
        mid = len(tokens) // 2
        return self.decode(tokens[:mid]) + self.decode(tokens[mid:])

    def encode(self, text: str) -> list[int]:
        return [t for m in splitter().findall(text) for t in self.encode_match(m.encode())]


@lru_cache(2)
def coder(path: str) -> Coder:
    with open(path, "rb") as file:
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


class _Packed(dict):
    """Match to the bytes of its ids, filled on demand."""

    def __init__(self, own: Coder):
        super().__init__()
        self.own = own

    def __missing__(self, match: str) -> bytes:
        value = np.array(self.own.encode_match(match.encode()), np.int32).tobytes()
        if len(match) < 64:
            if len(self) > CACHE:
                self.clear()
            self[match] = value
        return value


@lru_cache(1)
def encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to their ids end to end, and n + 1 offsets; null is empty."""
    own, split = _Packed(coder(path)), splitter().findall

    def new(words: list[str]) -> list[bytes]:
        """Ids of each word with the space before it: only its first match begins with a space."""
        out: list[list[bytes]] = []
        for match in split(" " + " ".join(words)) if words else ():
            if match[0] == " ":
                out.append([])
            out[-1].append(own[match])
        return [b"".join(x) for x in out]

    words = Words(new, most=CACHE)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        cut = Cut(texts)
        found = words.of(cut.words)
        odd = cut.texts_with(np.array([x is None for x in found], bool))
        ids, ends = gathered([x or b"" for x in found], cut.index)
        ends, parts = ends[cut.offsets], []
        for i, first in enumerate(cut.first):
            whole, rest = (texts[i].as_py(), ids[:0]) if odd[i] else (first, ids[ends[i] : ends[i + 1]])
            parts += [np.frombuffer(b"".join([own[m] for m in split(whole)]), np.int32), rest.view(np.int32)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)][::2]

    return encode


@lru_cache(1)
def _written(path: str) -> tuple[pa.Array, pa.Array]:
    """Of each id its decimal text and its bytes."""
    tokens = coder(path).tokens
    every = range(max(tokens, default=-1) + 1)
    return pa.array([str(i) for i in every], pa.large_string()), pa.array([tokens.get(i) for i in every], pa.large_binary())


def _hashes(table: pa.Array, between: str, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Hash of what the ids of each text stand for in ``table``."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), table.take(pa.array(flat)))
    joined = pc.binary_join(lists, pa.scalar(between, table.type))
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined], pa.string())


@gives_back
def _digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode, (decimal, token) = encoder(path), _written(path)
    for batch in in_chunks(batches, DIGEST_CHUNK):
        flat, offsets = encode(batch.column("text"))
        rows = [batch.column("row"), pa.array(np.diff(offsets)), _hashes(decimal, ",", flat, offsets), _hashes(token, "", flat, offsets)]
        yield pa.RecordBatch.from_arrays(rows, ["row", "n_tokens", "ids_sha256", "decoded_sha256"])


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes they decode to."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(boxed(docs.select("doc_id", "text"), "text").alias("row"), "text")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string")])
    out = rows.mapInArrow(lambda it: _digest_batches(it, path), schema)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@gives_back
def _packed_batches(batches: Iterator[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Adds the ids of each text, and the hash of what they decode to."""
    encode, token = encoder(path), _written(path)[1]
    for batch in batches:
        for part in small_batches(batch, CHUNK):
            flat, offsets = encode(part.column("text"))
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
            names = [*part.schema.names, "ids"]
            if decoded:
                columns.append(_hashes(token, "", flat, offsets))
                names.append("decoded_sha256")
            yield pa.RecordBatch.from_arrays(columns, names).select([n for n in names if not decoded or n != "text"])


def encoded_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The other columns of each document, n_tokens, ids and the hash of the decoded bytes.

    A column of ``docs`` that has the name of one of these results gives way to it.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(boxed(docs, "text").alias("row"), "text")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("ids array<int>, decoded_sha256 string")])
    found = rows.mapInArrow(lambda it: _packed_batches(it, path, True), schema)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded_sha256")]
    return found.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``row`` (the other columns), ``text`` and its ``ids``."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(boxed(docs, "text").alias("row"), "text")
    return rows.mapInArrow(lambda it: _packed_batches(it, path, False), T.StructType([*rows.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = coder(path)
    for batch in batches:
        out = [own.decode(x or ()) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` as binary ``decoded``; null ids give none."""
    path = path or public_tokenizers.path(VOCABULARY)
    return encoded.mapInArrow(lambda it: _decode_batches(it, path), T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())]))
