"""Texts encoded word by word, each distinct word once.

A text is cut before every space.  That is a boundary of the tokens as well if
a white-space character does not stand on both sides of the space and no special
token is near, for a byte-level vocabulary with the usual pattern (a space joins
the letters, digits or signs after it, and white space before it stays whole) and
for pieces that hold their space mark in front only.  So the tokens of a text are
those of its words, end to end, and only words not met before are encoded.

The library's model encodes many new words in one call: where no token of the
vocabulary crosses a boundary of the pattern (tested when it is read), merges stay
within matches by themselves, and token lengths in bytes tell whose token is whose.
Words with an apostrophe or white space in a row are cut by the pattern first.
Texts where a cut is not sure (``odd``) are encoded whole by the library, in runs
cut at sure places, so that a long text needs no more memory than its tokens.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from fathomline.llm.common import small_batches

#: Words kept by a worker; beyond it the cache starts anew.  Longer words are not kept.
CACHE, KEPT = 800_000, 64
#: Characters of an odd text that one call encodes.
CALL = 1 << 17
#: Words that one call encodes.
TOGETHER = 1000
_SURE = re.compile(r"\S(?= )")


def _class(kind: str) -> str:
    """Ranges of the code points of a general category, for a character set."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if ok and first is None:
            first = c
        elif not ok and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


@lru_cache(1)
def splitter() -> re.Pattern:
    """public_tokenizers.PATTERN for the standard library, whose engine is faster.

    Its classes are spelt out: letters, numbers and the White_Space property.
    """
    space = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    letter, number = _class("L"), _class("N")
    pattern = public_tokenizers.PATTERN
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    pattern = pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def byte_chars() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable ones stand for themselves, all others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A tokenizers file with byte-level BPE; ``special``: whether special tokens' strings in a text are tokens."""

    def __init__(self, path: str, special: bool):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.marks = tuple(t["content"] for t in spec["added_tokens"]) if special else ()
        own = byte_chars()
        self.tokens = {i: bytes(own[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in own for c in t)}
        self.tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"] if t["id"] not in self.tokens}
        spec_marks = {t["content"] for t in spec["added_tokens"]}
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        for i, b in self.tokens.items():
            self.lengths[i] = len(b)

        self.table, self.bare = {b: c for c, b in own.items()}, Tokenizer(self.library.model)
        for i, b in self.tokens.items():
            text = b.decode(errors="replace")
            if "\ufffd" not in text and text not in spec_marks and len(splitter().findall(text)) != 1:
                raise ValueError(f"token {i} of {path} crosses a boundary of the pattern")
        self.plain = re.compile(r"^\s|^$|'|\s\s|\s$" + "".join("|" + re.escape(m) for m in self.marks))

    def encode(self, text: str) -> bytes:
        """Ids of a text, whole, as 32-bit numbers."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _model(self, text: str) -> np.ndarray:
        """Ids of a text by the merges alone."""
        return np.array(self.bare.encode_batch_fast([text.encode().decode("latin-1").translate(self.table)], add_special_tokens=False)[0].ids, "<u4")

    def _together(self, words: list[str]) -> Iterator[bytes]:
        ids = self._model(" " + " ".join(words))
        ends, reach = np.cumsum([len(w.encode()) + 1 for w in words]), np.cumsum(self.lengths[ids])
        at = np.searchsorted(reach, ends)
        if at[-1] >= len(reach) or (reach[at] != ends).any():
            raise ValueError("a token crosses the end of a word")
        data, start = ids.tobytes(), 0
        for end in (4 * at + 4).tolist():
            yield data[start:end]
            start = end

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with the space before it; none may be odd."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if not self.plain.search(w)]
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            for i, x in zip(some, self._together([words[i] for i in some]), strict=True):
                out[i] = x
        for i, w in enumerate(words):
            if not out[i]:
                out[i] = b"".join([self._model(m).tobytes() for m in splitter().findall(" " + w)])
        return out


@lru_cache(2)
def byte_level(path: str, special: bool) -> ByteLevel:
    return ByteLevel(path, special)


def runs(text: str) -> Iterator[str]:
    """The text cut at sure places (before a space after no white space), about ``CALL`` characters each."""
    at = 0
    while len(text) - at > 2 * CALL and (found := _SURE.search(text, at + CALL)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def odd(word: str, marks: tuple[str, ...]) -> bool:
    """Whether the cut before this word may not be a boundary of tokens."""
    return not word or word[0].isspace() or any(m in word for m in marks)


class Words(dict):
    """Word to the value that ``make`` gives for it; odd words have none."""

    def __init__(self, make: Callable[[list[str]], Iterable], marks: tuple[str, ...] = (), most: int = CACHE):
        super().__init__()
        self.make, self.marks, self.most = make, marks, most

    def of(self, words: list[str]) -> list:
        """The values of distinct words; ``None`` for odd ones."""
        if len(self) > self.most:
            self.clear()
        found = list(map(self.get, words))
        at = [i for i, x in enumerate(found) if x is None and not odd(words[i], self.marks)]
        for i, x in zip(at, self.make([words[i] for i in at]), strict=True):
            found[i] = x
            if len(words[i]) <= KEPT:
                self[words[i]] = x
        return found


class Cut:
    """Texts cut before every space: distinct words, and which words make each text.

    The first word of a text, with no space before it, is apart (``first``); ``index`` has the
    others of all texts end to end, ``offsets`` where those of each text begin.
    """

    def __init__(self, texts: pa.Array, space_first: bool = False):
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        every, at = flat.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        names = flat.dictionary.to_numpy(zero_copy_only=False)
        self.first: list[str] = names[every[at[:-1]]].tolist()
        if not space_first:
            every, at = np.delete(every, at[:-1]), at - np.arange(len(at))
        used, self.index = np.unique(every, return_inverse=True)
        self.words: list[str] = names[used].tolist()
        self.offsets = at

    def texts_with(self, flag: np.ndarray) -> np.ndarray:
        """Whether each text has a word with the flag."""
        return np.diff(np.r_[0, np.cumsum(flag[self.index])][self.offsets]) > 0


def spread(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts that lie end to end in ``flat``, those that ``index`` names end to end, and where each begins."""
    starts, own = np.r_[0, np.cumsum(sizes)][:-1], sizes[index]
    ends = np.r_[0, np.cumsum(own)]
    return flat[np.repeat(starts[index] - ends[:-1], own) + np.arange(ends[-1])], ends


def gathered(parts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for ids as bytes."""
    return spread(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4, index)


def in_chunks(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``size`` bytes, and cut where they have more; null texts become empty."""
    held, count = [], 0
    for batch in batches:
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at), ""))
        for some in small_batches(batch, size, column):
            held.append(some)
            count += pc.sum(pc.binary_length(some.column(at))).as_py() or 0
            if count >= size:
                yield pa.concat_batches(held)
                held, count = [], 0
    if held:
        yield pa.concat_batches(held)
