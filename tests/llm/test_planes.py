"""Files of planes: exact round trips, and the library's own ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import planes, registry, wordwise
from fathomline.llm.common import shared_dir

PATH = public_tokenizers.path(planes.VOCABULARY)


def want(rows):
    """doc_id, start, n_tokens, checksum by the library, whole texts one by one."""
    own, at, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [True, False])
def test_file_by_ranges(bits):
    rng = np.random.default_rng(3)
    docs = [(int(i) if i % 7 else None, rng.integers(0, 1 << (32 if i == 5 else 16), n).astype("<u4")) for i, n in enumerate([0, 1, 500, 3, 0, 2000, 64, 1])]
    raw, asked = planes.pack(4, 9, docs, bits, 256), []

    def fetch(at, n):
        asked.append((at, n))
        return raw[at : at + n]

    file = planes.Reader(fetch)
    assert (file.part, file.seq, file.n_docs, file.n_ids) == (4, 9, 8, 2569)
    assert all(i == j and (x == y).all() for (i, x), (j, y) in zip(docs, file.documents(), strict=True))
    flat = np.concatenate([x for _, x in docs])
    asked.clear()
    assert (file.ids(700, 800) == flat[700:800]).all() and len(asked) == 2 and sum(n for _, n in asked) < len(raw) / 2
    assert len(file.ids(9, 9)) == 0
    bad = bytearray(raw)
    bad[int(file.index[3][0]) + 20] ^= 1
    with pytest.raises(Exception, match="damaged|zstd|decompress"):
        planes.Reader(lambda at, n: bytes(bad[at : at + n])).block(3)
    assert list(planes.Reader(lambda at, n: planes.pack(0, 0, [], bits)[at : at + n]).documents()) == []


def test_words_are_those_of_the_whole_text():
    rng, encode, own = random.Random(5), planes.encoder(PATH), Tokenizer.from_file(PATH)
    parts = [" ", "  ", "\n", "\t", " ", "a", "Hello", "it's", "'s", "12", "é", "日本", "\U0001f600", ".", "!?", "<|endoftext|>", "x" * 70, "\r\n", "　", "\x00", "▁"]
    texts = ["", " ", "<|endoftext|>", "a\n <|endoftext|> b"] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]
    for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids, text
    long = "word  and \n more  " * 40_000
    assert len(list(wordwise.runs(long))) > 2 and encode(pa.array([long]))[0].tolist() == own.encode(long, add_special_tokens=False).ids


def test_planes(spark, data, docs):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in registry.op12_planes(spark, data).collect())
    assert got == want([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_planes(spark, odd, monkeypatch):
    clash = odd.withColumns({"hash": odd["hits"], "part": odd["hits"], "value": odd["hits"], "content": odd["hits"], "start": odd["hits"], "own": odd["hits"]})
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in planes.report(clash).orderBy("start").collect()]
    pick = lambda x: sorted([(i is None, i, n, c) for i, _, n, c in x], key=str)
    assert pick(got) == pick(want(rows)) and [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    assert [s for _, s, _, _ in got] == np.r_[0, np.cumsum([n for _, _, n, _ in got])][:-1].tolist()
    assert planes.report(odd.where("false")).count() == 0
    folder = f"{shared_dir(spark)}/planes-test"
    planes.write(odd, folder)
    back = {(r.doc_id, r.start): r.ids for r in planes.read(spark, folder).collect()}
    own = Tokenizer.from_file(PATH)
    assert sorted(map(str, back.values())) == sorted(str(own.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    hot = spark.range(6000).select(F.lit(3).alias("doc_id"), F.lit("the same row again").alias("text"))
    folder += "-hot"
    planes.write(hot, folder)
    assert planes.heads(spark, folder).count() >= 3 and planes.heads(spark, folder).agg(F.max(F.col("start") + F.col("n_ids"))).first()[0] == 6000 * 5
