"""Alignments against plain loops over byte intervals."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from fathomline.llm import align, registry, wordwise

FIRST, SECOND = public_tokenizers.path(align.FIRST), public_tokenizers.path(align.SECOND)


class Plain:
    """Both tokenizers over whole texts, and their overlaps one by one."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.a.encode_special_tokens = True
        own = wordwise.byte_chars()
        self.bytes_a = {i: bytes(own[c] for c in t) for t, i in self.a.get_vocab(False).items() if all(c in own for c in t)}

    def of(self, text):
        """Token ids of both sides, overlapping pairs, and groups; nothing if the bytes are not spelt."""
        want = b" " + (text or "").encode()
        if not text:
            return 0, 0, 0, Counter(), ""
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        piece = [self.b.id_to_piece(i) for i in ids_b]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, piece, strict=True)]
        of_a = [self.bytes_a[i] for i in ids_a]
        if b"".join(of_a) != want or b"".join(of_b) != want:
            return 0, 0, 0, Counter(), ""
        spans = []
        for ids, parts in ((ids_a, of_a), (ids_b, of_b)):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links, j = Counter(), 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links[i, spans[1][k][2]] += 1
                k += 1
        sides = []
        for side in spans:
            cut, own = set(common), [[]]
            for _, e, i in side:
                own[-1].append(str(i))
                if e in cut:
                    own.append([])
            sides.append([",".join(x) for x in own[:-1]])
        groups = ["|".join(x) for x in zip(*sides, strict=True)]
        return len(ids_a), len(ids_b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


PLAIN = Plain()


def want(rows):
    found = [(i, *PLAIN.of(t)) for i, t in rows]
    counts = Counter(p for *_, links, _ in found for p in links)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return Counter(
        (i, a, b, g, sum(links.values()), sum(m for p, m in links.items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in links.items()), sha)
        for i, a, b, g, links, sha in found
    )


def test_texts_word_by_word():
    rng, own = random.Random(5), align.Aligner(FIRST, SECOND)
    parts = [" ", "  ", "\n", "\t", "a", "Hello", "it's", "'s", "12", "é", "日本", "\U0001f600", ".", "!?", "<|endoftext|>", "<s>", "<0x41>", "x" * 70, "\r\n", "　", "▁", "<unk>"]
    texts = ["", " ", "a", "▁", " a", "a  b"] + ["".join(rng.choices(parts, weights=[8] + [1] * (len(parts) - 1), k=rng.randint(1, 12))) for _ in range(1500)]
    parts, index, offsets = own.texts(pa.array(texts))
    some = 0
    for text, lo, hi in zip(texts, offsets[:-1], offsets[1:], strict=True):
        w, mine = PLAIN.of(text), [parts[i] for i in index[lo:hi]]
        codes = np.frombuffer(b"".join(x.links for x in mine), "<i8").tolist()
        groups = ";".join(x.groups for x in mine)
        assert tuple(sum(x.counts[k] for x in mine) for k in range(3)) == w[:3] and Counter((c >> 32, c & 0xFFFFFFFF) for c in codes) == w[3], text
        assert (hashlib.sha256(groups.encode()).hexdigest() if groups else "") == w[4]
        some += bool(text) and not w[0]
    assert some > 20


def test_align(spark, data, docs):
    got = registry.op11_align(spark, data)
    assert got.columns == [c.split()[0] for c in align.REPORT.split(", ")]
    assert Counter(map(tuple, got.collect())) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark, odd, monkeypatch):
    clash = odd.withColumns({c: odd["hits"] for c in ("block", "pair", "n", "best", "found", "stats", "entries", "documents")})
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, align.report(clash).collect())) == want(rows)
    assert align.report(odd.where("false")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, align.report(nothing).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_blocks_and_counts(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    many = docs.repartition(20)  # partial counts of many blocks
    aligned = align.blocks(many)
    assert aligned.count() == 20
    links = [PLAIN.of(t)[3] for _, t in rows]
    counts = Counter(p for own in links for p in own)
    assert {((r.a, r.b), r.n) for r in align.pair_counts(aligned).collect()} == set(counts.items())
