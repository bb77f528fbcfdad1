"""The work of op4 and op9 stays within their budgets: words met once, arithmetic in full windows."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from fathomline.llm import bpe, lm


def _block(texts):
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    ids = np.arange(len(texts), dtype=np.int64)
    return lm.Block({"block": 1, "ids": ids.tobytes(), "absent": bytes(len(texts)), "offsets": offsets.tobytes(), "texts": lm._packed(b"".join(texts))})


def test_words_of_a_block_are_those_of_its_texts():
    texts = [b"", b"One two", b"two", b" \t\n", b"", b"a\x0bB\x0cc\rA ", "É é x\x1cy  ".encode(), b"one", b""]
    for some in (texts, [b""], [b" "], texts[1:3]):
        names, index, sizes = lm.distinct(_block(some))
        got, at = names.take(index).to_pylist() if len(index) else [], np.r_[0, np.cumsum(sizes)]
        assert [got[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [lm.words(t) for t in some]
        assert len(set(names.to_pylist())) == len(names)
        assert lm.shapes(names).tolist() == [lm.shape(w) for w in names.to_pylist()]


def test_a_long_document_learns_in_full_windows(monkeypatch):
    seen = {f"w{i}".encode(): 400 - i for i in range(90)} | {lm.END: 60}
    sums = np.zeros((lm.SHAPES, 2), np.int64)
    for w, c in seen.items():
        sums[lm.shape(w)] += (c, 1)
    model = lm.Gru(lm.Lexicon(seen, sums))
    rng, sizes = np.random.default_rng(3), np.r_[6000, np.full(300, 100)]  # one goes on alone for hundreds of windows
    flat, cuts = rng.integers(0, len(model.lexicon.short), sizes.sum()), np.r_[0, np.cumsum(sizes)]
    calls, outputs = [], lm.Gru.outputs

    def counted(self, h, word, *args):
        calls.append(len(word))
        return outputs(self, h, word, *args)

    monkeypatch.setattr(lm.Gru, "outputs", counted)
    model.learn(flat, flat, model.lexicon.kinds(flat), cuts, lm.RATE)
    assert sum(calls) == sizes.sum()  # all words, each once
    assert len(calls) <= 3 * sizes.sum() / (lm.FEW_LANES * lm.BACK)


def test_words_are_merged_once_a_worker(monkeypatch):
    path = public_tokenizers.path(bpe.VOCABULARY)
    texts = ["thenining  areerlyes", None, " thenining areerlyes, it's\n\n undäheit ", "a\n b", "'s 's x\u3000 y", "", "ciónrrdobo areerlyes" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array([{"doc_id": i} for i in range(len(texts))]), pa.array(texts)], ["row", "text"])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(path).ranks, special_tokens={})
    merged, merge = [], bpe.Coder.merge

    def counted(self, data):
        merged.append(data)
        return merge(self, data)

    monkeypatch.setattr(bpe.Coder, "merge", counted)
    for again in range(2):  # as two tasks of one worker
        merged.clear()
        got = pa.Table.from_batches(bpe._digest_batches(iter([batch, batch]), path)).to_pylist()
        want = [library.encode_ordinary(t or "") for t in texts] * 2
        assert [r["n_tokens"] for r in got] == [len(x) for x in want]
        assert [r["ids_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in want]
        assert not again or not merged
