"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` bytes over the whole
text).  Every passage is encoded by shares of byte classes, repetition of its
words and hashed trigrams, through one learned tanh layer.  Gated attention
(tanh gate times sigmoid gate) weighs the passages, and a logistic unit scores
the weighted mean.  All of it is learned together from document labels alone,
by Adam in numpy on a bounded sample of labelled documents (``SAMPLE``, chosen
by a hash of the id); scoring then covers every whole text on the executors.

Edge cases: a null text counts as empty; an empty text is a bag of one empty
passage and gets a score like any other; an id with several labels takes their
mean, rounded; null ids or labels teach nothing; with no labels at all, or of
one kind only, every score is the share of label 1 (0.5 without any); repeated
rows are scored each, equal texts alike; extra columns are ignored (and kept by ``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import LOWER, boxed, crc_mod, gives_back, pieces, text_views, unboxed
from fathomline.llm.decontam import word_hashes

PASSAGE = 512
TRIGRAMS = 128
HIDDEN, GATE = 24, 12
#: Labelled documents to learn from, at most.
SAMPLE = 4000
EPOCHS, BATCH, RATE, DECAY = 24, 128, 4e-3, 1e-4
KEEP = 0.3
CHUNK = 1 << 19

_KINDS = np.full(256, 8, np.uint8)  # other ASCII symbols
for _kind, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"|", (), range(0x80, 0x100))):
    _KINDS[list(_bytes)] = _kind
N_KINDS = 10
DENSE = N_KINDS + 8
_WORD = np.frombuffer(LOWER, np.uint8).copy()
_WORD[list(b"\t\n\r\x0b\x0c")] = 0x20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the number of passages of each text."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // PASSAGE))
    n = int(count.sum())
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][doc] + k * PASSAGE
    length = np.minimum(starts + PASSAGE, offsets[1:][doc]) - starts
    of = np.repeat(np.arange(n), length)
    out = np.zeros((n, DENSE + TRIGRAMS), np.float32)
    per = 1 / np.maximum(length, 1).astype(np.float32)
    out[:, :N_KINDS] = np.bincount(of * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS) * per[:, None]
    low = _WORD[data]
    if len(low) > 2:
        wide = low.astype(np.uint32)
        tri = ((wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1]) * np.uint32(0x85EBCA6B) + wide[2:]) * np.uint32(0xC2B2AE35) >> np.uint32(25)
        whole = of[:-2] == of[2:]  # three bytes of one passage
        out[:, DENSE:] = np.bincount((of[:-2] * TRIGRAMS + tri)[whole], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) * (8 * per[:, None])
    first, last, h = word_hashes(low, offsets)
    if len(first):
        own = of[first]
        words = np.bincount(own, minlength=n)
        share = 1 / np.maximum(words, 1)
        for lag in (1, 2, 3):
            if len(h) > lag:
                same = (h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])
                out[:, N_KINDS + lag - 1] = np.bincount(own[lag:], weights=same, minlength=n) * share
        seen = np.bincount(own * 64 + (h >> np.uint64(58)).astype(np.int64), minlength=n * 64).reshape(n, 64)
        out[:, N_KINDS + 3] = (seen > 0).sum(1) * share
        out[:, N_KINDS + 4] = np.bincount(own, weights=last - first, minlength=n) * share / 16
        tail = _KINDS[data[last - 1]]
        out[:, N_KINDS + 5] = np.bincount(own, weights=tail >= 6, minlength=n) * share
        out[:, N_KINDS + 6] = words * per * 8
    out[:, N_KINDS + 7] = length / PASSAGE
    return out, count


class Model:
    """Passage encoder, gated attention and scorer; ``fit`` learns all of them."""

    def __init__(self, seed: int = 7):
        rng, d = np.random.default_rng(seed), DENSE + TRIGRAMS
        self.mean, self.scale = np.zeros(d, np.float32), np.ones(d, np.float32)
        self.prior: float | None = 0.5
        self.w = {
            "E": rng.normal(0, d**-0.5, (d, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": rng.normal(0, GATE**-0.5, GATE), "s": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w, starts = self.w, np.cumsum(count) - count
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        raw = (t * g) @ w["a"]
        raw = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        att = raw / np.add.reduceat(raw, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["s"] + w["b"], -30, 30)))
        return {"bag": bag, "starts": starts, "h": h, "t": t, "g": g, "att": att, "z": z, "p": p}

    def _gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self._forward(x, count)
        dp = (f["p"] - y) / len(y)
        dz = dp[:, None] * w["s"]
        dh = f["att"][:, None] * dz[f["bag"]]
        datt = (f["h"] * dz[f["bag"]]).sum(1)
        draw = f["att"] * (datt - np.add.reduceat(f["att"] * datt, f["starts"])[f["bag"]])
        dtg = draw[:, None] * w["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ w["V"].T + dg @ w["U"].T
        dx = dh * (1 - f["h"] ** 2)
        out = {"E": x.T @ dx, "e": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": ((f["t"] * f["g"]) * draw[:, None]).sum(0), "s": f["z"].T @ dp, "b": dp.sum(keepdims=True)}
        return {k: v + DECAY * w[k] for k, v in out.items()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
        share = float(np.mean(labels)) if len(labels) else 0.5
        self.prior = share if len(labels) == 0 or share in (0.0, 1.0) else None
        if self.prior is not None:
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), 1 / (every.std(0) + 1e-3)
        bags = [(b - self.mean) * self.scale for b in bags]
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        total = EPOCHS * -(-len(bags) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                step += 1
                rate = RATE * min(1, step / 20) * (1 - step / (total + 1))
                grads = self._gradients(np.concatenate([bags[j] for j in own]), np.array([len(bags[j]) for j in own]), labels[own].astype(np.float32))
                for k, d in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(count), self.prior)
        return self._forward((x - self.mean) * self.scale, count)["p"].astype(np.float64)


@gives_back
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_views(batch.column("text"))
        for a, b in pieces(offsets, CHUNK):
            x, count = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            cuts = np.cumsum(count) - count
            blobs = [own.astype(np.float16).tobytes() for own in np.split(x, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array(blobs, pa.binary())], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents, whole, outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").where(crc_mod(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.orderBy(*by_hash).limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = own.mapInArrow(_feature_batches, "doc_id long, quality int, x binary").orderBy(*by_hash, "x").limit(sample).collect()
    bags = [np.frombuffer(r.x, np.float16).astype(np.float32).reshape(-1, DENSE + TRIGRAMS) for r in rows]
    return Model().fit(bags, np.array([r.quality for r in rows]))


@gives_back
def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        data, offsets = text_views(batch.column("text"))
        for a, b in pieces(offsets, CHUNK):
            score = model.score(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (the other columns), ``text`` and ``score`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(boxed(docs, "text").alias("row"), "text")
    return rows.mapInArrow(lambda it: _score_batches(it, model), T.StructType([*rows.schema, T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    doc_id = F.col("row.doc_id")
    return scored(docs.select("doc_id", "text"), labels).select(
        doc_id.alias("doc_id"), (crc_mod(doc_id, 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, unchanged."""
    return unboxed(scored(docs, labels).where(F.col("score") >= KEEP), docs.columns, "text")
