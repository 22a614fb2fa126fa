"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (``BITS`` bits) of its words, word pairs and
pairs with one word between them (case of A-Z ignored). Training is online
FTRL-proximal: every coordinate has its own learning rate (from the sum of its
squared gradients), and L1 keeps a coordinate at zero until its evidence passes
the penalty, so the model is a short list of weights that is broadcast (at most
``MAX_WEIGHTS``; training starts again with twice the penalty until they fit). One task trains on the bounded
sample of ``labels.training_rows``; scoring is one pass over all texts without a shuffle.

Rows: null and empty texts score by the intercept; labels are read by id only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.llm import textvec as tv
from crmlake.llm.common import documents
from crmlake.llm.labels import held_out, training_rows

BITS = 24
MAX_ROWS = 8_000           # labelled rows that training reads at most
MAX_WEIGHTS = 1 << 18
MIN_TEXTS = 6              # training texts that hold a feature, at least
STEMS = (4, 5, 6, 7)          # bytes at the head of a longer word that count as a word, too
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 1.0
TOXIC_WEIGHT = 3.0         # a toxic text counts as so many in training: the others are many more
INTERCEPT = -1             # index of the intercept among the weights
WEIGHT_SCHEMA = "feature int, weight double"
WORD = tv.alnum_words()


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of all words, pairs and skip-grams of a chunk, with repeats."""
    starts, ends, h, doc = tv.words(buf, offsets, WORD)
    out, docs = [h], [doc]
    for size in STEMS:                      # words of one stem share a feature
        whole = starts + size < ends
        stem = np.full(int(whole.sum()), size, np.uint64)
        for i in range(size):
            stem = stem << np.uint64(8) | tv.FOLD[buf[starts[whole] + i]]
        out.append(tv.mix(stem * np.uint64(tv.BASE)))
        docs.append(doc[whole])
    for gap, salt in ((1, 0xA5A5), (2, 0x5A5A)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append(tv.mix(h[:-gap] * np.uint64(tv.BASE) + h[gap:] + np.uint64(salt))[same])
            docs.append(doc[gap:][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def distinct_features(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, np.uint8)
    return np.unique(features(buf, np.array([0, len(buf)]))[0])


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; the last coordinate is the intercept."""

    def __init__(self, n: int, l1: float = L1):
        self.z, self.n, self.l1 = np.zeros(n + 1), np.zeros(n + 1), l1

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        gradient *= TOXIC_WEIGHT if label else 1.0
        sigma = (np.sqrt(self.n[at] + gradient ** 2) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient ** 2


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that aren't zero; feature INTERCEPT is the intercept."""
    own = [distinct_features(t) for t in texts]
    names, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
    names = names[counts >= MIN_TEXTS]
    known = np.append(names, -2)                # a last one that equals no feature
    place = [np.searchsorted(names, o) for o in own]
    rows = [p[known[p] == o] for p, o in zip(place, own, strict=True)]
    l1 = L1
    while True:
        model, order = Ftrl(len(names), l1), np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                model.learn(rows[i], labels[i])
        w = model.weights(np.arange(len(names) + 1))
        keep = np.flatnonzero(w)
        if len(keep) <= MAX_WEIGHTS:
            return np.append(names, INTERCEPT)[keep], w[keep]
        l1 *= 2


def train_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((d, t.encode(), y) for b in batches for d, t, y in zip(*[c.to_pylist() for c in b.columns], strict=True))
    names, w = train([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(w, pa.float64())], names=["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights, trained by one task on at most ``max_rows`` rows."""
    sample = training_rows(docs, labels, "toxic", max_rows)
    rows = sample.repartition(1).mapInArrow(train_pass, WEIGHT_SCHEMA).collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])


def scores(buf: np.ndarray, offsets: np.ndarray, names: np.ndarray, weights: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Probability per document of a chunk; ``mark`` has a bit for each known feature."""
    feature, doc = features(buf, offsets)
    hit = mark[feature]
    pairs = np.unique(doc[hit] << BITS | feature[hit])          # each feature once per document
    at = np.searchsorted(names, pairs & ((1 << BITS) - 1))
    total = np.bincount(pairs >> BITS, weights[at], minlength=len(offsets) - 1)
    base = weights[names == INTERCEPT].sum()
    return 1 / (1 + np.exp(-np.clip(total + base, -500, 500)))


def scored_chunks(batches: Iterator[pa.RecordBatch], model, text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    names, weights = model
    order = np.argsort(names)
    names, weights = names[order], weights[order]
    mark = np.zeros(1 << BITS, bool)
    mark[names[names >= 0]] = True
    for rows, buf, offsets in tv.chunks(batches, text_col):
        yield rows, scores(buf, offsets, names, weights, mark)


def score_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in scored_chunks(batches, model.value, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found)], names=["doc_id", "score"])
    return run


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(score_pass(shared), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in scored_chunks(batches, shared.value, text_col):
            yield rows.filter(pa.array(found < limit))
    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_toxicity(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
