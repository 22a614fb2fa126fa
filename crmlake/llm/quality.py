"""Quality: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words (with their number of
capitals), word pairs (by the difference of their hashes, so that every repeated word
is one pair) and character n-grams (``GRAMS`` bytes, word borders included); a softmax
layer on the mean gives the class. Vectors and the layer are trained together by plain numpy
stochastic gradient descent with a falling rate, in one task, on the bounded sample of
``labels.training_rows``. Because the layer is linear in the mean, each vector folds
into one number (its share of the difference of the two classes), so the model that is
broadcast is one float per hash bucket (``2**BITS``) and scoring reads one number per feature.

Rows: null and empty texts score by the bias; labels are read by id only.
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

BITS = 17
DIM = 8
GRAMS = (3, 4)
MAX_ROWS = 6_000           # labelled rows that training reads at most
EPOCHS = 6
RATE = 1.0
SCHEMA = "bias double, folded binary"
VISIBLE = tv.whitespace_words()
U64 = np.uint64


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of all words and character n-grams of a chunk."""
    starts, ends, h, doc = tv.words(buf, offsets, VISIBLE)
    # the case of letters tells headlines in capitals from prose: count capitals into the word's hash
    capital = np.concatenate(([0], np.cumsum((buf >= 65) & (buf <= 90))))
    out = [tv.mix(h + (capital[ends] - capital[starts]).astype(U64) * U64(tv.BASE))]
    docs = [doc]
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        out.append(tv.mix((h[1:] - h[:-1])[same] * U64(tv.BASE)))
        docs.append(doc[1:][same])
    if len(buf):
        owner = np.searchsorted(offsets, np.arange(len(buf)), "right") - 1
        values = buf.astype(U64)
        for n in GRAMS:
            if len(buf) >= n:
                gram = np.full(len(buf) - n + 1, n, U64)
                for i in range(n):
                    gram = gram << U64(8) | values[i:i + len(gram)]
                same = owner[n - 1:] == owner[:len(gram)]
                out.append(tv.mix(gram * U64(tv.BASE))[same])
                docs.append(owner[:len(gram)][same])
    return (np.concatenate(out) >> U64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def train(texts: list[bytes], labels: list[int], seed: int = 11) -> tuple[float, np.ndarray]:
    """(bias, folded numbers): the logit of label 1 is bias + mean of a text's numbers."""
    order = np.random.default_rng(seed)
    vectors = (order.random((1 << BITS, DIM)) - 0.5) / DIM
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    rows = []
    for t in texts:
        buf = np.frombuffer(t, np.uint8)
        rows.append(np.unique(features(buf, np.array([0, len(buf)]))[0], return_counts=True))
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            bucket, count = rows[i]
            share = count / max(1, count.sum())
            mean = share @ vectors[bucket]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            rate = RATE * (1 - step / steps)
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            vectors[bucket] -= rate * share[:, None] * back
            step += 1
    return float(bias[1] - bias[0]), (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)


def train_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((d, t.encode(), y) for b in batches for d, t, y in zip(*[c.to_pylist() for c in b.columns], strict=True))
    bias, folded = train([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([folded.tobytes()], pa.binary())], names=["bias", "folded"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray]:
    """Bias and one float per bucket, trained by one task on at most ``max_rows`` rows."""
    row = training_rows(docs, labels, "quality", max_rows).repartition(1).mapInArrow(train_pass, SCHEMA).first()
    return (row[0], np.frombuffer(bytes(row[1]), np.float32)) if row else (0.0, np.zeros(1 << BITS, np.float32))


def score_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, folded = model.value
        for rows, buf, offsets in tv.chunks(batches, "text"):
            bucket, doc = features(buf, offsets)
            n = len(offsets) - 1
            mean = np.bincount(doc, folded[bucket], minlength=n) / np.maximum(1, np.bincount(doc, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(mean + bias, -500, 500))))], names=["doc_id", "score"])
    return run


def score_quality(docs: DataFrame, model: tuple[float, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(score_pass(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_quality(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))
