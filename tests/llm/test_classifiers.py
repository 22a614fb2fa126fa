"""Classifiers against plain re-implementations, their training bound, and the registered queries."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import prose, rows
from pyspark.sql import functions as F

from crmlake.llm import labels, quality, toxicity
from crmlake.llm.common import documents


@pytest.mark.parametrize("max_rows", [0, 1, 100, 10_000])
def test_the_bound_holds_when_ids_repeat(spark, max_rows):
    """Every id has 50 rows, one id a third of all; labels repeat and contradict each other."""
    docs = spark.range(15_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 200 END AS doc_id", "concat('text ', id) AS text")
    marks = spark.range(1000).selectExpr("id % 250 AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    got = rows(labels.training_rows(docs, marks, "toxic", max_rows).repartition(3))
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) <= max_rows and not [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(ids) == min(max_rows, sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))) or max_rows == 100
    again = rows(labels.training_rows(docs.repartition(11), marks.repartition(5), "toxic", max_rows))
    assert sorted(map(str, got)) == sorted(map(str, again))


# ---- FTRL ------------------------------------------------------------------------------------
def plain_features(text):
    """Words, stems, pairs and skip-grams by name instead of hash."""
    words = [w.decode("utf-8", "surrogateescape") for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text)]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    raw = [w.encode("utf-8", "surrogateescape") for w in low]
    out = {("word", w) for w in raw}
    out |= {("stem", n, w[:n]) for n in toxicity.STEMS for w in raw if len(w) > n}
    out |= {("pair", a, b) for a, b in zip(raw, raw[1:], strict=False)} | {("skip", a, b) for a, b in zip(raw, raw[2:], strict=False)}
    return out


def plain_ftrl(texts, marks, seed=7):
    """The update rule in plain Python, a dictionary per coordinate."""
    own = [plain_features(t) for t in texts]
    count = Counter(f for o in own for f in o)
    z, n = Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)
    order = np.random.default_rng(seed)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(texts)):
            at = [f for f in own[i] if count[f] >= toxicity.MIN_TEXTS] + ["intercept"]
            w = {f: weight(f) for f in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, math.fsum(w.values()))))) - marks[i]
            g *= toxicity.TOXIC_WEIGHT if marks[i] else 1.0
            for f in at:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    return {f: weight(f) for f in [*count, "intercept"] if weight(f)}


def test_ftrl_equals_plain_python(spark):
    texts = [(prose(40, i) + (" vile Brute stuff" if i % 4 == 0 else "")).encode() for i in range(120)] + [b"", b"one"]
    marks = [int(i % 4 == 0) for i in range(120)] + [0, 1]
    names, w = toxicity.train(texts, marks)
    want = plain_ftrl(texts, marks)
    assert len(names) == len(want) and sorted(w) == pytest.approx(sorted(want.values()), abs=1e-9)
    scored = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)] + [(900, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score_toxicity(scored, (names, w)))}
    for i, t in [*enumerate(texts), (900, b"")]:
        logit = math.fsum(want.get(f, 0) for f in plain_features(t)) + want.get("intercept", 0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_the_penalty_grows_until_the_weights_fit(monkeypatch):
    texts = [(prose(40, i) + (" vile Brute stuff" if i % 4 == 0 else "")).encode() for i in range(120)]
    marks = [int(i % 4 == 0) for i in range(120)]
    many = len(toxicity.train(texts, marks)[0])
    monkeypatch.setattr(toxicity, "MAX_WEIGHTS", max(2, many // 3))
    names, w = toxicity.train(texts, marks)
    assert 0 < len(names) <= max(2, many // 3) and np.all(w != 0)


# ---- embeddings --------------------------------------------------------------------------------
def test_sgd_and_the_folded_model_equal_plain_python(spark, monkeypatch):
    """Every vector, the layer and the softmax kept apart, updated one number at a time."""
    monkeypatch.setattr(quality, "BITS", 9)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    texts = [(prose(6, i) + (" $$$ ###" if i % 3 == 0 else "")).encode() for i in range(25)] + [b""]
    marks = [int(i % 3 != 0) for i in range(25)] + [1]
    bias, folded = quality.train(texts, marks)
    order = np.random.default_rng(11)
    vec = ((order.random((1 << 9, quality.DIM)) - 0.5) / quality.DIM).tolist()
    layer, b = [[0.0, 0.0] for _ in range(quality.DIM)], [0.0, 0.0]

    def buckets(t):
        buf = np.frombuffer(t, np.uint8)
        return quality.features(buf, np.array([0, len(buf)]))[0].tolist()

    def classes(mean):
        logit = [sum(mean[d] * layer[d][c] for d in range(quality.DIM)) + b[c] for c in (0, 1)]
        e = [math.exp(x - max(logit)) for x in logit]
        return [x / sum(e) for x in e]

    def average(own):
        return [sum(vec[f][d] for f in own) / max(1, len(own)) for d in range(quality.DIM)]
    step, steps = 0, 2 * len(texts)
    for _ in range(2):
        for i in order.permutation(len(texts)):
            own = buckets(texts[i])
            mean = average(own)
            p = classes(mean)
            p[marks[i]] -= 1
            rate = quality.RATE * (1 - step / steps)
            back = [layer[d][0] * p[0] + layer[d][1] * p[1] for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for c in (0, 1):
                    layer[d][c] -= rate * mean[d] * p[c]
            for c in (0, 1):
                b[c] -= rate * 0.1 * p[c]
            for f in own:
                for d in range(quality.DIM):
                    vec[f][d] -= rate / len(own) * back[d]
            step += 1
    for t in texts:
        own = buckets(t)
        mine = 1 / (1 + math.exp(-(bias + (float(np.mean(folded[own])) if own else 0.0))))
        assert mine == pytest.approx(classes(average(own))[1], abs=1e-6)


# ---- registered queries ---------------------------------------------------------------------
def auc(pairs):
    s = sorted(pairs)
    rank, i = 0.0, 0
    while i < len(s):
        j = i
        while j < len(s) and s[j][0] == s[i][0]:
            j += 1
        rank += sum(y for _, y in s[i:j]) * (i + j + 1) / 2
        i = j
    pos = sum(y for _, y in s)
    return (rank - pos * (pos + 1) / 2) / (pos * (len(s) - pos))


@pytest.mark.parametrize("query,label,cut", [(toxicity.op2_toxicity, "toxic", 0.5), (quality.op4_quality, "quality", 0.3)])
def test_registered_queries(spark, query, label, cut):
    folder = "/root/testdata/sf0.01"
    got = rows(query(spark, folder))
    ids = [r[0] for r in documents(spark, folder).select("doc_id").collect()]
    assert list(got[0])[:4] == ["doc_id", "held_out", "score", "predicted"] and sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    marks = {r["doc_id"]: r[label] for r in documents(spark, folder, "labels").where(F.col(label).isNotNull()).collect()}
    assert auc([(r["score"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]) > 0.85
    plain = query(spark, folder).schema
    assert [f.dataType.simpleString() for f in plain.fields][:4] == ["bigint", "boolean", "double", "int"]
