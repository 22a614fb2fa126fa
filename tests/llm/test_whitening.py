"""Whitening and its eigenpairs against numpy's solver and exact integers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crmlake.llm import whitening as W
from crmlake.llm.spectrum import leading_eigenpairs


def plain_rows(df, id_col="vec_id", vec_col="embedding"):
    return [(r[0], r[1]) for r in df.select(id_col, vec_col).collect()
            if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


def check(df, got, components=32, rank=None):
    rows = plain_rows(df)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(rows), x.sum(0)
    z = (x - s / n).astype(float)
    cov = z.T @ z / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(components, len(value)) if rank is None else rank
    assert len(got) == n * k and {r.n for r in got} == ({n} if got else set())
    if not got:
        return
    assert all(r.identity_error == got[0].identity_error < 1e-4 for r in got)
    for r in got:
        assert abs(r.explained / (value[r.component - 1] / np.trace(cov)) - 1) < 1e-6
    exact = sorted((i is not None, i or 0, int(sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)))) for (i, _), v in zip(rows, x, strict=True))
    assert sorted((r.vec_id is not None, r.vec_id or 0, int(r.deviation)) for r in got if r.component == 1) == exact
    gap = np.abs(np.diff(np.r_[value, 0]))
    for c in range(k):
        if min(gap[c], gap[c - 1] if c else np.inf) > 1e-6 * value[0]:
            want = z @ vector[:, c] / math.sqrt(value[c])
            mine = {}
            for r in got:
                if r.component == c + 1:
                    mine.setdefault(r.vec_id, []).append(r.whitened)
            his = {}
            for (i, _), w in zip(rows, want, strict=True):
                his.setdefault(i, []).append(w)
            one = max(his, key=lambda i: abs(his[i][0]))
            sign = np.sign(max(his[one], key=abs) * max(mine[one], key=abs))
            for i in his:
                assert np.allclose(sorted(his[i]), sorted(sign * v for v in mine[i]), atol=1e-7)
    white = np.zeros((k, k))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r.whitened)
    assert all(abs(np.mean(np.square(v)) - 1) < 1e-6 and abs(np.mean(v)) < 1e-9 for v in by.values()), white


def table(spark, vecs, ids=None, kind="double"):
    df = spark.createDataFrame([(ids[i] if ids else i, v) for i, v in enumerate(vecs)], f"vec_id long, embedding array<{kind}>")
    return df.withColumns({"vec": F.lit(1), "n": F.lit("x"), "component": F.lit(0), "k": F.lit(2), "v": F.lit(3)})


def test_random_vectors_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    vecs = (rng.standard_normal((400, 12)) * np.linspace(.1, 4, 12)).tolist()
    vecs += [vecs[0]] * 150 + [None, [None] * 12, [float("nan")] * 12, [math.inf] + [0.0] * 11, []]
    ids = [*range(399), None, *[7] * 150, *range(400, 405)]
    df = table(spark, vecs, ids)
    check(df, W.whiten(df.repartition(7)).collect())
    assert W.whiten(df, components=3).where("component > 3").count() == 0


def test_other_lengths_are_left_out(spark):
    rng = np.random.default_rng(2)
    vecs = rng.standard_normal((50, 5)).tolist()
    df = table(spark, vecs + [[1.0, 2.0]] * 3)
    check(df.where("size(embedding) = 5"), W.whiten(df).collect())


def test_exact_deviation_beyond_long(spark):
    df = table(spark, [[1e8 * (i % 7), -1e8 * i] for i in range(40)])
    check(df, W.whiten(df).collect())
    assert max(r.deviation for r in W.whiten(df).collect()) > 2**63


@pytest.mark.parametrize("vecs,rank", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 9, 0), ([[1.0, 5.0], [2.0, 5.0]] * 3, 1),
                                       ([[float(i & 1), float(i >> 1 & 1)] for i in range(4)], 2), ([[.5]] * 2 + [[.7]], 1)])
def test_small_tables(spark, vecs, rank):
    df = table(spark, vecs)
    check(df, W.whiten(df).collect(), rank=rank) if vecs else None
    assert W.whiten(df).count() == len(vecs) * rank


def test_registered_query(spark, sf):
    got = W.op13_whitening(spark, sf).collect()
    check(spark.read.parquet(f"{sf}/embeddings.parquet"), got)


def matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    x = rng.standard_normal((300, 64)) * rng.uniform(.1, 5, 64)
    half = np.zeros((64, 64))
    half[:32, :32] = half[32:, 32:] = x[:, :32].T @ x[:, :32]
    return {"random": x.T @ x, "identity": np.eye(10), "equal": q @ np.diag([9.] * 7 + [3.] * 30 + [0.] * 3) @ q.T, "twice": half,
            "close": q @ np.diag(np.r_[1 + np.arange(20) * 1e-13, np.zeros(20)]) @ q.T, "one": np.array([[3.0]]), "rank one": np.ones((30, 30)),
            "split": np.diag([5., 5, 5, 2, 2, 1])}


@pytest.mark.parametrize("name", list(matrices()))
def test_eigenpairs(name):
    a = matrices()[name]
    value, vector = leading_eigenpairs(a, 32)
    want = np.linalg.eigvalsh(a)[::-1][:32]
    size = np.abs(a).sum(1).max()
    assert len(value) == (want > 1e-10 * want[0]).sum()
    assert np.abs(value - want[:len(value)]).max() < 1e-13 * size
    assert np.abs(a @ vector - vector * value).max() < 1e-13 * size
    assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-13


def test_no_spectrum():
    assert leading_eigenpairs(np.zeros((4, 4)), 3)[0].size == 0
