"""PCA whitening of embeddings; the spectrum comes from slicing (see ``spectrum``).

Entries are quantised to integers x = floor(SCALE * c) + OFFSET. Four passes over the vectors, all
in Arrow batches: sums (exact), second moments around the rounded mean (integers; exact while they stay
below 2**53), the covariance of the whitened rows, and the output. What leaves a task is one
row of sums or ``dim`` rows of moments; partial rows are added in two rounds of tasks, the first with
about the square root of the number of partials, so neither a task nor the driver takes more than
``dim`` rows from each of so many tasks. One task solves the dim x dim spectrum; the driver
reads the model (at most ``components`` vectors) and one row of sums.

Rows: a null vector, one with a null, NaN or infinite entry, and one without entries are dropped; so is
one whose length isn't the commonest (of equally common ones: the longest), which no
covariance can hold. Scaled entries beyond 2**40 count as 2**40. Null and repeated ids are
rows like others, and repeated rows count in every statistic. Components without variance (below
1e-12 of the largest one) can't be whitened and are left out, so one row, or equal rows, give no
result. Other columns are ignored. No rows give no result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmlake.llm.common import documents, written
from crmlake.llm.spectrum import leading_eigenpairs

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 40)
PART = "task int, k long, n long, v binary"
BATCH = 4096


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, quantised vectors) of the usable rows of each length."""
    lists = batch.column("vec")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)      # null entries: NaN
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        block = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(block).all(1)
        if good.any():
            x = np.floor(np.clip(SCALE * block[good], -LIMIT, LIMIT)).astype(np.int64) + OFFSET
            yield int(size), rows[good], x


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            yield batch.slice(lo, BATCH)


def part_rows(found: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    keys = sorted(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([task] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array([found[k][0] for k in keys], pa.int64()),
         pa.array([found[k][1] for k in keys], pa.binary())], names=["task", "k", "n", "v"])


def sum_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per length: number of vectors and the exact sums of their entries."""
    total: dict[int, list] = {}
    for batch in slices(batches):
        for size, _, x in vectors(batch):
            n, s = total.get(size, (0, 0))
            total[size] = (n + len(x), s + x.sum(0).astype(object))
    yield part_rows({k: (n, json.dumps([int(i) for i in s]).encode()) for k, (n, s) in total.items()})


def moment_pass(dim: int, centre: np.ndarray, project: np.ndarray | None = None, shift: np.ndarray | None = None):
    """Rows of the second moments of y = x - centre, or of (y - shift) @ project; row -1 holds the sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width = 0, dim if project is None else project.shape[1]
        moment, sums = np.zeros((width, width)), np.zeros(width)
        for batch in slices(batches):
            for size, _, x in vectors(batch):
                if size == dim:
                    y = (x - centre).astype(float)
                    if project is not None:
                        y = (y - shift) @ project
                    n += len(y)
                    moment += y.T @ y
                    sums += y.sum(0)
        if n:
            yield part_rows({-1: (n, sums.tobytes())} | {i: (n, moment[i].tobytes()) for i in range(width)})
    return run


def add_pass(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for k, n, v in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "v")), strict=True):
                row = np.array(json.loads(v), object) if exact else np.frombuffer(v)
                m, s = total.get(k, (0, 0))
                total[k] = (m + n, s + row)
        yield part_rows({k: (n, json.dumps([int(i) for i in s]).encode() if exact else s.tobytes()) for k, (n, s) in total.items()})
    return run


def added(parts: DataFrame, exact: bool, name: str) -> DataFrame:
    """The sum of the partial rows of each k, in one partition, by way of about sqrt(partials) tasks.

    Partials are written first: their number is known from the files, and no task of the vectors runs again."""
    parts = written(parts, name)
    tasks = int(np.ceil(np.sqrt(max(1, parts.select("task").distinct().count()))))
    return (parts.repartition(tasks, "task").mapInArrow(add_pass(exact), PART)
            .repartition(1).mapInArrow(add_pass(exact), PART))


def solve_pass(dim: int, shift: np.ndarray, components: int):
    """Model rows: k (from 1), value, share of the trace, vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {k: (n, v) for b in batches for k, n, v in zip(*(b.column(c).to_pylist() for c in ("k", "n", "v")), strict=True)}
        if rows:
            cov = np.array([np.frombuffer(rows[i][1]) for i in range(dim)]) / rows[0][0] - np.outer(shift, shift)
            value, vector = leading_eigenpairs((cov + cov.T) / 2, components)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(1, len(value) + 1), pa.int32()), pa.array(value), pa.array(value / np.trace(cov)),
                 pa.array([vector[:, i].tobytes() for i in range(len(value))], pa.binary())],
                names=["component", "value", "explained", "vector"])
    return run


def deviations(y: np.ndarray, n: int, offset: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * y + offset)**2, exact."""
    most = n * int(np.abs(y).max(initial=0)) + int(np.abs(offset).max(initial=0))
    if y.shape[1] * most ** 2 < 1 << 63:
        return pa.array(((n * y + offset.astype(np.int64)) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    wide = ((y.astype(object) * n + offset) ** 2).sum(1)
    return pa.array([Decimal(int(v)) for v in wide], pa.decimal128(38, 0))


def output_pass(dim: int, n: int, centre: np.ndarray, offset: np.ndarray, shift: np.ndarray, project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = project.shape[1]
        for batch in slices(batches):
            for size, rows, x in vectors(batch):
                if size == dim:
                    y = x - centre
                    white = (y - shift) @ project
                    at = pa.array(np.repeat(rows, k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                         deviations(y, n, offset).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(white.ravel())],
                        names=["vec_id", "component", "deviation", "whitened"])
    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component."""
    spark = rows.sparkSession
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    kind = "vec_id long, component int, deviation decimal(38,0), whitened double"
    nothing = spark.createDataFrame([], kind).selectExpr("vec_id", "component", "CAST(0 AS LONG) n", "deviation", "whitened",
                                                         "0D explained", "0D identity_error")
    only = usable.select("vec")
    sums = added(only.mapInArrow(sum_pass, PART), True, "whiten-sums").orderBy(F.desc("n"), F.desc("k")).limit(1).collect()
    if not sums or sums[0].n < 2:
        return nothing
    dim, n, total = sums[0].k, sums[0].n, [int(i) for i in json.loads(sums[0].v)]
    centre = [(2 * s + n) // (2 * n) for s in total]                      # the mean, rounded
    offset = np.array([n * c - s for c, s in zip(centre, total, strict=True)], object)
    shift = np.array([-int(o) / n for o in offset])                       # mean - centre, from exact integers
    centre = np.array(centre, np.int64)
    moments = added(only.mapInArrow(moment_pass(dim, centre), PART), False, "whiten-moments")
    model = written(moments.mapInArrow(solve_pass(dim, shift, components), "component int, value double, explained double, vector binary"),
                    "whiten-model").orderBy("component").collect()       # at most ``components`` rows of dim numbers
    if not model:
        return nothing
    project = np.array([np.frombuffer(m.vector) / np.sqrt(m.value) for m in model]).T
    parts = {r.k: np.frombuffer(r.v) / r.n for r in added(only.mapInArrow(moment_pass(dim, centre, project, shift), PART), False,
                                                          "whiten-check").collect()}    # components x components
    cov = np.array([parts[i] for i in range(len(model))]) - np.outer(parts[-1], parts[-1])
    error = float(np.abs(cov - np.eye(len(model))).max())
    shares = F.element_at(F.array(*[F.lit(m.explained) for m in model]), F.col("component"))
    return (usable.mapInArrow(output_pass(dim, n, centre, offset, shift, project), kind)
            .select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"),
                    F.lit(error).alias("identity_error")))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(documents(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
