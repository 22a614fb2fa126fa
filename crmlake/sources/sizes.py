"""How widely a large join is dealt.

With a fixed number of shuffle partitions, or partitions that AQE merges by their compressed size, the
rows a task sorts grow with the table until its sort spills all of them, so what a join moves over the
disks grows faster than its input. Joins of large tables take a number of partitions from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

TASK_BYTES = 64 << 20    # of rows of one side that a task sorts and joins
SMALL_BYTES = 10 << 20   # the largest side that Spark broadcasts by default
TEXT_WIDTH = 64          # bytes assumed for a text value


def row_bytes(df: DataFrame, rows: int) -> int:
    """Bytes of ``rows`` rows of the schema's width."""
    return rows * sum(TEXT_WIDTH if f.dataType.typeName() in ("string", "binary", "array", "map", "struct") else 8
                      for f in df.schema.fields)


def join_partitions(left: DataFrame, left_key: str, rows: int, right: DataFrame, right_key: str,
                    right_rows: int | None = None) -> int | None:
    """Partitions of a join of ``left``, of ``rows`` rows, with ``right``, whose rows are counted if
    ``right_rows`` does not give them: one for ``TASK_BYTES`` of the larger side. None leaves the join to Spark:
    a partition per core is enough, the right side may be broadcast, or the keys' types differ (so do their hashes)."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    if row_bytes(left, rows) <= cores * TASK_BYTES or left.schema[left_key].dataType != right.schema[right_key].dataType:
        return None
    other = row_bytes(right, right.count() if right_rows is None else right_rows)
    return None if other <= SMALL_BYTES else -(-max(row_bytes(left, rows), other) // TASK_BYTES)
