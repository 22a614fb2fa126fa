"""Layouts of stored tables that let Spark read or rewrite only a part of them.

* by month: a folder per calendar month of a date column, so rolling windows and
  month-to-date filters prune folders (F9, F10);
* buckets: children bucketed and sorted on their foreign key and parents on their key,
  so grouping a child and joining it to its parent needs no shuffle (J7, J8, S9, S10);
* key ranges: a folder per range of surrogate keys, so a change set rewrites only the
  folders that hold one of its keys (S6, S7, S8).

All are plain Parquet. ``WithTables`` puts a laid-out table in place of another in a table provider.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crmlake.functions.predicates import month_column, month_number
from crmlake.session import ensure_checkpoint_dir

RANGE = "key_range"
RANGE_WIDTH = 1_000_000     # keys per folder
ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000       # what Spark allows a table
FOLDERS = 500               # of key ranges, at most: each costs files to open, list and rename


class WithTables:
    """A table provider with some tables replaced."""

    def __init__(self, base, **tables: DataFrame):
        self._base, self._tables = base, tables

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self._tables[name] if name in self._tables else getattr(self._base, name)


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


# ---- months ------------------------------------------------------------------------------
def write_by_month(df: DataFrame, column: str, path: str) -> DataFrame:
    """Write ``df`` with a folder per month of ``column`` (undated rows have their own) and read it back.
    A month that holds much of the table is dealt to several tasks by the time itself, rows of one time (and
    those without one) by a hash of the row."""
    name = month_column(column)
    laid = df.withColumn(name, month_number(F.col(column)))
    (laid.repartitionByRange(_partitions(df.sparkSession), name, column, F.xxhash64(*df.columns))
     .write.partitionBy(name).parquet(path))
    return df.sparkSession.read.schema(laid.schema).parquet(path)


# ---- buckets -----------------------------------------------------------------------------
def buckets_for(*tables: DataFrame, least: int) -> int:
    """Buckets of tables that are joined on the key: one for ``ROWS_PER_BUCKET`` rows of the largest, at least
    ``least``. A task writes and later reads a whole bucket, so buckets grow in number and not in size."""
    most = max(df.count() for df in tables)
    return max(least, min(MAX_BUCKETS, -(-most // ROWS_PER_BUCKET)))


def write_buckets(df: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets of ``key``, sorted on it, as an external table at ``path``.

    Tables that are joined on the key take the same number of buckets. A task writes all of a bucket
    (``repartition`` on the key deals rows as the bucketing does), so there is one file per bucket."""
    table = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key)
     .format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)


# ---- key ranges --------------------------------------------------------------------------
def _range_of(key: str, width: int) -> Column:
    return F.floor(F.col(key) / width).cast("long")


def range_width(df: DataFrame, key: str, least: int = RANGE_WIDTH) -> int:
    """Keys per folder of a table like ``df``: ``least``, or more where that would make over ``FOLDERS`` folders,
    so that folders grow with the table and not their number."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    return least if low is None else max(least, (high - low) // (FOLDERS - 1) + 1)


def write_key_ranges(df: DataFrame, key: str, path: str, width: int = RANGE_WIDTH) -> None:
    """Write ``df`` (keys not null) with a folder per ``width`` keys."""
    (df.withColumn(RANGE, _range_of(key, width)).repartitionByRange(_partitions(df.sparkSession), RANGE, key)
     .write.partitionBy(RANGE).parquet(path))


def read_key_ranges(spark: SparkSession, key: str, path: str, schema) -> DataFrame:
    """The table at ``path``. A rewritten folder also holds a row without a key."""
    return spark.read.schema(_with_range(schema)).parquet(path).where(F.col(key).isNotNull()).drop(RANGE)


def change_key_ranges(spark: SparkSession, key: str, path: str, schema, keys: DataFrame,
                      change: Callable[[DataFrame], DataFrame], width: int = RANGE_WIDTH) -> None:
    """Replace the rows of the folders that hold one of ``keys`` by ``change`` of them; other folders and
    their files stay as they are (dynamic partition overwrite).

    ``change`` may update or delete rows; keys stay in their folder. The folders to read are
    found by a semi-join on the partition column, which Spark turns into dynamic
    pruning. Folders are replaced one after the other when the job commits, so a table has one writer."""
    touched = keys.where(F.col(key).isNotNull()).select(_range_of(key, width).alias("__range")).distinct()
    stored = spark.read.schema(_with_range(schema)).parquet(path)
    part = stored.join(touched, stored[RANGE] == touched["__range"], "left_semi")
    names = schema.names
    new = change(part.where(F.col(key).isNotNull()).drop(RANGE)).select(*names).withColumn(RANGE, _range_of(key, width))
    # dynamic overwrite leaves folders without new rows alone: one row without a key empties them
    held = part.select(RANGE).distinct()
    empty = held.select(*[F.lit(None).cast(schema[n].dataType).alias(n) for n in names], RANGE)
    new = new.unionByName(empty)
    (new.repartitionByRange(_partitions(spark), RANGE, key).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path))


def _with_range(schema):
    return T.StructType([*schema.fields, T.StructField(RANGE, T.LongType())])
