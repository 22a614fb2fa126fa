"""Sinks: append-only writes with recorded key marks, and lineage cuts that
survive executor loss. Tables are plain Parquet folders; everything goes through
the DataFrame reader and writer, so paths may be HDFS/S3/ABFS. Commits of
several tables at once are left to the table format of the user's lake.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crmlake.session import ensure_checkpoint_dir


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when there is none. Only a
    missing path counts as absent; every other read error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class KeyMarks:
    """Recorded high-water marks of surrogate keys: a small Parquet table of (name, top)
    rows, appended to; the largest row of a table counts. A table has one writer
    at a time, as with any counter."""

    SCHEMA = "name string, top long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self, name: str) -> int | None:
        """The recorded mark of table ``name``, None before the first."""
        marks = read_if_exists(self.spark, self.path, self.SCHEMA)
        return None if marks is None else marks.where(F.col("name") == name).agg(F.max("top")).first()[0]

    def record(self, name: str, top: int) -> None:
        self.spark.createDataFrame([(name, top)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def after(self, name: str, base: DataFrame, key: str) -> int:
        """Where new keys begin: the recorded mark. Only a table without one is asked for its largest key, once."""
        top = self.last(name)
        if top is None:
            top = base.agg(F.max(key)).first()[0] or 0
            self.record(name, top)
        return top


def append_keyed(rows: DataFrame, root: str, name: str, key: str, marks: KeyMarks) -> None:
    """Append new rows and record their largest key. Rows are written before the mark; a run
    that dies between the two leaves the old mark, so it is repeated on a cleaned-up folder."""
    staged = cut_lineage(rows)
    top = staged.agg(F.max(key)).first()[0]
    append_rows(staged, root)
    if top is not None:
        marks.record(name, top)


def append_rows(df: DataFrame, root: str) -> None:
    """Append-only sink (activity log): new files, no rewrite of old ones."""
    df.write.mode("append").parquet(root)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``.

    Used where a result is consumed twice and must be identical both times
    (e.g. a global order that is then numbered): the checkpointed partitions
    are fixed files, so a lost executor recomputes nothing upstream.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # persist first: writing a reliable checkpoint re-runs the job otherwise
    staged = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return staged.checkpoint(eager=True)
    finally:
        staged.unpersist()


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
