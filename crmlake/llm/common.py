"""Shared pieces of the training-data operators: the work folder, written
intermediate tables, column handling and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crmlake.session import ensure_checkpoint_dir

SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; it stays until the job's
    owner clears that folder, because returned DataFrames still read it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The schema is passed on, so tables without rows work too."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_spaces(column):
    """``column`` (null: empty) without any character of ``[\\x20\\x09-\\x0D]``."""
    out = F.coalesce(column, F.lit(""))
    for ch in SPACE_CHARS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v."""
    return (pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v").distinct())


def connected_components(pairs: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component): the smallest node id reachable, for all nodes in ``pairs``.

    Alternating large-star and small-star rounds: every round only groups and
    joins edges on a node, so it needs O(log^2 n) rounds on any graph, and the
    edges of a round are written to the shared folder. The driver reads one
    row (edge count and checksum) per round, never edges.
    """
    edges = written(_edges(pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))), name)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _edges(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = written(_edges(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                               .unionByName(low.select("u", F.col("m").alias("v")))), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
