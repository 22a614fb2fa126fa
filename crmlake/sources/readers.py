"""Sources (S1, S3): table scans and loading staged rows with column defaults."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crmlake.sources.schemas import NOW, Table, conform


def scan(spark: SparkSession, path: str, table: Table | None = None,
         fmt: str = "parquet") -> DataFrame:
    """Full-row scan of a stored table (``SELECT *``).

    With a contract the result is cast and ordered to it; column pruning and
    filter pushdown still reach the file scan because ``conform`` is a plain
    projection.
    """
    df = spark.read.format(fmt).load(path)
    return conform(df, table) if table is not None else df


def scan_jdbc(spark: SparkSession, url: str, dbtable: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None,
              table: Table | None = None) -> DataFrame:
    """Read a live relational table. A numeric ``partition_column`` with bounds
    splits the read into ``num_partitions`` parallel range queries, so a large
    table is not pulled through one connection."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions or 8))
    df = reader.load()
    return conform(df, table) if table is not None else df


def apply_defaults(df: DataFrame, table: Table, as_of: dt.datetime | str) -> DataFrame:
    """S3: fill the contract's column DEFAULTs into staged rows.

    Absent columns and NULL values take the default; ``CURRENT_TIMESTAMP``
    defaults take ``as_of`` so loads are reproducible. The result conforms
    to the contract.
    """
    as_of_col = F.lit(as_of).cast("timestamp_ntz")
    present = set(df.columns)
    out = conform(df, table)
    fills = {}
    for col in table.columns:
        if col.default is None:
            continue
        default = as_of_col if col.default == NOW else F.lit(col.default)
        current = F.col(col.name) if col.name in present else F.lit(None)
        fills[col.name] = F.coalesce(current.cast(col.dtype), default.cast(col.dtype))
    return out.withColumns(fills) if fills else out
