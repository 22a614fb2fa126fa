"""Join helpers.

No hint and no counting: whether a side is broadcast is left to Spark's size
estimates and to AQE, which converts a join when the side turns out small at run
time and splits the partitions of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str,
           columns: dict[str, str], how: str = "left") -> DataFrame:
    """Attach ``columns`` (dim column -> output name) of ``dim`` by key.

    Only the key and the requested columns of the dimension are projected.
    ``how='inner'`` drops rows without a match (SQL ``JOIN``), ``'left'``
    keeps them with NULLs (``LEFT JOIN`` on a nullable foreign key).
    """
    tmp_key = f"__k_{right_key}"
    side = dim.select(F.col(right_key).alias(tmp_key),
                      *[F.col(src).alias(dst) for src, dst in columns.items()])
    out = df.join(side, df[left_key] == side[tmp_key], how)
    return out.drop(tmp_key)


def semi(df: DataFrame, keys: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys`` (EXISTS)."""
    side = keys.select(F.col(right_key).alias("__semi")).distinct()
    return df.join(side, df[left_key] == side["__semi"], "left_semi")


def anti(df: DataFrame, keys: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``NOT IN (SELECT key ... WHERE key IS NOT NULL)``.

    The NULL guard is explicit, so a NULL key among ``keys`` cannot empty
    the result (what an unguarded SQL ``NOT IN`` would do).
    """
    side = keys.select(F.col(right_key).alias("__anti")).filter(F.col("__anti").isNotNull()).distinct()
    return df.join(side, df[left_key] == side["__anti"], "left_anti")


