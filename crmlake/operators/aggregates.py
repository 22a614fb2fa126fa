"""Aggregations (A1-A15) and eager aggregation below joins.

The reference joins a parent to several independent children and then groups
(fan-out: rows multiply, ``SUM`` is inflated, ``COUNT(DISTINCT)`` needs an
Expand). Here every child is aggregated on its foreign key *first* (partial
aggregation runs map-side, so a key holding a third of the rows is combined
inside each task before the shuffle) and the one-row-per-key results are
left-joined to the parent. Distinct counts go through Spark's two-level
distinct aggregation, which shuffles on (key, id) before (key), so a hot key
is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def null_safe_sum(c: str | Column) -> Column:
    """A3: ``IFNULL(SUM(x), 0)``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(col), F.lit(0))


def null_safe_avg(c: str | Column) -> Column:
    """A4: ``IFNULL(AVG(x), 0)`` as DOUBLE (``sum / count``, exact sum first)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(col).cast("double") / F.count(col), F.lit(0.0))


def count_if(cond: Column) -> Column:
    """A2: filtered count, many of them in one pass over a table."""
    return F.count_if(cond)


def combine_rows(*rows: DataFrame) -> DataFrame:
    """Merge one-row aggregates of different tables into one KPI row.

    Each input contributes its own columns; the union has at most
    ``len(rows)`` rows and one global aggregate folds it to a single row
    (no cartesian product).
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def count_by(df: DataFrame, keys: list[str], name: str = "count", collation: str | None = None) -> DataFrame:
    """``GROUP BY keys`` with ``COUNT(*)``. With a ``collation`` (e.g.
    ``UNICODE_CI_AI_RTRIM``) text keys group as the reference's database does:
    'SMB', 'smb ' and 'Smb' form one group."""
    if collation:
        text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
        cols = [F.collate(F.col(k), collation).alias(k) if k in text else F.col(k) for k in keys]
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


@dataclass
class Child:
    """One child table of a parent for eager aggregation.

    ``fk`` is the child's column pointing at the parent; ``aggs`` are named
    aggregate columns computed per ``fk``; ``fill`` gives the value for
    parents without children (0 for counts and sums).
    """
    df: DataFrame
    fk: str
    aggs: dict[str, Column]
    fill: dict[str, object] | None = None


def distinct_count(id_col: str) -> Column:
    return F.count_distinct(F.col(id_col))


def pre_aggregate(child: Child, keys: DataFrame | None = None, key_col: str | None = None) -> DataFrame:
    """Aggregate a child per foreign key. With ``keys`` (a filtered parent) the
    child is first semi-joined to them, so other groups aren't aggregated."""
    df = child.df
    if keys is not None:
        side = keys.select(F.col(key_col).alias("__pk")).distinct()
        df = df.join(side, df[child.fk] == side["__pk"], "left_semi")
    agg = (df.filter(F.col(child.fk).isNotNull())
           .groupBy(F.col(child.fk).alias("__fk"))
           .agg(*[agg.alias(name) for name, agg in child.aggs.items()]))
    return agg


def attach_children(parent: DataFrame, parent_key: str, children: list[Child],
                    prefilter: bool = False) -> DataFrame:
    """Parent LEFT JOIN (pre-aggregated child)... without fan-out.

    Output = parent columns + every child's aggregate columns, one row per
    parent row. ``prefilter`` semi-joins children to the (filtered) parent's
    keys before aggregating.
    """
    out = parent
    fills: dict[str, object] = {}
    for child in children:
        agg = pre_aggregate(child, parent if prefilter else None, parent_key)
        out = out.join(agg, out[parent_key] == agg["__fk"], "left").drop("__fk")
        for name in child.aggs:
            fills[name] = (child.fill or {}).get(name, 0)
    return out.fillna({k: v for k, v in fills.items() if v is not None}) if fills else out



def with_balance(parent: DataFrame, key: str, fee: str, child: DataFrame, fk: str,
                 amount: str, paid: str = "paid", remaining: str = "remaining",
                 prefilter: bool = False) -> DataFrame:
    """``paid = IFNULL(SUM(amount), 0)``, ``remaining = fee - paid``
    per parent row, from payments aggregated per parent before the join.
    ``prefilter`` aggregates only the payments of the parent's keys (used
    when the parent is a page of a list)."""
    out = attach_children(parent, key, [Child(child, fk, {paid: F.sum(amount)})], prefilter=prefilter)
    zero = F.lit(0).cast("decimal(22,2)")
    out = out.withColumn(paid, F.coalesce(F.col(paid), zero))
    return out.withColumn(remaining, F.col(fee) - F.col(paid))
