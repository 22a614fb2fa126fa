"""Registered queries: one Spark builder and one independent oracle SQL each.

``QUERIES[name].build(t)`` runs the library over a table provider ``t``
(``Bindings`` over a scale-factor folder). ``QUERIES[name].oracle()`` is
the same question in plain SQL for DuckDB over the driver's tables, with
the bindings as CTEs. Money leaves both sides as DOUBLE (sums stay exact
decimals until the final cast). The list texts come from the
specifications in ``oracle``; the others are written by hand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crmlake.sources.bindings import oracle_views


@dataclass
class Query:
    name: str
    build: Callable[..., DataFrame]
    views: list[str] = field(default_factory=list)
    sql: str | None = None
    ctes: str = ""
    doc: str = ""

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        prefix = oracle_views(self.views)
        if self.ctes:
            prefix = prefix.rstrip() + ",\n" + self.ctes.strip() + "\n"
        return prefix + self.sql.strip()


def present(df: DataFrame) -> DataFrame:
    """Final projection of a registered result: decimals become DOUBLE."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


QUERIES: dict[str, Query] = {}


def register(name: str, views: list[str], sql: str | None = None, ctes: str = ""):
    def deco(fn):
        QUERIES[name] = Query(name, fn, views, sql, ctes, (fn.__doc__ or "").strip())
        return fn
    return deco


def page_ctes(list_sql: str, order: str, page: int, per_page: int) -> str:
    """CTEs ``lst`` (the list), ``num`` (numbered) and ``pg`` (clamped page)."""
    return f"""lst AS ({list_sql}),
num AS (SELECT *, row_number() OVER (ORDER BY {order}) AS row_num FROM lst),
pg AS (SELECT LEAST({page}, GREATEST(1, CAST(ceil(count(*) / {per_page}.0) AS BIGINT))) AS page FROM lst)"""


PAGE_SELECT = """SELECT num.*, pg.page FROM num, pg
WHERE num.row_num > (pg.page - 1) * {per_page} AND num.row_num <= pg.page * {per_page}"""


def meta_sql(page: int, per_page: int) -> str:
    return f"""SELECT page, pages, total, CAST({per_page} AS BIGINT) AS per_page, page > 1 AS has_prev,
       page < pages AS has_next, (page - 1) * {per_page} + 1 AS first_row,
       LEAST(page * {per_page}, total) AS last_row, pages > 1 AS show_bar
FROM (SELECT total, pages, LEAST({page}, pages) AS page
      FROM (SELECT count(*) AS total, GREATEST(1, CAST(ceil(count(*) / {per_page}.0) AS BIGINT)) AS pages
            FROM lst) a) b"""
