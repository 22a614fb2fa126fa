"""Filters and predicates.

Each builder returns a ``Column`` (or ``None`` for "no condition") so that
callers fold them into one ``filter``; Catalyst then pushes the equality and
range parts into the parquet scan. Substring search cannot prune row groups,
so list operators apply facets (prunable) before search.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crmlake.functions.scalars import _c

SEARCH_MODES = ("binary", "ci", "ci_ai")
ACCENT_COLLATION = "UNICODE_CI_AI_RTRIM"


def clean_query(q: str | None) -> str:
    """The request's ``strip()``; ``None`` counts as blank."""
    return (q or "").strip()


def facet(column: str | Column, value, mode: str = "binary") -> Column | None:
    """``AND col = value`` only when a value was given (non-empty).

    ``mode='ci'`` ignores case; ``mode='ci_ai'`` compares text as the
    reference's database collation does (case, accents and trailing spaces
    ignored)."""
    if value is None or (isinstance(value, str) and value == ""):
        return None
    if mode == "ci_ai" and isinstance(value, str):
        return F.collate(_c(column), ACCENT_COLLATION) == F.lit(value)
    if mode == "ci" and isinstance(value, str):
        return F.lower(_c(column)) == F.lit(value.lower())
    return _c(column) == F.lit(value)


def facets(values: dict, mode: str = "binary") -> Column | None:
    """conjunction of the non-empty facet equalities."""
    return all_of(*[facet(col, val, mode) for col, val in values.items()])


def search(columns: list[str | Column], q: str | None, mode: str = "binary",
           skip_blank: bool = True) -> Column | None:
    """``(c1 LIKE '%q%' OR c2 LIKE '%q%' ...)``.

    ``binary`` is LIKE with the user's ``%``/``_`` acting as wildcards (as the
    reference, which does not escape); ``ci`` is ILIKE; ``ci_ai`` ignores case
    and accents through a collation (wildcards are literal there). A blank
    query is no condition when ``skip_blank`` (CRM lists) and ``LIKE '%%'``
    otherwise (edu lists, which drop rows whose searched columns are all NULL).
    """
    if mode not in SEARCH_MODES:
        raise ValueError(f"search mode {mode!r} not in {SEARCH_MODES}")
    q = clean_query(q)
    if not q and skip_blank:
        return None
    # a backslash makes the next character literal; Spark accepts it only before %, _ and itself
    pattern = re.sub(r"\\([^%_\\])|\\(.)", lambda m: m[1] or m[0], f"%{q}%", flags=re.DOTALL)
    preds = []
    for c in columns:
        col = _c(c)
        if mode == "binary":
            preds.append(col.like(pattern))
        elif mode == "ci":
            preds.append(col.ilike(pattern))
        else:
            preds.append(F.contains(F.collate(col, ACCENT_COLLATION), F.lit(q)))
    return reduce(lambda a, b: a | b, preds)


def all_of(*preds: Column | None) -> Column | None:
    """``WHERE 1=1 AND ...`` over the optional parts."""
    present = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, present) if present else None


def where(df: DataFrame, *preds: Column | None) -> DataFrame:
    cond = all_of(*preds)
    return df if cond is None else df.filter(cond)


def one_of(column: str | Column, values: list) -> Column:
    """``IN (...)``."""
    return _c(column).isin(list(values))


def none_of(column: str | Column, values: list) -> Column:
    """``NOT IN (...)``: NULL is excluded, as in SQL."""
    return ~_c(column).isin(list(values))


def as_timestamp(as_of: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def month_column(column: str) -> str:
    """Name of the partition column of a table stored by month of ``column``."""
    return f"{column}_month"


def month_number(date: Column) -> Column:
    """A calendar month as a number that grows by one a month."""
    return F.year(date) * 12 + F.month(date) - 1


def in_months(df: DataFrame, column: str, as_of, months: int | None = None) -> Column | None:
    """Partition condition of a table stored by month: the months from ``months`` before ``as_of`` on,
    or the month of ``as_of`` alone. No condition for a table stored otherwise."""
    if month_column(column) not in df.columns:
        return None
    now = as_timestamp(as_of)
    if months is None:
        return F.col(month_column(column)) == month_number(now)
    return F.col(month_column(column)) >= month_number(now - F.make_ym_interval(F.lit(0), F.lit(months)))


def rolling_months(column: str | Column, as_of, months: int = 12) -> Column:
    """``col >= DATE_SUB(as_of, INTERVAL n MONTH)`` (no upper bound;
    time of day kept, month end clamped)."""
    start = as_timestamp(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))
    return _c(column) >= start


def month_to_date(column: str | Column, as_of) -> Column:
    """same calendar month and year as ``as_of``, as a range so it prunes."""
    first = F.trunc(as_timestamp(as_of).cast("date"), "MM")
    col = _c(column)
    return (col >= first) & (col < F.add_months(first, 1))
