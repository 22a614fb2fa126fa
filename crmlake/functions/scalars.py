"""Scalar functions (X1-X17, O4) as ``Column -> Column`` built-ins.

All of these compile to JVM expressions inside whole-stage codegen; none is a
Python UDF. Rounding follows the reference's Python/Jinja rules (half-even,
hence ``bround``), truncation follows ``int()`` (hence ``cast('int')``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values of the reference's display layer.
ELLIPSIS = "…"
EMPTY_MARK = "—"
CURRENCY_SUFFIX = " ₫"
PREVIEW_CHARS = 80
TIER_SUCCESS_MIN = 60
TIER_WARNING_MIN = 30


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ifnull(c: ColumnOrName, default) -> Column:
    """``IFNULL(c, default)``."""
    return F.coalesce(_c(c), default if isinstance(default, Column) else F.lit(default))


def field_rank(c: ColumnOrName, values: list[str]) -> Column:
    """MySQL ``FIELD(c, v1..vn)``: 1-based position, 0 when unlisted or NULL."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), _c(c)), F.lit(0))


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()`` (all leading/trailing Unicode whitespace and
    the separators U+001C to U+001F, not only spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(c: ColumnOrName) -> Column:
    """Form value ``x or None``: blank text becomes NULL."""
    return F.nullif(strip_ws(c), F.lit(""))


def to_number(c: ColumnOrName, default: float = 0.0, dtype: str = "double") -> Column:
    """``float(x or 0)``; unparsable text also falls back (no ANSI error)."""
    return F.coalesce(blank_to_null(c).try_cast(dtype), F.lit(default).cast(dtype))


def month_label(c: ColumnOrName) -> Column:
    """``DATE_FORMAT(ts, '%m/%Y')``."""
    return F.date_format(_c(c), "MM/yyyy")


def month_start(c: ColumnOrName) -> Column:
    """Group key for a calendar month (A8); formatting happens after grouping."""
    return F.date_trunc("month", _c(c))


def fmt_date(c: ColumnOrName) -> Column:
    """``%d/%m/%Y``."""
    return F.date_format(_c(c), "dd/MM/yyyy")


def fmt_datetime(c: ColumnOrName, seconds: bool = False) -> Column:
    """``%d/%m/%Y %H:%M`` (``:%S`` with ``seconds``)."""
    return F.date_format(_c(c), "dd/MM/yyyy HH:mm:ss" if seconds else "dd/MM/yyyy HH:mm")


def fmt_money(c: ColumnOrName) -> Column:
    """X11: ``"{:,.0f}".format(x or 0) + ' ₫'`` (half-even, thousands commas)."""
    return F.concat(F.format_number(F.coalesce(_c(c), F.lit(0)), 0), F.lit(CURRENCY_SUFFIX))


def preview(c: ColumnOrName, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus an ellipsis when longer; NULL becomes ''."""
    col = _c(c)
    return (F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(ELLIPSIS)))
            .otherwise(F.coalesce(col, F.lit(""))))


def placeholder(c: ColumnOrName) -> Column:
    """``x or '—'`` (NULL and empty text show the dash)."""
    return F.coalesce(F.nullif(_c(c).cast("string"), F.lit("")), F.lit(EMPTY_MARK))


def occupancy_pct(current: ColumnOrName, maximum: ColumnOrName, cap: bool = True) -> Column:
    """``int(current / max * 100)``, capped at 100 on the list page.

    Zero capacity gives NULL instead of a division error.
    """
    pct = F.try_divide(_c(current), _c(maximum)) * F.lit(100)
    if cap:  # least() skips NULLs, so keep a NULL (zero capacity) NULL
        pct = F.when(pct.isNotNull(), F.least(pct, F.lit(100.0)))
    return pct.cast("int")


def is_full(current: ColumnOrName, maximum: ColumnOrName) -> Column:
    """Full flag ``current >= max``."""
    return _c(current) >= _c(maximum)


def label(c: ColumnOrName, mapping: dict[str, str], default: ColumnOrName | str | None = None) -> Column:
    """Code -> label with fallback (``dict.get(code, default)``)."""
    col = _c(c)
    out = None
    for code, text in mapping.items():
        out = (F.when(col == F.lit(code), F.lit(text)) if out is None
               else out.when(col == F.lit(code), F.lit(text)))
    fallback = col if default is None else (F.lit(default) if isinstance(default, str) else default)
    return out.otherwise(fallback) if out is not None else fallback


def initial(c: ColumnOrName) -> Column:
    """First character of a name."""
    return F.substring(_c(c), 1, 1)


def debt_flag(remaining: ColumnOrName) -> Column:
    """Remaining > 0."""
    return _c(remaining) > 0


def win_rate(won: ColumnOrName, lost: ColumnOrName) -> Column:
    """``round(won / (won + lost) * 100, 1)``, 0 when nothing is closed."""
    w, lo = _c(won), _c(lost)
    total = w + lo
    return (F.when(total > 0, F.bround(w.cast("double") / total.cast("double") * F.lit(100.0), 1))
            .otherwise(F.lit(0.0)))


def row_win_rate(won: ColumnOrName, total: ColumnOrName, dtype: str = "int") -> Column:
    """Per-row ``int(round(won / total * 100))``; NULL (blank) when total = 0.
    ``dtype`` is a whole-number type that holds it (a ``won`` that a join multiplied passes an INT)."""
    w, t = _c(won), _c(total)
    return F.when(t > 0, F.bround(w.cast("double") / t.cast("double") * F.lit(100.0), 0).cast(dtype))


def win_tier(rate: ColumnOrName) -> Column:
    """Success >= 60, warning >= 30, else danger; NULL when rate is NULL."""
    r = _c(rate)
    return (F.when(r.isNull(), F.lit(None).cast("string"))
            .when(r >= TIER_SUCCESS_MIN, F.lit("success"))
            .when(r >= TIER_WARNING_MIN, F.lit("warning"))
            .otherwise(F.lit("danger")))


def money(c: ColumnOrName) -> Column:
    """Final presentation of an exact decimal amount as DOUBLE (sums stay
    exact decimals until here, so order of addition cannot matter)."""
    return _c(c).cast("double")


def derive_username(email: ColumnOrName) -> Column:
    """``LOWER(REPLACE(SUBSTRING_INDEX(email, '@', 1), '.', '_'))``."""
    return F.lower(F.replace(F.substring_index(_c(email), "@", 1), F.lit("."), F.lit("_")))
