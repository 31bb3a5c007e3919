"""Column expressions for cleaning (P4-P9, P19, F12).  All built-in, codegen'd."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EDGE_WS = r"^\s+|\s+$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), _EDGE_WS, "")


def code(c: str | Column) -> Column:
    """Upper-case + strip."""
    return F.upper(strip(c))


def nan_to_null(c: str | Column) -> Column:
    """NaN → null (SQL null is the only missing value downstream)."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clamp(c: str | Column, lo: float | None = None, hi: float | None = None, null_as_lower: bool = False) -> Column:
    """Clamp that keeps missing values missing (pandas ``clip``).

    ``null_as_lower=True`` is P7, the observed silver behaviour: ``greatest`` and
    ``least`` skip nulls, so a missing value becomes the lower bound."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if null_as_lower:
        return out
    return F.when(c.isNull() | F.isnan(c), F.lit(None).cast("double")).otherwise(out)


def to_number(c: str | Column, integral: bool = False) -> Column:
    """P5: numeric coercion, bad → null (``errors="coerce"``).  With
    ``integral=True`` a fractional value is rejected instead of truncated."""
    d = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    if integral:
        return F.when(d == F.floor(d), d.cast("long")).cast("int")
    return d


def relative_change(new: str | Column, prev: str | Column) -> Column:
    """|new - prev| / |prev|; null when either side is missing or prev is 0."""
    new, prev = _c(new), _c(prev)
    return F.when(prev.isNull() | new.isNull() | (prev == 0), F.lit(None).cast("double")).otherwise(
        F.abs(new - prev) / F.abs(prev))
