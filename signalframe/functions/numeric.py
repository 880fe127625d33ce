"""Null-, NaN- and zero-safe arithmetic (ANSI mode raises where NumPy returns nan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EPS = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str, floating: bool = True) -> Column:
    """True for null, and for NaN in floating columns."""
    c = col(c)
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0 or either side is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def floored_div(a: Column, b: Column, floor: float = EPS) -> Column:
    """a / max(b, floor)."""
    return a / F.greatest(b, F.lit(floor))


def half_even(c: Column) -> Column:
    """Round half to even, as a bigint."""
    return F.bround(c.cast("double"), 0).cast("bigint")


def signbit(x: Column) -> Column:
    """True for negative numbers and for -0.0."""
    return (x < 0) | ((x == 0) & x.cast("string").startswith("-"))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def pop_std(cols: list[Column]) -> Column:
    """Population standard deviation across sibling columns."""
    mean = add_all(cols) / len(cols)
    return F.sqrt(add_all([(c - mean) * (c - mean) for c in cols]) / len(cols))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for reports and comparisons."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)
