"""Reproducible pseudo-random order and draws from md5, independent of row placement.

Spark's ``rand`` depends on the partition a row sits in, so a recomputed task may draw other
numbers.  Keys made from (seed, id) are the same on every attempt and in other engines.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, functions as F

from .numeric import col

def _poisson1_cdf() -> tuple[float, ...]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2, ... draws, as far as a double can tell them from 1."""
    out, term, total, k = [], exp(-1.0), 0.0, 0
    while total + term > total and total + term < 1.0:
        total += term
        out.append(total)
        k += 1
        term /= k
    return tuple(out)


POISSON1_CDF = _poisson1_cdf()


def hash_key(seed: int | str | Column, *ids: Column | str) -> Column:
    """32 hex digits ordering rows for a seed; a null id counts as a character that no text id has."""
    return F.md5(F.concat_ws("|", seed if isinstance(seed, Column) else F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit("\0")) for c in ids]))


def uniform_of(key: Column, word: int = 0) -> Column:
    """One of the four 32-bit words of a key, scaled to [0, 1)."""
    digits = F.substring(key, 8 * word + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def normal_of(key: Column) -> Column:
    """Standard normal draw from the first two words of a key."""
    u = F.greatest(uniform_of(key, 0), F.lit(1.0 / 4294967296.0))
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * uniform_of(key, 1))


def fine_uniform_of(key: Column) -> Column:
    """The first 52 bits of a key, scaled to [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def poisson1_of(key: Column) -> Column:
    """Poisson(1) draw from the first 52 bits of a key, exact to their resolution."""
    u = fine_uniform_of(key)
    hits = [F.when(u >= p, F.lit(1)).otherwise(F.lit(0)) for p in POISSON1_CDF]
    out = hits[0]
    for h in hits[1:]:
        out = out + h
    return out
