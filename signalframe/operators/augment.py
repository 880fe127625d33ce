"""Reproducible noise and masking of feature arrays.

Draws come from md5 of (seed, row id, element), so a recomputed task repeats them exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_key, normal_of, uniform_of


def _cell_key(seed: int | str, ids: Sequence[str], i: Column) -> Column:
    return hash_key(seed, *ids, i)


def gaussian_noise(df: DataFrame, features: str, ids: Sequence[str], sigma: Column | float, seed: int, out: str | None = None) -> DataFrame:
    """Add sigma * N(0, 1) to every element; sigma 0 leaves the row as it is."""
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    noisy = F.transform(features, lambda x, i: x + s * normal_of(_cell_key(seed, ids, i)))
    return df.withColumn(out or features, F.when(s == 0, F.col(features)).otherwise(noisy))


def random_mask(df: DataFrame, features: str, ids: Sequence[str], ratio: float, seed: int, out: str = "corrupted") -> DataFrame:
    """Set a random share of the elements to 0; keeps the clean array beside it."""
    if not 0 <= ratio < 1:
        raise ValueError("ratio must lie in [0, 1)")
    masked = F.transform(features, lambda x, i: F.when(uniform_of(_cell_key(seed, ids, i)) < ratio, F.lit(0.0)).otherwise(x))
    return df.withColumn(out, masked)


def noisy_pairs(df: DataFrame, features: str, ids: Sequence[str], ratio: float, seed: int, out: str = "corrupted") -> DataFrame:
    """Additive noise times ``ratio``, beside the clean array."""
    return gaussian_noise(df, features, ids, ratio, seed, out)


def noise_levels(df: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Every row once per noise level, as column ``noise_sigma``; negative levels are skipped."""
    kept = sorted({float(v) for v in levels if v >= 0})
    return df.withColumn("noise_sigma", F.explode(F.lit(kept)))
