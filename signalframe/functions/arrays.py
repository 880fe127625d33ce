"""Expressions over one ARRAY<DOUBLE> column.

``array_moments`` walks the array once and keeps a struct; everything that needs a mean or a
spread reads that struct, so no lambda re-evaluates an outer fold per element.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import add_all, col, floored_div, signbit


def fold(a: Column, step, start: float = 0.0) -> Column:
    return F.aggregate(a, F.lit(start), step)


def array_sum(a: Column) -> Column:
    return fold(a, lambda s, x: s + x)


def sum_abs(a: Column) -> Column:
    return fold(a, lambda s, x: s + F.abs(x))


def sum_squares(a: Column) -> Column:
    return fold(a, lambda s, x: s + x * x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(sum_squares(a))


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a).cast("double"))


def array_moments(a: Column) -> Column:
    """struct(n, mean, m2) by a running update that stays accurate for large means."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1.0
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(a, zero, step)


def array_std(a: Column) -> Column:
    """Population standard deviation."""
    return F.aggregate(
        a,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda s, x: F.struct(
            (s["n"] + 1.0).alias("n"),
            (s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)).alias("mean"),
            (s["m2"] + (x - s["mean"]) * (x - s["mean"]) * s["n"] / (s["n"] + 1.0)).alias("m2"),
        ),
        lambda s: F.sqrt(F.try_divide(s["m2"], s["n"])),
    )


def sorted_quantile(s: Column, q: float) -> Column:
    """Linear-interpolated quantile of an already sorted array."""
    pos = (F.size(s) - 1).cast("double") * F.lit(q)
    lo = F.floor(pos).cast("int")
    low = F.get(s, lo)
    high = F.coalesce(F.get(s, lo + 1), low)
    return F.when(pos == lo, low).otherwise(low + (high - low) * (pos - lo))


def pairwise_steps(a: Column, f) -> Column:
    """Array of f(next, current) over neighbours."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), f)


def variation(a: Column) -> Column:
    """Mean absolute step, 0 for fewer than two values."""
    return F.coalesce(array_mean(pairwise_steps(a, lambda x, y: F.abs(x - y))), F.lit(0.0))


def zero_cross_rate(a: Column) -> Column:
    """Share of neighbouring values whose sign bits differ."""
    flips = pairwise_steps(a, lambda x, y: (signbit(x) != signbit(y)).cast("double"))
    return F.coalesce(array_mean(flips), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, floor: float = 1e-15) -> Column:
    return floored_div(dot(a, b), l2_norm(a) * l2_norm(b), floor)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def pad_to(a: Column, length: int) -> Column:
    """Zero-pad (never cut) to ``length``; a null array becomes all zeros."""
    a = F.coalesce(a, F.array().cast("array<double>"))
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


# Names of the per-vector aggregates, in output order (fixed values).
VECTOR_AGGREGATES = (
    "mean", "std", "max", "min", "q25", "median", "q75", "iqr", "range",
    "abs_mean", "l1_energy", "energy", "l2_energy", "variation", "zero_cross_rate",
)


def vector_aggregates(df, array_col: str, prefix: str):
    """Append ``<prefix>__<name>`` for every entry of VECTOR_AGGREGATES.

    The sorted copy, the moments and the two power sums are computed once in a first projection.
    """
    a = F.col(array_col)
    tmp = {
        "_sf_sorted": F.array_sort(a),
        "_sf_m": array_moments(a),
        "_sf_abs": sum_abs(a),
        "_sf_sq": sum_squares(a),
    }
    staged = df.withColumns(tmp)
    s, m, n = F.col("_sf_sorted"), F.col("_sf_m"), F.size(a).cast("double")
    q25, q50, q75 = (sorted_quantile(s, q) for q in (0.25, 0.5, 0.75))
    top, low = F.array_max(a), F.array_min(a)
    values = {
        "mean": m["mean"],
        "std": F.sqrt(m["m2"] / n),
        "max": top,
        "min": low,
        "q25": q25,
        "median": q50,
        "q75": q75,
        "iqr": q75 - q25,
        "range": top - low,
        "abs_mean": F.col("_sf_abs") / n,
        "l1_energy": F.col("_sf_abs"),
        "energy": F.col("_sf_sq") / n,
        "l2_energy": F.sqrt(F.col("_sf_sq")),
        "variation": variation(a),
        "zero_cross_rate": zero_cross_rate(a),
    }
    out = staged.withColumns({f"{prefix}__{k}": values[k] for k in VECTOR_AGGREGATES})
    return out.drop(*tmp)


def array_shape_moments(df, array_col: str, prefix: str):
    """l2norm, mean, std, max, min, range, median, energy, skew and excess kurtosis of an array.

    A spread below 1e-15 counts as 1, so a constant vector has skew 0 and kurtosis -3.
    """
    a = F.col(array_col)
    staged = df.withColumns({"_sf_m": array_moments(a), "_sf_sorted": F.array_sort(a), "_sf_sq": sum_squares(a)})
    n = F.size(a).cast("double")
    spread = F.sqrt(F.col("_sf_m")["m2"] / n)
    staged = staged.withColumns(
        {"_sf_std": spread, "_sf_unit": F.when(spread < 1e-15, F.lit(1.0)).otherwise(spread),
         "_sf_mu": F.col("_sf_m")["mean"]}
    )
    z = F.transform(a, lambda x: (x - F.col("_sf_mu")) / F.col("_sf_unit"))
    out = staged.withColumn("_sf_z", z)
    zc = F.col("_sf_z")
    out = out.withColumns({
        f"{prefix}_l2norm": F.sqrt(F.col("_sf_sq")),
        f"{prefix}_mean": F.col("_sf_mu"),
        f"{prefix}_std": F.col("_sf_std"),
        f"{prefix}_max": F.array_max(a),
        f"{prefix}_min": F.array_min(a),
        f"{prefix}_range": F.array_max(a) - F.array_min(a),
        f"{prefix}_median": sorted_quantile(F.col("_sf_sorted"), 0.5),
        f"{prefix}_energy": F.col("_sf_sq"),
        f"{prefix}_skew": array_mean(F.transform(zc, lambda x: x * x * x)),
        f"{prefix}_kurtosis": array_mean(F.transform(zc, lambda x: x * x * x * x)) - 3.0,
    })
    return out.drop("_sf_m", "_sf_sorted", "_sf_sq", "_sf_std", "_sf_unit", "_sf_mu", "_sf_z")


def fft_head(a: Column, bins: int = 8) -> list[Column]:
    """Magnitudes of the first DFT bins as plain sums (linear in the length for a fixed bin count)."""
    turn = 2.0 * 3.141592653589793

    def part(k: int, wave) -> Column:
        step = F.lit(turn * k) / F.size(a)
        return array_sum(F.transform(a, lambda x, i: x * wave(step * i)))

    out = []
    for k in range(bins):
        re, im = part(k, F.cos), part(k, F.sin)
        out.append(F.when(F.lit(k) <= F.floor(F.size(a) / 2), F.sqrt(re * re + im * im)))
    return out


def mean_across(arrays: list[Column]) -> Column:
    return add_all([array_mean(col(a)) for a in arrays]) / len(arrays)
