"""Spectrum-sensing statistics of flattened covariance matrices.

A 2x2 Hermitian matrix arrives as eight numbers (four real parts, four imaginary parts, row by
row).  Its eigenvalues have a closed form, so everything here is arithmetic on array elements.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import array_mean, array_std, cosine, l2_distance, l2_norm, sum_squares
from ..functions.numeric import add_all

BLOCK = 8
# Statistic names in output order (fixed values).
STATS = ("eig_max", "eig_min", "eig_spread", "trace_ed", "mme", "rle", "cav", "coherence", "det", "log_det")
# Scalars that interact with the detector statistics, and which ones (fixed values).
SCALARS = ("power_dB", "spectral_entropy", "freq_bin", "Frequency_Band")
INTERACTING = ("trace_ed", "mme", "coherence")
BASIC = ("norm", "mean", "std")


# The statistics as SQL text: a wide frame needs hundreds of them, and text is parsed in one call each.


def _entries(array: str, start: int) -> tuple[str, str, str]:
    """Both diagonal entries and the squared size of the off-diagonal one, after symmetrising."""
    e = [f"get(`{array}`, {start + k})" for k in range(BLOCK)]
    re_part, im_part = f"(({e[1]} + {e[2]}) / 2D)", f"(({e[5]} - {e[6]}) / 2D)"
    return e[0], e[3], f"({re_part} * {re_part} + {im_part} * {im_part})"


def _stats(top: str, low: str, off2: str) -> dict[str, str]:
    half = f"(({top} - {low}) / 2D)"
    radius = f"sqrt({half} * {half} + {off2})"
    mid = f"(({top} + {low}) / 2D)"
    big, small = f"({mid} + {radius})", f"({mid} - {radius})"
    trace, det = f"({top} + {low})", f"({top} * {low} - {off2})"
    diag = f"(abs({top}) + abs({low}))"
    return {
        "eig_max": big,
        "eig_min": small,
        "eig_spread": f"{big} - {small}",
        "trace_ed": trace,
        "mme": f"{big} / greatest(abs({small}), 1e-15D)",
        "rle": f"{big} / greatest(abs({trace}), 1e-15D)",
        "cav": f"{diag} / greatest({diag} + 2D * sqrt({off2}), 1e-15D)",
        "coherence": f"sqrt({off2}) / greatest(sqrt(abs({top}) * abs({low})), 1e-15D)",
        "det": det,
        "log_det": f"ln(greatest(abs({det}), 1e-30D))",
    }


def hermitian_stats(array: str, start: int = 0) -> dict[str, Column]:
    """The ten statistics of the block of an array column that starts at element ``start``."""
    return {k: F.expr(text) for k, text in _stats(*_entries(array, start)).items()}


def add_block_stats(df: DataFrame, blocks: dict[str, tuple[str, int]]) -> DataFrame:
    """``<name>_<statistic>`` for every {name: (array column, start)}.

    The matrix entries are columns of a first projection, so each statistic stays a small
    expression and the generated code stays below its size limit for many sensors.
    """
    entries = {}
    for name, (array, start) in blocks.items():
        for part, text in zip(("top", "low", "off2"), _entries(array, start)):
            entries[f"_sf_{name}_{part}"] = text
    stats = {f"{name}_{k}": text for name in blocks
             for k, text in _stats(*[f"`_sf_{name}_{p}`" for p in ("top", "low", "off2")]).items()}
    staged = df.selectExpr("*", *[f"{text} AS `{n}`" for n, text in entries.items()])
    return staged.selectExpr("*", *[f"{text} AS `{n}`" for n, text in stats.items()]).drop(*entries)


def _mean_text(cols: Sequence[str]) -> str:
    return f"({' + '.join(f'`{c}`' for c in cols)}) / {len(cols)}D"


def _spread_text(cols: Sequence[str], mean: str) -> str:
    squares = " + ".join(f"(`{c}` - `{mean}`) * (`{c}` - `{mean}`)" for c in cols)
    return f"sqrt(({squares}) / {len(cols)}D)"


def basic_stats(a: Column) -> dict[str, Column]:
    """norm, mean and population std, for arrays that are no 2x2 block."""
    return {"norm": l2_norm(a), "mean": array_mean(a), "std": array_std(a)}


def is_blocked(width: int) -> bool:
    return width >= BLOCK and width % BLOCK == 0


def repeated_blocks(df: DataFrame, array: str, width: int) -> bool:
    """True when every row repeats its first block; decided once over all rows.

    Uses the usual closeness test |x - y| <= 1e-8 + 1e-5 |y|.
    """
    if not is_blocked(width) or width == BLOCK:
        return False
    a = F.col(array)
    far = F.transform(a, lambda x, i: F.abs(x - F.get(a, i % BLOCK)) > 1e-8 + 1e-5 * F.abs(F.get(a, i % BLOCK)))
    # A missing or undefined element is not close to anything.
    row_ok = F.coalesce(~F.exists(far, lambda v: v) & ~F.exists(a, lambda x: F.isnan(x)), F.lit(False))
    return bool(df.agg(F.bool_and(row_ok).alias("same")).first()["same"])


def temporal_summary(df: DataFrame, sensor: str, blocks: Sequence[str]) -> DataFrame:
    """Mean, spread and first-to-last change of every statistic over the time blocks of a sensor.

    ``blocks`` are the prefixes of the block statistics; they are dropped.
    """
    def of(k: str) -> list[str]:
        return [f"{b}_{k}" for b in blocks]

    mean = {k: f"{sensor}_phys_tmean_{k}" for k in STATS}
    out = df.selectExpr("*", *[f"{_mean_text(of(k))} AS `{mean[k]}`" for k in STATS])
    out = out.selectExpr(
        "*", *[f"{_spread_text(of(k), mean[k])} AS `{sensor}_phys_tstd_{k}`" for k in STATS],
        *[f"abs(`{of(k)[-1]}` - `{of(k)[0]}`) AS `{sensor}_phys_tdelta_{k}`" for k in STATS],
    )
    return out.drop(*[c for k in STATS for c in of(k)])


def sensor_arrays(names: Sequence[str], suffix: str) -> dict[str, list[str]]:
    """{SU<n>_<suffix>: its column names by element number}, sensors in order of appearance."""
    pattern = re.compile(rf"^(SU\d+_{re.escape(suffix)})_(\d+)$")
    found: dict[str, list[tuple[int, str]]] = {}
    for n in names:
        m = pattern.match(n)
        if m:
            found.setdefault(m[1], []).append((int(m[2]), n))
    return {p: [n for _, n in sorted(v)] for p, v in found.items()}


def pack_sensors(df: DataFrame, suffixes: Sequence[str] = ("cov_flat", "temporal_cov")) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """Gather ``SU<n>_<suffix>_<i>`` columns into one array per sensor; also {suffix: {sensor: width}}."""
    widths: dict[str, dict[str, int]] = {}
    packed = {}
    for s in suffixes:
        groups = sensor_arrays(df.columns, s)
        widths[s] = {p: len(cols) for p, cols in groups.items()}
        packed.update({p: F.array(*[F.col(c).cast("double") for c in cols]) for p, cols in groups.items()})
    return df.withColumns(packed) if packed else df, widths


def cross_sensor(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Cosine and distance of every sensor pair, and mean and spread of shared statistics."""
    sensors = sorted(sensors)
    pairs = {}
    for i, a in enumerate(sensors):
        for b in sensors[i + 1:]:
            pairs[f"{a}_vs_{b}_cosine"] = cosine(F.col(a), F.col(b))
            pairs[f"{a}_vs_{b}_l2dist"] = l2_distance(F.col(a), F.col(b))
    return df.withColumns(pairs) if pairs else df


def covariance_features(df: DataFrame, widths: dict[str, dict[str, int]]) -> DataFrame:
    """Append every detector, temporal, cross-sensor and interaction feature.

    ``df`` carries one array per sensor as made by ``pack_sensors``.  Statistics of each sensor are
    a first projection; cross-sensor features read its columns, so eigenvalues are computed once.
    """
    cov, temporal = widths.get("cov_flat", {}), widths.get("temporal_cov", {})
    blocks: dict[str, tuple[str, int]] = {}
    plain: dict[str, Column] = {}
    per_sensor: dict[str, list[str]] = {}
    over_time: dict[str, list[str]] = {}
    for p, w in cov.items():
        per_sensor[p] = list(STATS) if w == BLOCK else list(BASIC)
        if w == BLOCK:
            blocks[f"{p}_phys"] = (p, 0)
        else:
            plain.update({f"{p}_phys_{k}": c for k, c in basic_stats(F.col(p)).items()})
    for p, w in temporal.items():
        if not is_blocked(w):
            plain.update({f"{p}_phys_{k}": c for k, c in basic_stats(F.col(p)).items()})
        elif repeated_blocks(df, p, w):
            blocks[f"{p}_phys_tmean"] = (p, 0)
        else:
            over_time[p] = [f"_sf_{p}_{i}" for i in range(w // BLOCK)]
            blocks.update({name: (p, i * BLOCK) for i, name in enumerate(over_time[p])})
    out = df.withColumns(plain) if plain else df
    if blocks:
        out = add_block_stats(out, blocks)
    for p, names in over_time.items():
        out = temporal_summary(out, p, names)
    sensors = sorted(cov)
    if len(sensors) >= 2:
        out = cross_sensor(out, sensors)
        shared = {STATS[i]: [f"{p}_phys_{per_sensor[p][i]}" for p in sensors]
                  for i in range(min(len(per_sensor[p]) for p in sensors))}
        out = out.selectExpr("*", *[f"{_mean_text(c)} AS `cross_su_cov_{k}_mean`" for k, c in shared.items()])
        out = out.selectExpr("*", *[f"{_spread_text(c, f'cross_su_cov_{k}_mean')} AS `cross_su_cov_{k}_std`" for k, c in shared.items()])
    mixed = [
        f"CAST(`{s}` AS DOUBLE) * `{p}_phys_{k}` AS `{p}_{k}_x_{s}`"
        for s in SCALARS if s in df.columns for p in sensors for k in INTERACTING if k in per_sensor[p]
    ]
    return out.selectExpr("*", *mixed) if mixed else out


# Larger matrices: eigenvalues have no closed form, so they go to NumPy in Arrow batches.

# Output names for square matrices (fixed values).
SQUARE_STATS = ("trace_ed", "max_eig", "min_eig", "mme_ratio", "rle_ratio", "cav_ratio", "cond_number", "log_det", "eig_spread")


def _square_stats(m: np.ndarray) -> np.ndarray:
    eig = np.linalg.eigvalsh(m)
    low, top = eig[:, 0], eig[:, -1]
    trace = np.trace(m, axis1=1, axis2=2)
    diag = np.abs(np.diagonal(m, axis1=1, axis2=2)).sum(axis=1)
    ratio = top / np.maximum(np.abs(low), 1e-12)
    return np.column_stack([
        trace, top, low, ratio, top / np.maximum(np.abs(trace), 1e-12),
        diag / np.maximum(np.abs(m).sum(axis=(1, 2)), 1e-12), ratio,
        np.log(np.maximum(np.abs(np.linalg.det(m)), 1e-30)), top - low,
    ])


def square_covariance_stats(flat: Column) -> Column:
    """Struct of trace, eigenvalue, ratio and determinant statistics of a flattened n x n matrix.

    All fields are null when the length is no square number.
    """

    @F.pandas_udf(", ".join(f"{n} double" for n in SQUARE_STATS))
    def stats(values: pd.Series) -> pd.DataFrame:
        out = np.full((len(values), len(SQUARE_STATS)), np.nan)
        sizes = values.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            side = int(round(size ** 0.5))
            if side * side == size:
                rows = np.flatnonzero(sizes == size)
                out[rows] = _square_stats(np.stack(values.iloc[rows].to_numpy()).astype(float).reshape(-1, side, side))
        return pd.DataFrame(out, columns=list(SQUARE_STATS))

    return stats(flat)


def gram_trace(a: Column) -> Column:
    """Trace of the Gram matrix: the sum of squares, whatever the shape."""
    return sum_squares(a)


def row_variance_mean(a: Column, rows: int, width: int) -> Column:
    """Mean over the rows of their population variance, for a flat rows x width matrix."""
    spread = [array_std(F.slice(a, r * width + 1, width)) for r in range(rows)]
    return add_all([s * s for s in spread]) / rows


def gram_eigenvalues(rows: int, width: int, side: str = "columns"):
    """Pandas UDF: ascending eigenvalues of the Gram matrix of a flat rows x width matrix.

    ``side`` "columns" is X'X, "rows" is XX'.
    """

    @F.pandas_udf("array<double>")
    def eigenvalues(flat: pd.Series) -> pd.Series:
        if len(flat) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(flat.to_numpy()).astype(float).reshape(-1, rows, width)
        gram = x.transpose(0, 2, 1) @ x if side == "columns" else x @ x.transpose(0, 2, 1)
        return pd.Series(list(np.linalg.eigvalsh(gram)))

    return eigenvalues


def eigen_ratio(eigenvalues: Column) -> Column:
    """Largest over smallest eigenvalue, the latter by size and at least 1e-15."""
    return F.element_at(eigenvalues, -1) / F.greatest(F.abs(F.element_at(eigenvalues, 1)), F.lit(1e-15))
