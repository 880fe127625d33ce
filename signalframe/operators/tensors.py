"""Multi-channel arrays for sequence models, built as projections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .spec import layout_indices, pick, prefix_groups

_STRUCTURED = re.compile(r"^(SU\d+_(?:cov_flat|temporal_cov))_(\d+)$")


def _channel(features: str, indices: Sequence[int], length: int) -> Column:
    """Elements at ``indices`` followed by zeros up to ``length``: out-of-range reads are the padding."""
    padded = list(indices) + [-1] * (length - len(indices))
    a = F.col(features)
    return F.transform(F.lit(padded), lambda i: F.coalesce(F.when(i >= 0, F.get(a, i)), F.lit(0.0)))


def sequence_channels(names: Sequence[str]) -> list[tuple[str, list[int]]]:
    """(channel, positions): vector prefixes by name, then every other feature on its own."""
    groups = prefix_groups(names)
    used = {i for _, idx in groups for i in idx}
    return groups + [(n, [i]) for i, n in enumerate(names) if i not in used]


def sequence_tensor(df: DataFrame, features: str, names: Sequence[str], layout: str = "all", out: str = "sequence") -> tuple[DataFrame, list[tuple[str, int]]]:
    """Add ``out``: channels x length, zero padded; also the (channel, length) list."""
    keep = layout_indices(df.sparkSession, names, layout)
    channels = sequence_channels([names[i] for i in keep])
    longest = max(len(idx) for _, idx in channels)
    cols = [_channel(features, [keep[i] for i in idx], longest) for _, idx in channels]
    return df.withColumn(out, F.array(*cols)), [(n, len(idx)) for n, idx in channels]


def selected_sequence(df: DataFrame, features: str, order: Sequence[int], out: str = "sequence") -> DataFrame:
    """A single channel of the selected features, in rank order."""
    return df.withColumn(out, F.array(pick(features, order)))


def hybrid_tensor(df: DataFrame, features: str, names: Sequence[str], out: str = "hybrid") -> DataFrame:
    """Add a struct of scalars, covariance channels and temporal channels.

    Both structured kinds must be present; without any scalar the scalar branch is a single zero.
    """
    scalars: list[int] = []
    branches: dict[str, dict[str, list[int]]] = {"cov_flat": {}, "temporal_cov": {}}
    for i, n in enumerate(names):
        m = _STRUCTURED.match(n)
        if m is None:
            scalars.append(i)
            continue
        prefix = m[1]
        kind = "cov_flat" if prefix.endswith("cov_flat") else "temporal_cov"
        branches[kind].setdefault(prefix, []).append(i)
    if not branches["cov_flat"] or not branches["temporal_cov"]:
        raise ValueError("a hybrid sample needs cov_flat and temporal_cov features")

    def branch(kind: str) -> Column:
        longest = max(len(v) for v in branches[kind].values())
        return F.array(*[_channel(features, v, longest) for v in branches[kind].values()])

    scalar = pick(features, scalars) if scalars else F.array(F.lit(0.0))
    return df.withColumn(out, F.struct(
        scalar.alias("scalar"), branch("cov_flat").alias("cov"), branch("temporal_cov").alias("temporal")
    ))
