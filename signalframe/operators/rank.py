"""Supervised feature ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .scale import feature_moments, merged_moments, scaler_of


def fisher_of(moments: DataFrame, names: Sequence[str], standardized: bool = False) -> DataFrame:
    """(idx, feature, score): between-class over within-class scatter, from a table of (class, feature) moments.

    ``standardized`` scores the z-values of the same rows.  They shift and stretch every class alike, so both scatters are
    those of the raw values over the squared spread of the element, and the rows are not read again for it.
    """
    # The table of moments is small; the mean over classes is added to its rows, so no class list is built.
    per = W.partitionBy("idx")
    m = moments.withColumn("mu", F.sum(F.col("n") * F.col("mean")).over(per) / F.sum("n").over(per))
    off = F.col("mean") - F.col("mu")
    totals = m.groupBy("idx").agg(F.sum(F.col("n") * off * off).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    if standardized:
        squared = scaler_of(merged_moments(moments)).select("idx", (F.col("std") * F.col("std")).alias("unit"))
        totals = totals.join(squared, "idx").select("idx", (F.col("between") / F.col("unit")).alias("between"), (F.col("within") / F.col("unit")).alias("within"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("idx"))
    return totals.select("idx", name.alias("feature"), (F.col("between") / F.greatest("within", F.lit(1e-8))).alias("score"))


def fisher_scores(df: DataFrame, features: str, label: str, names: Sequence[str]) -> DataFrame:
    """(idx, feature, score) of the values as they are.  Rows are reduced to (class, feature) moments in one pass."""
    return fisher_of(feature_moments(df, features, len(names), [label]), names)


@dataclass(frozen=True)
class Fitted:
    """What standardising and ranking need of the training rows: ``scaler`` (idx, mean, std) and ``scores`` (idx, feature, score)."""

    scaler: DataFrame
    scores: DataFrame


def fit_scaled_scores(df: DataFrame, features: str, label: str, names: Sequence[str], train: Column) -> Fitted:
    """Scaler of the training rows and separation scores of their z-values, both from one aggregate.

    The moments, a row per class and element, are written and read by both.
    """
    moments = cut_lineage(feature_moments(df.where(train), features, len(names), [label]))
    return Fitted(scaler_of(merged_moments(moments)), fisher_of(moments, names, True))


def ranked(scores: DataFrame) -> DataFrame:
    """Add ``rank`` 1.. by score, first feature on ties.  The table has one row per feature."""
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "idx")))


def top_features(scores: DataFrame, k: int | str | None) -> DataFrame:
    """The ``k`` best features; None or "full" keeps all."""
    if k in (None, "full"):
        return ranked(scores)
    return ranked(scores.orderBy(F.desc("score"), "idx").limit(int(k)))


def keep_features(df: DataFrame, features: str, selected: DataFrame) -> DataFrame:
    """Reduce the array column to the selected features, in rank order."""
    order = [r["idx"] for r in selected.orderBy("rank").select("idx").collect()]
    a = F.col(features)
    return df.withColumn(features, F.array(*[F.get(a, F.lit(i)) for i in order]))
