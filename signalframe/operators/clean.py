"""Cleaning of raw tables before feature expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import is_missing
from .spec import as_number, is_numeric


def _present_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    kinds = dict(df.dtypes)
    row = df.agg(*[
        F.count(as_number(c, kinds[c]) if kinds[c] in ("float", "double") else F.col(f"`{c}`")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def sanitize(df: DataFrame, target: str | None = None, strict: bool = False) -> DataFrame:
    """Drop index leftovers ("Unnamed: ...") and columns without any value.

    ``strict`` drops only columns that are both.  The target column always stays.
    """
    others = [c for c in df.columns if c != target]
    present = _present_counts(df, others) if others else {}

    def useless(c: str) -> bool:
        leftover, empty = c.startswith("Unnamed:"), present[c] == 0
        return (leftover and empty) if strict else (leftover or empty)

    return df.drop(*[c for c in others if useless(c)])


def ordered_unique(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(names))


def drop_leakage(df: DataFrame, per_task: Sequence[Sequence[str]], targets: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop the union of the tasks' leakage columns, never a target; also returns what was dropped."""
    wanted = ordered_unique([c for cols in per_task for c in cols])
    gone = [c for c in wanted if c in df.columns and c not in targets]
    return df.drop(*gone), gone


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")


def target_missing(df: DataFrame, target: str):
    return is_missing(f"`{target}`", floating=dict(df.dtypes)[target] in ("float", "double"))


def drop_missing_target(df: DataFrame, target: str, text_nulls: str = "class") -> DataFrame:
    """Keep rows with a target.  A null text is a class of its own, or missing too with ``text_nulls="drop"``."""
    require_columns(df, [target])
    if text_nulls not in ("class", "drop"):
        raise ValueError("text_nulls must be 'class' or 'drop'")
    if text_nulls == "drop" and not is_numeric(dict(df.dtypes)[target]):
        return df.where(F.col(f"`{target}`").isNotNull())
    return df.where(~target_missing(df, target)) if is_numeric(dict(df.dtypes)[target]) else df


def missing_target_count(df: DataFrame, target: str) -> DataFrame:
    """One row ``dropped``: how many rows ``drop_missing_target`` removes."""
    if not is_numeric(dict(df.dtypes)[target]):
        return df.agg(F.lit(0).cast("bigint").alias("dropped"))
    return df.agg(F.count_if(target_missing(df, target)).alias("dropped"))


def fault_code(df: DataFrame, indicators: Sequence[str] = ("G", "C", "B", "A"), out: str = "fault_code") -> DataFrame:
    """``fault_`` followed by the indicator digits; a missing indicator counts as 0."""
    require_columns(df, indicators)
    kinds = dict(df.dtypes)
    digits = [F.coalesce(as_number(c, kinds[c]), F.lit(0.0)).cast("int").cast("string") for c in indicators]
    return df.withColumn(out, F.concat(F.lit("fault_"), *digits))
