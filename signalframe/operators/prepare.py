"""From a raw table to standardised, split vectors: the steps of a preparation run in their order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .clean import drop_leakage, drop_missing_target, require_columns, sanitize
from .labels import encode_labels, encode_tasks, label_table
from .scale import apply_scaler, fit_scaler
from .spec import infer_spec
from .split import split_missing_aware, split_rows


@dataclass(frozen=True)
class Prepared:
    """``rows`` has the ids, the codes of the targets, ``split`` and the standardised ``features`` named ``names``."""

    rows: DataFrame
    names: list[str]
    scaler: DataFrame
    labels: dict[str, DataFrame]
    dropped: list[str]


def prepare(df: DataFrame, ids: Sequence[str], target: str, leakage: Sequence[str] = (), train_ratio: float = 0.7, val_ratio: float = 0.15,
            seed: int = 42, text_nulls: str = "class") -> Prepared:
    """One target: clean, drop leakage and rows without target, expand, split by class, standardise on the training rows."""
    require_columns(df, [*ids, target])
    rows, dropped = drop_leakage(sanitize(df, target), [leakage], [target, *ids])
    rows = drop_missing_target(rows, target, text_nulls)
    spec = infer_spec(rows, [c for c in rows.columns if c != target and c not in ids])
    coded = encode_labels(rows, target, "y")
    return _finish(spec, coded, ids, ["y"], {target: label_table(rows, target)}, dropped,
                   lambda v: split_rows(v, ids, "y", train_ratio, val_ratio, seed))


def prepare_tasks(df: DataFrame, ids: Sequence[str], tasks: dict[str, str], leakage: Sequence[Sequence[str]] = (), train_ratio: float = 0.7,
                  val_ratio: float = 0.15, seed: int = 42) -> Prepared:
    """Several targets {task: column}: rows stay without some of them, and every part gets an incomplete row where there are three."""
    require_columns(df, [*ids, *tasks.values()])
    rows, dropped = drop_leakage(sanitize(df), leakage, [*tasks.values(), *ids])
    spec = infer_spec(rows, [c for c in rows.columns if c not in tasks.values() and c not in ids])
    coded = encode_tasks(rows, tasks)
    keep = [c for t in tasks for c in (f"y_{t}", f"missing_{t}")]
    lacking = F.lit(False)
    for t in tasks:
        lacking = lacking | F.col(f"missing_{t}")
    return _finish(spec, coded, ids, keep, {t: label_table(rows, c) for t, c in tasks.items()}, dropped,
                   lambda v: split_missing_aware(v, ids, lacking, f"y_{next(iter(tasks))}", train_ratio, val_ratio, seed))


def _finish(spec, coded, ids, keep, labels, dropped, split) -> Prepared:
    vectors = cut_lineage(spec.vector(coded, [*ids, *keep]))
    parts = split(vectors)
    scaler = fit_scaler(parts, "features", len(spec.names), F.col("split") == "train")
    return Prepared(apply_scaler(parts, "features", scaler), spec.names, scaler, labels, dropped)
