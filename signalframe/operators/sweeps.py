"""Model sweeps whose fits all advance together: folds, fractions, ratios, layouts and recipes as training sets of one table.

A row of the table has ``masks``, one boolean per training set, and ``tags``, the name of the part under which the fits of that
training set score it (null: not at all).  The table is written once; fitting reads it once per Newton step and
scoring once more, whatever the number of fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_key
from ..session import cut_lineage
from .evaluate import summary
from .newton import MOST_PARAMETERS, Fit, class_counts, fit_all, predict_all
from .ordering import hash_cutoffs
from .split import fold_rows

#: Candidates that are fitted together.
BATCHED = ("majority", "logistic_regression")

Entry = tuple[int, str, Sequence[int]]


def fits_batch(name: str, classes: int, width: int) -> bool:
    """Whether a candidate can be fitted with all others at once."""
    return name in BATCHED and (1 if classes == 2 else classes) * (width + 1) <= MOST_PARAMETERS


def scored(rows: DataFrame, masks: Sequence[Column], tags: Sequence[Column], entries: Sequence[Entry], classes: int, width: int,
           c: float = 1.0, iterations: int = 200) -> DataFrame:
    """(fit, tag, y, y_pred); ``entries`` are (training set, candidate, feature columns), numbered by ``fit``."""
    table = cut_lineage(rows.select("features", F.col("y").cast("int").alias("y"), F.array(*masks).alias("masks"), F.array(*tags).alias("tags")))
    linear = [i for i, (_, name, _) in enumerate(entries) if name == "logistic_regression"]
    models: list = [None] * len(entries)
    if linear:
        fits = [Fit(entries[i][0], tuple(entries[i][2]), c) for i in linear]
        for i, model in zip(linear, fit_all(table, fits, len(masks), classes, width, iterations)):
            models[i] = model
    if len(linear) < len(entries):
        common = np.argmax(class_counts(table, len(masks), classes), axis=1)
        models = [int(common[e[0]]) if m is None else m for e, m in zip(entries, models)]
    return predict_all(table, [(e[0], m) for e, m in zip(entries, models)])


def _named(table: DataFrame, column: str, values: Sequence, kind: str) -> DataFrame:
    """``table`` with the value of each fit."""
    return table.withColumn(column, F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("fit")))


def _evaluated(predictions: DataFrame) -> DataFrame:
    return summary(predictions.withColumnRenamed("y", "y_true"), ["fit", "tag"])


def _folds(df: DataFrame, ids: Sequence[str], k: int, seed: int) -> tuple[DataFrame, list[Column], list[Column]]:
    fold = F.col("fold")
    return fold_rows(df, ids, "y", k, seed), [fold != j for j in range(k)], [F.when(fold == j, "test") for j in range(k)]


def fractions(train: DataFrame, ids: Sequence[str], wanted: Sequence[float], seed: int) -> list[Column]:
    """Conditions on rows of ``train``: the first max(2, half-even(n * fraction)) in hash order, all cut points from one job."""
    n = train.count()
    names = [f"q{i}" for i in range(len(wanted))]
    plan = train.sparkSession.createDataFrame([tuple(max(2, round(n * f)) for f in wanted)], ", ".join(f"{c} bigint" for c in names))
    cuts = hash_cutoffs(train, plan, [], ids, seed, names).first()
    return [hash_key(seed, *ids) <= F.lit(cuts[c]) for c in names]


def _parts(ids: Sequence[str], **parts: DataFrame) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.select(*ids, "features", "y").withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def cross_validate(df: DataFrame, name: str, classes: int, width: int, k: int, seed: int, ids: Sequence[str], **options) -> DataFrame:
    """(fold, model_name, accuracy, f1, macro_f1, precision, recall)."""
    rows, masks, tags = _folds(df, ids, k, seed)
    table = _evaluated(scored(rows, masks, tags, [(j, name, range(width)) for j in range(k)], classes, width, **options))
    return table.select(F.col("fit").alias("fold"), F.lit(name).alias("model_name"), "accuracy", "f1", "macro_f1", "precision", "recall")


def recipe_comparison(df: DataFrame, recipes: Mapping[str, Sequence[int]], models: Sequence[str], classes: int, width: int, k: int, seed: int,
                      ids: Sequence[str], **options) -> DataFrame:
    """(fold, model_name, recipe, accuracy, ...) of every recipe and model."""
    rows, masks, tags = _folds(df, ids, k, seed)
    entries = [(j, m, columns) for columns in recipes.values() for m in models for j in range(k)]
    table = _evaluated(scored(rows, masks, tags, entries, classes, width, **options))
    table = _named(table, "recipe", [r for r in recipes for _ in models for _ in range(k)], "string")
    table = _named(_named(table, "model_name", [m for _ in recipes for m in models for _ in range(k)], "string"), "fold", [e[0] for e in entries], "int")
    return table.select("fold", "model_name", "recipe", "accuracy", "f1", "macro_f1", "precision", "recall")


def learning_curve(train: DataFrame, val: DataFrame, test: DataFrame, name: str, classes: int, width: int, wanted: Sequence[float], seed: int,
                   ids: Sequence[str], **options) -> DataFrame:
    """(fraction, split, accuracy, macro_f1)."""
    rows, is_train = _parts(ids, train=train, val=val, test=test), F.col("part") == "train"
    inside = [is_train & c for c in fractions(train, ids, wanted, seed)]
    tags = [F.when(~is_train | c, F.col("part")) for c in inside]
    table = _evaluated(scored(rows, inside, tags, [(i, name, range(width)) for i in range(len(wanted))], classes, width, **options))
    return _named(table, "fraction", [float(f) for f in wanted], "double").select("fraction", F.col("tag").alias("split"), "accuracy", "macro_f1")


def train_ratios(train: DataFrame, test: DataFrame, name: str, classes: int, width: int, ratios: Sequence[float], seed: int, ids: Sequence[str], **options) -> DataFrame:
    """(train_ratio, accuracy, macro_f1) on the test rows, one model per part of the training rows; ratios outside (0, 1] are skipped."""
    wanted = sorted({float(r) for r in ratios if 0 < r <= 1})
    if not wanted:
        raise ValueError("no ratio lies in (0, 1]")
    rows, is_train = _parts(ids, train=train, test=test), F.col("part") == "train"
    inside = [is_train & c for c in fractions(train, ids, wanted, seed)]
    tags = [F.when(~is_train, "test")] * len(wanted)
    table = _evaluated(scored(rows, inside, tags, [(i, name, range(width)) for i in range(len(wanted))], classes, width, **options))
    return _named(table, "train_ratio", wanted, "double").select("train_ratio", "accuracy", "macro_f1")


def layouts(train: DataFrame, test: DataFrame, columns: Mapping[str, Sequence[int]], name: str, classes: int, width: int, ids: Sequence[str], **options) -> DataFrame:
    """(layout, position, accuracy, macro_f1) on the test rows, one model per layout's feature columns."""
    rows, is_train = _parts(ids, train=train, test=test), F.col("part") == "train"
    table = _evaluated(scored(rows, [is_train], [F.when(~is_train, "test")], [(0, name, c) for c in columns.values()], classes, width, **options))
    return _named(table, "layout", list(columns), "string").select("layout", F.col("fit").alias("position"), "accuracy", "macro_f1")
