"""Classifiers on Spark ML and the sweeps around them.

A candidate is fitted on a frame with ``features`` (array) and ``y`` (codes from 0) and returns a
scorer: DataFrame in, the same frame plus ``probability`` (array), ``score`` (class 1) and
``y_pred`` out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import newton, sweeps
from .augment import gaussian_noise, noise_levels
from .evaluate import argmax_class, curve_areas, metric_column, minmax_scores, summary, tuned_or_native
from .scale import apply_scaler, fit_scaler
from .spec import layout_indices, pick
from .split import fold_rows, fraction_rows, resampled_bags, with_class_weights

Scorer = Callable[[DataFrame], DataFrame]

# Default settings per candidate (fixed values).
DEFAULTS: dict[str, dict] = {
    "majority": {},
    "random_forest": {"trees": 200, "depth": 10},
    "logistic_regression": {"c": 1.0, "iterations": 200},
    "bagged_logistic_regression": {"c": 2.0, "iterations": 200, "bags": 9},
    "linear_svc": {"c": 1.0, "iterations": 200},
    "mlp": {"hidden": (64, 32), "iterations": 200},
    "gradient_boosting": {"trees": 100, "depth": 3},
}
CANDIDATES = tuple(DEFAULTS)


def candidate_params(name: str, params: Mapping | None = None) -> dict:
    """Defaults of a candidate overridden by ``params``: flat, or nested under the candidate's name."""
    if name not in DEFAULTS:
        raise ValueError(f"unknown candidate {name!r}, expected one of {CANDIDATES}")
    given = dict(params or {})
    own = given.get(name, {k: v for k, v in given.items() if not isinstance(v, Mapping)})
    return {**DEFAULTS[name], **{k: v for k, v in own.items() if k in DEFAULTS[name]}}


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("_sf_vec", array_to_vector(F.col("features")))


def _with_class(df: DataFrame, probability: Column) -> DataFrame:
    out = df.withColumn("probability", probability)
    p = F.col("probability")
    return out.withColumns({"score": F.get(p, F.lit(1)), "y_pred": argmax_class(p)})


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("_sf_vec", "_sf_raw", "_sf_prob", "_sf_pred")


def _probabilities(model) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        return _clean(_with_class(model.transform(_vectors(df)), vector_to_array("_sf_prob")))

    return score


def majority_class(train: DataFrame, label: str = "y") -> DataFrame:
    """One row ``y``: the most frequent label, the lowest on ties."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), label)).alias("y"))


def _fit_majority(train: DataFrame, classes: int) -> Scorer:
    best = int(majority_class(train).first()["y"])
    one_hot = [1.0 if k == best else 0.0 for k in range(classes)]
    return lambda df: _with_class(df, F.lit(one_hot))


_COLUMNS = dict(featuresCol="_sf_vec", labelCol="y", predictionCol="_sf_pred")
_PROB = dict(_COLUMNS, probabilityCol="_sf_prob", rawPredictionCol="_sf_raw")


def _logistic(rows: int, p: Mapping) -> LogisticRegression:
    return LogisticRegression(**_PROB, weightCol="weight", standardization=True, maxIter=p["iterations"], regParam=1.0 / (p["c"] * max(rows, 1)))


def _fit_bags(train: DataFrame, classes: int, width: int, p: Mapping, seed: int, ids: Sequence[str]) -> Scorer:
    """Models of exact bootstrap resamples, each with its own scaling and class weights, fitted together; probabilities are averaged."""
    rows = train.select(*ids, "features", F.col("y").cast("int").alias("y"))
    rows = cut_lineage(resampled_bags(rows, ids, seed, p["bags"], "masks").select("features", "y", "masks"))
    bags = newton.fit_all(rows, [newton.Fit(b, tuple(range(width)), p["c"]) for b in range(p["bags"])], p["bags"], classes, width, p["iterations"])

    @F.pandas_udf("array<double>")
    def mean(rows: pd.Series) -> pd.Series:
        if len(rows) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(list(sum(m.probabilities(x) for m in bags) / len(bags)))

    return lambda df: _with_class(df, mean("features"))


def _fit_svc(train: DataFrame, classes: int, rows: int, p: Mapping) -> Scorer:
    base = LinearSVC(featuresCol="_sf_vec", labelCol="y", predictionCol="_sf_pred", weightCol="weight", rawPredictionCol="_sf_raw",
                     maxIter=p["iterations"], regParam=1.0 / (p["c"] * max(rows, 1)))
    if classes == 2:
        model = base.fit(train)

        def score_two(df: DataFrame) -> DataFrame:
            out = model.transform(_vectors(df)).withColumn("_sf_margin", F.get(vector_to_array("_sf_raw"), F.lit(1)))
            out = minmax_scores(out, "_sf_margin").withColumn("y_pred", F.col("_sf_pred").cast("int"))
            return _clean(out.withColumn("probability", F.array(1.0 - F.col("score"), F.col("score")))).drop("_sf_margin")

        return score_two
    return _one_against_rest(base, train)


def _one_against_rest(base, train: DataFrame) -> Scorer:
    """One two-class model per class; the class whose model is most in favour wins."""
    model = OneVsRest(classifier=base, featuresCol="_sf_vec", labelCol="y", predictionCol="_sf_pred", weightCol="weight",
                      rawPredictionCol="_sf_raw").fit(train)

    def score_many(df: DataFrame) -> DataFrame:
        out = model.transform(_vectors(df)).withColumn("probability", vector_to_array("_sf_raw"))
        return _clean(out.withColumns({"score": F.get("probability", F.lit(1)), "y_pred": F.col("_sf_pred").cast("int")}))

    return score_many


def fit_candidate(name: str, train: DataFrame, classes: int, width: int, seed: int = 42, params: Mapping | None = None,
                  ids: Sequence[str] = ("id",)) -> Scorer:
    """Fit one candidate with balanced class weights and return its scorer."""
    p = candidate_params(name, params)
    if name == "majority":
        return _fit_majority(train, classes)
    weighted = _vectors(with_class_weights(train, "y"))
    if name == "random_forest":
        forest = RandomForestClassifier(**_PROB, weightCol="weight", numTrees=p["trees"], maxDepth=p["depth"], seed=seed)
        return _probabilities(forest.fit(weighted))
    if name == "gradient_boosting":
        boosted = GBTClassifier(**_COLUMNS, weightCol="weight", maxIter=p["trees"], maxDepth=p["depth"], seed=seed)
        boosted = boosted.setProbabilityCol("_sf_prob").setRawPredictionCol("_sf_raw")
        return _probabilities(boosted.fit(weighted)) if classes == 2 else _one_against_rest(boosted, weighted)
    if name == "mlp":
        net = MultilayerPerceptronClassifier(**_PROB, layers=[width, *p["hidden"], classes], maxIter=p["iterations"], seed=seed)
        return _probabilities(net.fit(weighted))
    rows = train.count()
    if name == "linear_svc":
        return _fit_svc(weighted, classes, rows, p)
    if name == "bagged_logistic_regression":
        return _fit_bags(train, classes, width, p, seed, ids)
    return _probabilities(_logistic(rows, p).fit(weighted))


def score_with(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: str = "features", out: str = "y_pred") -> DataFrame:
    """Predictions of any function from a matrix to class codes, in Arrow batches."""

    @F.pandas_udf("int")
    def apply(rows: pd.Series) -> pd.Series:
        if len(rows) == 0:
            return pd.Series([], dtype="int32")
        return pd.Series(np.asarray(predict(np.stack(rows.to_numpy()).astype(float)), dtype="int32"))

    return df.withColumn(out, apply(F.col(features)))


def evaluation(df: DataFrame, by: Sequence[str] = (), binary: bool = False) -> DataFrame:
    """Summary of scored rows (``y`` against ``y_pred``), with curve areas for two classes."""
    renamed = df.withColumnRenamed("y", "y_true")
    out = summary(renamed, by)
    if not binary:
        return out
    areas = curve_areas(renamed, by)
    if by:
        return out.join(areas, list(by))
    row = areas.first()
    return out.withColumns({"roc_auc": F.lit(row["roc_auc"]), "pr_auc": F.lit(row["pr_auc"])})


def select_candidate(candidates: Sequence[str], train: DataFrame, val: DataFrame, classes: int, width: int, primary: str = "accuracy",
                     secondary: str = "f1", seed: int = 42, params: Mapping | None = None, ids: Sequence[str] = ("id",),
                     grid: Sequence[float] = ()) -> tuple[str, Scorer, DataFrame]:
    """Best candidate on the validation rows, its scorer, and the table of all candidate scores.

    All candidates are judged in one evaluation over the union of their predictions; the first one
    wins ties.  With a ``grid`` and two classes each candidate may use a tuned threshold instead.
    """
    train = cut_lineage(train)
    scorers = {c: fit_candidate(c, train, classes, width, seed, params, ids) for c in candidates}
    scored = [s(val).select("y", "score", "y_pred").withColumns({"candidate": F.lit(c), "position": F.lit(i)})
              for i, (c, s) in enumerate(scorers.items())]
    union = cut_lineage(reduce(DataFrame.unionByName, scored))
    keys = ["candidate", "position"]
    if grid and classes == 2:
        parts = []
        for i, c in enumerate(scorers):
            one = union.where(F.col("position") == i).withColumnRenamed("y", "y_true")
            parts.append(tuned_or_native(one, grid, [primary, secondary]).withColumns({"candidate": F.lit(c), "position": F.lit(i)}))
        table = reduce(DataFrame.unionByName, parts)
    else:
        table = evaluation(union, keys).withColumn("threshold", F.lit(None).cast("double"))
    order = [metric_column(table, m).desc() for m in (primary, secondary, "accuracy")]
    best = table.orderBy(*order, "position").first()["candidate"]
    return best, scorers[best], table


# --- sweeps: linear and majority models advance together, other candidates are fitted one by one ----


def _standardized(train: DataFrame, other: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    scaler = fit_scaler(train, "features", width)
    return apply_scaler(train, "features", scaler), apply_scaler(other, "features", scaler)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _linear_options(params: Mapping | None) -> dict:
    p = candidate_params("logistic_regression", params)
    return {"c": p["c"], "iterations": p["iterations"]}


def cross_validate(df: DataFrame, name: str, classes: int, width: int, k: int = 5, seed: int = 42, params: Mapping | None = None,
                   ids: Sequence[str] = ("id",)) -> DataFrame:
    """(fold, model_name, accuracy, f1, macro_f1, precision, recall), every fold with its own scaler.

    Scored rows of all folds are evaluated together, grouped by fold.
    """
    if sweeps.fits_batch(name, classes, width):
        return sweeps.cross_validate(df, name, classes, width, k, seed, ids, **_linear_options(params))
    folds = cut_lineage(fold_rows(df, ids, "y", k, seed))
    parts = []
    for f in range(k):
        train, test = _standardized(folds.where(F.col("fold") != f), folds.where(F.col("fold") == f), width)
        scorer = fit_candidate(name, cut_lineage(train), classes, width, seed + f, params, ids)
        parts.append(scorer(test).select("fold", "y", "y_pred"))
    table = evaluation(_union(parts), ["fold"])
    return table.select("fold", F.lit(name).alias("model_name"), "accuracy", "f1", "macro_f1", "precision", "recall")


def _fit_on(parts: Mapping[str, DataFrame], name: str, classes: int, width: int, seed: int, params, ids) -> DataFrame:
    """(split, y, y_pred) of the given parts under a model fitted on the train part."""
    scorer = fit_candidate(name, parts["train"], classes, width, seed, params, ids)
    return _union([scorer(df).select("y", "y_pred").withColumn("split", F.lit(s)) for s, df in parts.items()])


def learning_curve(train: DataFrame, val: DataFrame, test: DataFrame, name: str, classes: int, width: int, fractions: Sequence[float],
                   seed: int = 42, params: Mapping | None = None, ids: Sequence[str] = ("id",)) -> DataFrame:
    """(fraction, split, accuracy, macro_f1) for growing parts of the training rows."""
    if sweeps.fits_batch(name, classes, width):
        return sweeps.learning_curve(train, val, test, name, classes, width, fractions, seed, ids, **_linear_options(params))
    out = []
    for f in fractions:
        part = cut_lineage(fraction_rows(train, ids, f, seed))
        out.append(_fit_on({"train": part, "val": val, "test": test}, name, classes, width, seed, params, ids).withColumn("fraction", F.lit(float(f))))
    return evaluation(_union(out), ["fraction", "split"]).select("fraction", "split", "accuracy", "macro_f1")


def layout_ablation(train: DataFrame, test: DataFrame, names: Sequence[str], layouts: Sequence[str], model: str, classes: int,
                    seed: int = 42, params: Mapping | None = None, ids: Sequence[str] = ("id",)) -> DataFrame:
    """(layout, position, accuracy, macro_f1): scores when only one layout's features are used."""
    columns = {layout: layout_indices(train.sparkSession, names, layout) for layout in layouts}
    if sweeps.fits_batch(model, classes, len(names)):
        return sweeps.layouts(train, test, columns, model, classes, len(names), ids, **_linear_options(params))
    out = []
    for i, (layout, idx) in enumerate(columns.items()):
        cut = [df.withColumn("features", pick("features", idx)) for df in (train, test)]
        scorer = fit_candidate(model, cut_lineage(cut[0]), classes, len(idx), seed, params, ids)
        out.append(scorer(cut[1]).select("y", "y_pred").withColumns({"layout": F.lit(layout), "position": F.lit(i)}))
    return evaluation(_union(out), ["layout", "position"]).select("layout", "position", "accuracy", "macro_f1")


def noise_sweep(test: DataFrame, scorer: Scorer, levels: Sequence[float], metric: str = "macro_f1", seed: int = 42,
                ids: Sequence[str] = ("id",)) -> DataFrame:
    """(noise_sigma, metric) by rising noise.  All levels are scored and evaluated in one job."""
    noisy = gaussian_noise(noise_levels(test, levels), "features", ids, F.col("noise_sigma"), seed)
    table = evaluation(scorer(noisy), ["noise_sigma"])
    return table.select("noise_sigma", metric_column(table, metric).alias(metric)).orderBy("noise_sigma")


def ratio_sweep(fit_and_evaluate: Callable[[float], DataFrame], ratios: Sequence[float], metric: str = "macro_f1") -> DataFrame:
    """(train_ratio, metric) of a user function that returns a metrics frame; ratios outside (0, 1] are skipped.

    ``sweeps.train_ratios`` fits the linear models of all ratios together.
    """
    rows = []
    for r in sorted(float(x) for x in ratios):
        if 0 < r <= 1:
            table = fit_and_evaluate(r)
            rows.append(table.select(F.lit(r).alias("train_ratio"), metric_column(table, metric).alias(metric)))
    if not rows:
        raise ValueError("no ratio lies in (0, 1]")
    return _union(rows).orderBy("train_ratio")


def recipe_comparison(df: DataFrame, recipes: Mapping[str, Sequence[int]], models: Sequence[str], classes: int, k: int = 5, seed: int = 42,
                      params: Mapping | None = None, ids: Sequence[str] = ("id",)) -> DataFrame:
    """(recipe, model_name, cv_mean, cv_std) of cross-validated accuracy per feature recipe and model."""
    together = [m for m in models if sweeps.fits_batch(m, classes, max(map(len, recipes.values())))]
    out = []
    if together:
        used = sorted({i for idx in recipes.values() for i in idx})
        part = df.withColumn("features", pick("features", used))
        places = {recipe: [used.index(i) for i in idx] for recipe, idx in recipes.items()}
        out.append(sweeps.recipe_comparison(part, places, together, classes, len(used), k, seed, ids, **_linear_options(params)))
    for recipe, idx in recipes.items():
        part = df.withColumn("features", pick("features", idx))
        for m in models:
            if m not in together:
                out.append(cross_validate(part, m, classes, len(idx), k, seed, params, ids).withColumn("recipe", F.lit(recipe)))
    folds = reduce(lambda a, b: a.unionByName(b), out)
    return folds.groupBy("recipe", "model_name").agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))
