"""Batched fits against Spark ML and plain NumPy, and the number of scans they take."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalframe.operators import models, newton, sweeps
from signalframe.operators.split import with_class_weights


def rows_of(spark, n, width, classes, seed=3, folds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width)) * np.arange(1, width + 1) + 5
    lean = x @ rng.normal(0, 0.4, (width, classes)) + rng.gumbel(0, 2, (n, classes))
    y = lean.argmax(1)
    data = [(i, [float(v) for v in r], int(c), i % folds) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id long, features array<double>, y int, fold int").repartition(4)


def masked(df, folds):
    return df.withColumn("masks", F.array(*(F.col("fold") != j for j in range(folds))))


@pytest.mark.parametrize("classes", [2, 3])
def test_coefficients_are_spark_mls(spark, classes):
    _, _, df = rows_of(spark, 400, 4, classes)
    fits = [newton.Fit(j, columns, 0.5) for columns in ((0, 1, 2, 3), (1, 3)) for j in range(3)]
    found = newton.fit_all(masked(df, 3), fits, 3, classes, 4)
    for fit, model in zip(fits, found):
        train = with_class_weights(df.where(F.col("fold") != fit.mask), "y")
        train = train.withColumn("v", array_to_vector(F.array(*(F.col("features")[c] for c in fit.columns)))).cache()
        lr = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", maxIter=1000, tol=1e-14, regParam=1 / (0.5 * train.count()))
        want = lr.fit(train)
        assert np.allclose(model.coefficients, want.coefficientMatrix.toArray(), atol=1e-6)
        assert np.allclose(model.intercepts, np.array(want.interceptVector), atol=1e-6)
        train.unpersist()


def test_jobs_do_not_grow_with_folds(spark, monkeypatch):
    _, _, df = rows_of(spark, 120, 2, 2)
    scans = []
    real = newton._scan
    monkeypatch.setattr(newton, "_scan", lambda *a: scans.append(len(a[4])) or real(*a))
    newton.fit_all(masked(df, 3), [newton.Fit(0, (0, 1))], 3, 2, 2)
    one = len(scans)
    scans.clear()
    newton.fit_all(masked(df, 3), [newton.Fit(j, c) for j in range(3) for c in ((0, 1), (0,), (1,))], 3, 2, 2)
    assert len(scans) <= one + 3 and max(scans) == 9


def test_odd_training_sets(spark):
    """A constant feature, a class that is missing, one class alone and no rows at all."""
    data = [(i, [float(i % 7), 1.0], i % 3 if i < 30 else 0) for i in range(60)]
    df = spark.createDataFrame(data, "id long, features array<double>, y int")
    masks = F.array(F.col("id") < 30, F.col("y") < 2, F.col("y") == 0, F.lit(False))
    found = newton.fit_all(df.withColumn("masks", masks), [newton.Fit(j, (0, 1)) for j in range(4)], 4, 3, 2)
    assert all(np.isfinite(m.coefficients).all() and np.isfinite(m.intercepts).all() for m in found)
    assert all((m.coefficients[:, 1] == 0).all() for m in found)
    x = np.array([[float(i % 7), 1.0] for i in range(60)])
    assert set(found[1].predict(x)) <= {0, 1} and set(found[2].predict(x)) == {0} == set(found[3].predict(x))


def test_separable_classes_converge(spark):
    data = [(i, [float(i)], int(i >= 50)) for i in range(100)]
    df = spark.createDataFrame(data, "id long, features array<double>, y int").withColumn("masks", F.array(F.lit(True)))
    model, = newton.fit_all(df, [newton.Fit(0, (0,), 1e6)], 1, 2, 1)
    assert model.predict(np.arange(100.0)[:, None]).tolist() == [int(i >= 50) for i in range(100)]


def numpy_accuracy(x, y, train, test, c, classes):
    """Gradient descent with a small step on the same objective."""
    counts = np.bincount(y[train], minlength=classes)
    w = (len(train) / ((counts > 0).sum() * np.maximum(counts, 1)))[y[train]]
    mean = (w @ x[train]) / w.sum()
    sd = np.sqrt((w @ (x[train] - mean) ** 2) / (w.sum() - (w * w).sum() / w.sum()))
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], 1)
    theta, pen = np.zeros((classes, z.shape[1])), 1 / (c * len(train))
    hot = np.eye(classes)[y[train]]
    for _ in range(4000):
        s = z[train] @ theta.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (w[:, None] * (p - hot)).T @ z[train] / w.sum()
        g[:, :-1] += pen * theta[:, :-1]
        theta -= 0.5 * g
    return (( z[test] @ theta.T).argmax(1) == y[test]).mean()


def test_cross_validation_against_numpy(spark):
    x, y, df = rows_of(spark, 300, 3, 3, seed=5)
    got = {r["fold"]: r["accuracy"] for r in models.cross_validate(df, "logistic_regression", 3, 3, 4, 42).collect()}
    folds = {r["id"]: r["fold"] for r in sweeps.fold_rows(df.drop("fold"), ["id"], "y", 4, 42).collect()}
    place = np.array([folds[i] for i in range(300)])
    for j in range(4):
        assert got[j] == pytest.approx(numpy_accuracy(x, y, np.flatnonzero(place != j), np.flatnonzero(place == j), 1.0, 3), abs=1e-12)


def test_batched_and_single_candidates_mix(spark):
    _, _, df = rows_of(spark, 90, 3, 2)
    table = models.recipe_comparison(df, {"a": [2, 0], "b": [1]}, ["majority", "random_forest"], 2, 2, 42, {"random_forest": {"trees": 2, "depth": 2}})
    assert {(r["recipe"], r["model_name"]) for r in table.collect()} == {(a, m) for a in "ab" for m in ("majority", "random_forest")}
    with pytest.raises(ValueError):
        sweeps.train_ratios(df, df, "majority", 2, 3, (0.0, 1.5), 42, ["id"])
