"""Scaler, scores and column profiles from one aggregate are those of separate passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import rank, scale, spec


def labelled(spark, n=400, constant=True):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 5)) * [1, 5, 0.1, 2, 1] + y[:, None] * [2, 0, 0.05, -1, 0] + [0, 1e4, 3, 0, 0]
    x[:, 4] = 7.0 if constant else x[:, 4]
    rows = [(i, None if i % 17 == 0 else int(c), [float(v) for v in row], i % 4 > 0) for i, (c, row) in enumerate(zip(y, x))]
    rows[5] = (*rows[5][:2], [None, *rows[5][2][1:]], True)
    return spark.createDataFrame(rows, "id int, y int, f array<double>, train boolean").repartition(6)


def test_merged_moments_are_those_of_all_rows(spark):
    df = labelled(spark)
    whole = {r["idx"]: r for r in scale.feature_moments(df, "f", 5).collect()}
    merged = {r["idx"]: r for r in scale.merged_moments(scale.feature_moments(df, "f", 5, ["y"])).collect()}
    assert merged.keys() == whole.keys() and merged[0]["n"] == 399
    for i, r in whole.items():
        assert merged[i]["n"] == r["n"]
        assert merged[i]["mean"] == pytest.approx(r["mean"], rel=1e-12) and merged[i]["var"] == pytest.approx(r["var"], rel=1e-9, abs=1e-12)


def test_one_aggregate_gives_scaler_and_scores(spark):
    df, names = labelled(spark), list("abcde")
    fitted = rank.fit_scaled_scores(df, "f", "y", names, F.col("train"))
    z = scale.zscore(df, "f", 5, F.col("train")).where("train")
    want = {r["feature"]: r["score"] for r in rank.fisher_scores(z, "f", "y", names).collect()}
    got = {r["feature"]: r["score"] for r in fitted.scores.collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12) and got["e"] == 0.0
    scaler = sorted(scale.fit_scaler(df, "f", 5, F.col("train")).collect())
    for a, b in zip(sorted(fitted.scaler.collect()), scaler):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)
    assert fitted.scaler.where("idx = 4").first()["std"] == 1.0


def test_no_rows_no_scores(spark):
    fitted = rank.fit_scaled_scores(labelled(spark).where("false"), "f", "y", list("abcde"), F.col("train"))
    assert fitted.scaler.count() == 0 and fitted.scores.count() == 0


def test_one_profile_for_all_columns(spark):
    rows = [(i, float(i % 10), f"[{i}, 1]" if i % 10 else None, f"k{i % 3}", i % 2 == 0, [1.0] * (i % 4), f"u{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, t string, c string, b boolean, a array<double>, u string").withColumn("d", F.lit("2024-01-01").cast("date"))
    seen = spec.profile_columns(df, ["x", "t", "c", "a", "d"])
    assert seen["x"].mean == 4.5 and (seen["t"].share, seen["t"].width) == (1.0, 2) and seen["c"].share == 0.0
    assert seen["a"].width == 3 and seen["c"].distinct == 3 and seen["d"].distinct == 1
    s = spec.infer_spec(df, ["x", "t", "c", "a", "d"])
    assert s.names == ["x", "t_0", "t_1", "c__k0", "c__k1", "c__k2", "a_0", "a_1", "a_2", "d__2024-01-01"]
    assert spec.categories(df, ["c", "d"]) == {"c": ["k0", "k1", "k2"], "d": ["2024-01-01"]}
    with pytest.raises(ValueError, match="u has more than"):
        spec.infer_spec(df, ["c", "u"], limit=150)
    with pytest.raises(ValueError, match="u has more than"):
        spec.infer_spec(df, ["c", "u"], limit=20)
    assert len(spec.infer_spec(df, ["u"], limit=200).names) == 200


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double, c string, a array<double>")
    s = spec.infer_spec(df)
    assert [f.kind for f in s.features] == ["number", "category", "array"] and s.names == ["x"] and s.features[0].fill == 0.0
