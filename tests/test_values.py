"""Hand-computed values of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions.arrays import array_shape_moments, fft_head, vector_aggregates
from signalframe.functions.numeric import signbit
from signalframe.functions.text import domain_group, fixed, parse_array, prompt_text, readable_name, six_digits, slug
from signalframe.operators import clean, covariance, evaluate, labels, models, profile, runs, spec, tensors, threephase, waveform
from signalframe.operators.rank import fisher_scores, top_features
from signalframe.operators.scale import zscore
from signalframe.operators.split import sample_quotas, split_sizes


def arrays(spark, *rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, a array<double>")


def close(a, b, tol=1e-9):
    return abs(a - b) <= tol * max(1.0, abs(b))


@pytest.mark.parametrize("text,want", [
    ("[1.0, 2.0, 3.0]", [1, 2, 3]), ("array([1.00e-06, 2.0,\n 3])", [1e-6, 2, 3]),
    ("[array([1.,2.5,3]), array([4,5,6e-2])]", [1, 2.5, 3, 4, 5, 0.06]), ("[]", []), ("[1.e-05 2]", [1e-5, 2]),
    ("[1 foo 2]", [1, 2]), ("x", None), ("[a b]", None), ("", None), (None, None),
])
def test_parse_array(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_array(F.col("t")).alias("a")).first()["a"]
    assert got == want


def test_number_text_matches_c(spark):
    rng = np.random.default_rng(0)
    values = [1.234567, -2.0, 0.5, 123456.5, 1e-5, 999999.5, 1e100] + list(rng.normal(size=500) * 10.0 ** rng.integers(-9, 9, 500))
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", six_digits(F.col("x")).alias("s"), fixed(F.col("x"), 3).alias("f")).collect()
    for r in rows:
        assert r["s"] == f"{r['x']:.6g}"
        if abs(r["x"]) < 1e15:
            assert r["f"].replace(",", "") == f"{r['x']:.3f}"
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(six_digits(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in bad] == ["nan"] * 3


def test_prompt_text(spark):
    df = arrays(spark, [1.234567, -2.0], [float("nan"), 0.5])
    texts = [r["p"] for r in df.select(prompt_text(F.col("a"), ["power_dB", "Ia"]).alias("p")).collect()]
    assert "power_dB=1.23457; phase_a_current=-2" in texts[0]
    assert "power_dB=nan; phase_a_current=0.5" in texts[1]
    assert readable_name("SU1_cov_flat_phys_tmean_eig_max") == "SU1_cov_flat_temporal_mean_eig_max"
    assert readable_name("SU1_cov_flat_mme_x_power_dB") == "SU1_cov_flat_max_min_eigenvalue_ratio_times_power_dB"


def test_slug_and_groups(spark):
    df = spark.createDataFrame([("  Hello--World!! ",), ("??",)], "s string")
    assert [r[0] for r in df.select(slug(F.col("s"))).collect()] == ["hello-world", "run"]
    names = spark.createDataFrame([("SU1_cov_flat_0",), ("SU2_temporal_cov_3",), ("Entropy",), ("fft_1",), ("x_fft_1",)], "n string")
    assert [r[0] for r in names.select(domain_group(F.col("n"))).collect()] == [
        "covariance_based", "temporal_covariance", "entropy_related", "spectral_energy", "basic_statistical"]


def test_signbit(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (-1.0,), (2.0,)], "x double").select(signbit(F.col("x"))).collect()
    assert [r[0] for r in rows] == [False, True, True, False]


def test_vector_aggregates_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = [rng.normal(size=n) + 1e6 * (n == 7) for n in (2, 3, 7, 32)] + [np.array([0.0, -0.0, 0.0, -1.0])]
    rows = vector_aggregates(arrays(spark, *data), "a", "p").orderBy("id").collect()
    for x, r in zip(data, rows):
        assert close(r["p__mean"], x.mean()) and close(r["p__std"], x.std(), 1e-6)
        assert close(r["p__q25"], np.quantile(x, 0.25)) and close(r["p__iqr"], np.quantile(x, 0.75) - np.quantile(x, 0.25))
        assert close(r["p__energy"], np.mean(x * x)) and close(r["p__l2_energy"], math.sqrt(np.sum(x * x)))
        assert close(r["p__variation"], np.abs(np.diff(x)).mean())
        assert close(r["p__zero_cross_rate"], np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
    single = vector_aggregates(arrays(spark, [3.0]), "a", "p").first()
    assert single["p__variation"] == 0 and single["p__zero_cross_rate"] == 0 and single["p__median"] == 3


def test_shape_moments(spark):
    x = np.array([1.0, 2, 4, 10])
    r = array_shape_moments(arrays(spark, x, [5, 5, 5]), "a", "p").orderBy("id").collect()
    z = (x - x.mean()) / x.std()
    assert close(r[0]["p_skew"], (z ** 3).mean()) and close(r[0]["p_kurtosis"], (z ** 4).mean() - 3)
    assert r[1]["p_skew"] == 0 and r[1]["p_kurtosis"] == -3


def test_three_phase(spark):
    df = spark.createDataFrame([(1.0, 0.8, 1.2, 0.2, -0.1, -0.1)], "Ia double, Ib double, Ic double, Va double, Vb double, Vc double")
    r = threephase.add_three_phase(df).first()
    want = {"emc_current_sum": 3.0, "emc_current_range": 0.4, "emc_current_diff_ab": 0.2, "emc_current_diff_bc": 0.4, "emc_current_diff_ac": 0.2,
            "emc_voltage_sum": 0.0, "emc_voltage_range": 0.3, "emc_power_like_total": 0.4}
    for k, v in want.items():
        assert abs(r[k] - v) < 1e-12, k
    assert len(threephase.three_phase_features()) == 19
    assert threephase.add_three_phase(df.drop("Vc")).columns == ["Ia", "Ib", "Ic", "Va", "Vb"]


BLOCK = [4, 0.5, 0.5, 4, 0, -0.2, 0.2, 0]


def test_hermitian_statistics(spark):
    s = covariance.hermitian_stats("a")
    r = arrays(spark, BLOCK).select(*[c.alias(k) for k, c in s.items()]).first()
    root = math.sqrt(0.29)
    assert close(r["eig_max"], 4 + root) and close(r["eig_min"], 4 - root) and close(r["det"], 15.71) and r["trace_ed"] == 8
    assert close(r["coherence"], root / 4) and close(r["cav"], 8 / (8 + 2 * root)) and close(r["log_det"], math.log(15.71))
    rng = np.random.default_rng(2)
    x = rng.normal(size=8)
    m = x[:4].reshape(2, 2) + 1j * x[4:].reshape(2, 2)
    h = (m + m.conj().T) / 2
    e = np.linalg.eigvalsh(h)
    r = arrays(spark, x).select(*[c.alias(k) for k, c in s.items()]).first()
    assert close(r["eig_min"], e[0]) and close(r["eig_max"], e[1]) and close(r["det"], np.linalg.det(h).real)


def test_temporal_blocks(spark):
    same = arrays(spark, BLOCK * 4, [2 * v for v in BLOCK] * 4).withColumnRenamed("a", "SU1_temporal_cov")
    out = covariance.covariance_features(same, {"temporal_cov": {"SU1_temporal_cov": 32}})
    assert "SU1_temporal_cov_phys_tmean_eig_max" in out.columns and not [c for c in out.columns if "tstd" in c]
    mixed = arrays(spark, BLOCK * 4, BLOCK * 3 + [9] * 8).withColumnRenamed("a", "SU1_temporal_cov")
    out = covariance.covariance_features(mixed, {"temporal_cov": {"SU1_temporal_cov": 32}})
    first = out.where("id = 0").first()
    assert first["SU1_temporal_cov_phys_tstd_trace_ed"] == 0 and first["SU1_temporal_cov_phys_tdelta_trace_ed"] == 0
    assert out.where("id = 1").first()["SU1_temporal_cov_phys_tdelta_trace_ed"] == 10


def test_sensor_columns(spark):
    names = [f"SU{s}_cov_flat_{i}" for s in (2, 1) for i in (1, 0)] + ["power_dB"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], ", ".join(f"{n} double" for n in names))
    packed, widths = covariance.pack_sensors(df)
    assert widths["cov_flat"] == {"SU2_cov_flat": 2, "SU1_cov_flat": 2}
    assert packed.first()["SU2_cov_flat"] == [2.0, 1.0]
    out = covariance.covariance_features(packed, widths)
    assert "SU1_cov_flat_vs_SU2_cov_flat_cosine" in out.columns and "SU1_cov_flat_phys_norm" in out.columns


def test_square_and_gram(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3, 3))
    m = a + a.T
    r = arrays(spark, m.ravel(), [1, 2, 3]).withColumn("c", covariance.square_covariance_stats(F.col("a"))).orderBy("id").collect()
    e = np.linalg.eigvalsh(m)
    assert close(r[0]["c"]["max_eig"], e[-1]) and close(r[0]["c"]["trace_ed"], np.trace(m))
    assert r[1]["c"]["max_eig"] is None
    x = rng.normal(size=(8, 4))
    e = arrays(spark, x.ravel()).select(covariance.gram_eigenvalues(8, 4, "rows")(F.col("a")).alias("e")).first()["e"]
    assert np.allclose(e, np.linalg.eigvalsh(x @ x.T), atol=1e-9)


def test_waveform_features(spark):
    r = waveform.array_time_statistics(arrays(spark, [1, -1, 1, -1], [0, 1, 2, 3]), "a").orderBy("id").collect()
    assert r[0]["stat_mean"] == 0 and r[1]["stat_peak_to_peak"] == 3
    assert close(r[1]["stat_std"], math.sqrt(1.25)) and close(r[1]["stat_crest_factor"], 3 / math.sqrt(3.5))
    t = np.arange(200) / 100.0
    sine = arrays(spark, np.sin(2 * np.pi * 5 * t))
    s = sine.select(waveform.fft_summary(F.col("a"), 100.0).alias("s")).first()["s"]
    assert close(s["dominant_frequency"], 5.0, 1e-6)
    head = sine.select(*[c.alias(f"f{k}") for k, c in enumerate(fft_head(F.col("a")))]).first()
    assert np.allclose(list(head), np.abs(np.fft.rfft(np.sin(2 * np.pi * 5 * t)))[:8], atol=1e-9)


def test_stft_frames_pad_the_last_frame(spark):
    x = np.arange(10.0) + 1
    got = waveform.stft_frames(arrays(spark, x), "id", "a", 4, 1).orderBy("frame_index", "freq_bin").collect()
    frames = [x[0:4], x[3:7], x[6:10]]
    want = np.concatenate([np.abs(np.fft.rfft(f * np.hanning(4))) for f in frames])
    assert np.allclose([r["magnitude"] for r in got], want)
    short = waveform.stft_frames(arrays(spark, [1.0, 2.0]), "id", "a", 4, 2).collect()
    assert {r["frame_index"] for r in short} == {0}
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            waveform.stft_frames(arrays(spark, x), "id", "a", *bad)


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "y_true int, y_pred int")


def test_evaluation_by_hand(spark):
    p = predictions(spark, list(zip([0, 0, 0, 0, 0, 1], [0, 0, 0, 1, 0, 0])))
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluate.confusion_matrix(p).collect()}
    assert cells == {(0, 0): 4, (0, 1): 1, (1, 0): 1, (1, 1): 0}
    s = evaluate.summary(p).first()
    assert close(s["accuracy"], 4 / 6) and close(s["macro_f1"], 0.4)
    assert (s["minority_label"], s["minority_support"], s["positive_f1"]) == (1, 1, 0)
    # A class that is only predicted has support 0 and is the minority class.
    s = evaluate.summary(predictions(spark, [(0, 0), (1, 2), (1, 1)])).first()
    assert (s["minority_label"], s["minority_support"], s["positive_f1"]) == (2, 0, None)


def test_curves_match_threshold_loop(spark):
    rng = np.random.default_rng(4)
    y, score = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    score[:5] = 1.0
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y_true int, score double")
    got = {round(r["threshold"], 6): r for r in evaluate.curve_points(df, buckets=7).collect()}
    steps = sorted({0.0, 1.0, *score.tolist()}, reverse=True)
    roc, pr = [], []
    for t in steps:
        tp, fp = int(((score >= t) & (y == 1)).sum()), int(((score >= t) & (y == 0)).sum())
        r = got[round(t, 6)]
        assert (r["tp"], r["fp"]) == (tp, fp)
        roc.append((fp / (y == 0).sum(), tp / (y == 1).sum()))
        pr.append((tp / (y == 1).sum(), tp / (tp + fp) if tp + fp else 0.0))
    area = evaluate.curve_areas(df, buckets=7).first()
    assert len(got) == len(steps)
    assert close(area["roc_auc"], float(np.trapezoid(*np.array(roc).T[::-1])))
    assert close(area["pr_auc"], float(np.trapezoid(*np.array(pr).T[::-1])))


def test_native_predictions_win_ties(spark):
    df = spark.createDataFrame([(1, 0.6, 1), (0, 0.6, 0), (1, 0.4, 1), (0, 0.4, 0)], "y_true int, score double, y_pred int")
    r = evaluate.tuned_or_native(df, [0.5, 0.7], ["macro_f1", "accuracy"]).first()
    assert r["threshold"] is None and r["accuracy"] == 1
    worse = df.withColumn("y_pred", 1 - F.col("y_true"))
    assert evaluate.tuned_or_native(worse, [0.7, 0.5], ["accuracy", "macro_f1"]).first()["threshold"] == 0.5
    t = evaluate.best_threshold(evaluate.threshold_table(df, [0.7, 0.5]), ["accuracy"]).first()
    assert t["threshold"] == 0.7  # both reach 0.5; the first of the grid wins


def test_notes(spark):
    one = spark.range(1)
    gap = lambda v: one.select(evaluate.gap_warning(F.lit(v))).first()[0]
    assert gap(0.08) == "High overfitting risk detected: max gap=0.0800 (threshold=0.0500)."
    assert gap(0.01) == "Overfitting risk acceptable: max gap=0.0100 (threshold=0.0500)."
    note = lambda g, a, m: one.select(evaluate.risk_note(F.lit(g), F.lit(a), F.lit(m).cast("double"))).first()[0]
    assert note(0.2, 0.5, None) == "possible_overfit_gap=0.200"
    assert note(0.0, 0.96, 0.97) == "train_val_gap_stable=0.000; high_score_persists_across_ablations"
    assert one.select(evaluate.risk_note(None, F.lit(0.5), F.lit(None).cast("double"))).first()[0] == "no_major_overfit_signal_detected"


def test_cleaning(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, None, None), (1, 3.0, 4.0, None, None)],
                               "y int, Ia double, Ib double, `Unnamed: 7` double, `Unnamed: 8` double")
    assert clean.sanitize(df, "y").columns == ["y", "Ia", "Ib"]
    with pytest.raises(ValueError, match="nope"):
        clean.require_columns(df, ["Ia", "nope"])
    bits = spark.createDataFrame([(1.0, 0.0, None, 1.0)], "G double, C double, B double, A double")
    assert clean.fault_code(bits).first()["fault_code"] == "fault_1001"


def test_mixed_columns_expand(spark):
    df = spark.createDataFrame(
        [(0.5, "linear", "[1.0, 2.0, 3.0]"), (None, None, "[4.0]"), (1.5, "none", None), (float("nan"), "linear", "[7, 8]")],
        "power_dB double, drift string, SU1_cov_flat string")
    s = spec.infer_spec(df)
    assert s.names == ["power_dB", "drift__linear", "drift__missing", "drift__none", "SU1_cov_flat_0", "SU1_cov_flat_1", "SU1_cov_flat_2"]
    rows = [tuple(r) for r in s.expand(df).collect()]
    assert rows[1] == (1.0, 0.0, 1.0, 0.0, 4.0, 0.0, 0.0) and rows[2][4:] == (0.0, 0.0, 0.0) and rows[3][0] == 1.0
    assert s.vector(df).first()["features"] == [0.5, 1.0, 0.0, 0.0, 1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        spec.infer_spec(df, ["drift"], limit=2)


def test_labels(spark):
    df = spark.createDataFrame([("Short",), ("Long",), (None,), ("Medium",)], "c string")
    assert {r["c"]: r["y"] for r in labels.encode_labels(df, "c").collect()} == {"Long": 0, "Medium": 1, "Short": 2, None: 3}
    num = spark.createDataFrame([(10.0,), (2.0,), (None,), (float("nan"),)], "c double")
    assert sorted((r["c"], r["y"]) for r in labels.encode_labels(num, "c").collect()) == [(2.0, 0), (10.0, 1)]
    rows = labels.encode_task(num, "c", "band").collect()
    assert sorted((r["y_band"], r["missing_band"]) for r in rows) == [(-1, True), (-1, True), (0, False), (1, False)]


def test_feature_views(spark):
    names = ["power_dB", "SU1_cov_flat_0", "SU1_cov_flat_1", "SU1_temporal_cov_0", "spectral_entropy", "fft_0"]
    assert spec.group_indices(spark, names, ["spectral_energy", "covariance_based"]) == [1, 2, 5]
    with pytest.raises(ValueError):
        spec.group_indices(spark, names, ["no_such_group"])
    assert spec.group_indices(spark, names, ["no_such_group"], strict=False) == [0, 1, 2, 3, 4, 5]
    assert spec.layout_indices(spark, names, "basic_only") == [0, 4, 5]
    with pytest.raises(ValueError):
        spec.layout_indices(spark, names[:1], "cov_flat_only")


def test_tensors(spark):
    names = ["power_dB", "SU1_cov_flat_0", "SU1_cov_flat_1", "SU1_temporal_cov_0", "SU1_temporal_cov_1", "SU1_temporal_cov_2"]
    df = arrays(spark, [10, 1, 2, 3, 4, 5])
    t, channels = tensors.sequence_tensor(df, "a", names)
    assert channels == [("SU1_cov_flat", 2), ("SU1_temporal_cov", 3), ("power_dB", 1)]
    assert t.first()["sequence"] == [[1, 2, 0], [3, 4, 5], [10, 0, 0]]
    h = tensors.hybrid_tensor(df, "a", names).first()["hybrid"]
    assert (h["scalar"], h["cov"], h["temporal"]) == ([10], [[1, 2]], [[3, 4, 5]])
    with pytest.raises(ValueError):
        tensors.hybrid_tensor(df, "a", ["x"] * 6)


def test_quotas():
    assert split_sizes(40, 0.7, 0.15) == (28, 6, 6)
    assert split_sizes(10, 0.5, 0.25)[1] == 2  # 2.5 rounds to even
    assert sum(sample_quotas([241, 15], 39)) == 39 and min(sample_quotas([1000, 1, 1], 5)) == 1
    with pytest.raises(ValueError):
        split_sizes(10, 0.8, 0.3)


def test_fisher_by_hand(spark):
    df = spark.createDataFrame([([0.0, 5.0], 0), ([2.0, 5.0], 0), ([10.0, 5.0], 1), ([12.0, 5.0], 1)], "f array<double>, y int")
    rows = {r["feature"]: r["score"] for r in fisher_scores(df, "f", "y", ["a", "b"]).collect()}
    assert close(rows["a"], 100 / 4) and rows["b"] == 0
    assert top_features(fisher_scores(df, "f", "y", ["a", "b"]), 1).first()["feature"] == "a"
    z = np.array([r["f"] for r in zscore(df, "f", 2).collect()])
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z[:, 0].std(), 1) and np.allclose(z[:, 1], 0)


def test_run_tables(spark):
    rec = spark.createDataFrame([("a", 0.91, 0.9, "r1"), ("b", 0.88, 0.87, "r2"), ("c", 0.84, 0.82, "r3")], "dataset string, accuracy double, f1 double, run_dir string")
    s = runs.cross_dataset_summary(rec).first()
    assert (s["dataset_count"], s["best_dataset"], s["best_accuracy"]) == (3, "a", 0.91)
    e = runs.cross_dataset_summary(rec.limit(0)).first()
    assert (e["dataset_count"], e["best_dataset"], e["mean_accuracy"]) == (0, "N/A", 0)
    abl = spark.createDataFrame([(0, "all", 0.91), (1, "basic", 0.85), (2, "cov", 0.8)], "pos int, variant string, score double")
    d = runs.delta_to_first(abl, "pos", "score").orderBy("pos")
    notes = [r[0] for r in d.select(runs.ablation_note(F.col("variant"), F.col("score"), F.col("delta"))).collect()]
    assert notes[0] == "all: 0.9100 (delta +0.0000 vs baseline)" and notes[1] == "basic: 0.8500 (delta -0.0600 vs baseline)"
    cv = spark.createDataFrame([(0.9, 0.02), (0.8, 0.03)], "cv_mean double, cv_std double")
    assert tuple(runs.cv_aggregate(cv).first()) == (0.9, 0.025)


def test_profiles(spark):
    df = spark.createDataFrame([(i % 2, float(i), 5.0) for i in range(20)], "y int, x double, k double")
    c = profile.correlation_ranking(df, ["x", "k"], "y").collect()
    assert [r["feature"] for r in c] == ["x"]  # constants have no correlation
    d = {(r["y"], r["feature"]): r for r in profile.class_describe(df, "y", ["x", "k"]).collect()}
    assert d[(0, "x")]["median"] == 9 and d[(1, "k")]["constant"] and not d[(1, "k")]["all_zero"]


def test_candidates(spark):
    assert models.candidate_params("random_forest", {"random_forest": {"trees": 7}, "mlp": {"iterations": 1}})["trees"] == 7
    assert models.candidate_params("mlp", {"iterations": 3, "trees": 9}) == {"hidden": (64, 32), "iterations": 3}
    with pytest.raises(ValueError):
        models.candidate_params("no_such_model")
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) + 3 * (i % 2) for v in rng.normal(size=3)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, features array<double>, y int")
    small = {"trees": 5, "depth": 3, "iterations": 10, "bags": 2, "hidden": (4,)}
    best, scorer, table = models.select_candidate(["majority", "logistic_regression"], df, df, 2, 3, params=small)
    assert best == "logistic_regression" and table.count() == 2
    assert models.evaluation(scorer(df), binary=True).first()["roc_auc"] > 0.9
    for name in ("random_forest", "bagged_logistic_regression", "linear_svc", "mlp", "gradient_boosting"):
        out = models.fit_candidate(name, df, 2, 3, params=small)(df)
        assert {"y_pred", "score", "probability"} <= set(out.columns)
        assert models.evaluation(out).first()["accuracy"] > 0.8, name
    sweep = models.noise_sweep(df, scorer, [5.0, 0.0, -1.0]).collect()
    assert [r["noise_sigma"] for r in sweep] == [0.0, 5.0] and sweep[0]["macro_f1"] >= sweep[1]["macro_f1"]


def test_timestamp_tags_are_utc(spark):
    """Also in another session zone; an hour that summer time repeats has one tag."""
    from signalframe.functions.text import timestamp_tag

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("Asia/Kolkata", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            row = spark.sql("SELECT timestamp_seconds(1700000000) AS a").select(timestamp_tag(F.col("a"))).first()
            assert row[0] == "20231114-221320"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
