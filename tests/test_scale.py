"""Skewed, tied and repartitioned inputs: results must not depend on how rows are placed."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from signalframe.functions.hashing import hash_key
from signalframe.operators import labels, ordering, split, waveform
from signalframe.operators.evaluate import curve_areas, summary
from signalframe.operators.waveform import step_statistics


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows, half of them in class 0, a third of all values equal."""
    rng = np.random.default_rng(7)
    y = np.where(rng.random(6000) < 0.5, 0, rng.integers(1, 40, 6000))
    v = np.where(rng.random(6000) < 0.33, 1.25, rng.normal(size=6000))
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, v))]
    return spark.createDataFrame(rows, "id bigint, y int, v double").repartition(8)


@pytest.mark.parametrize("small_group", [0, 10**9])
def test_exact_quantiles(spark, skewed, small_group):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    pdf = skewed.toPandas()
    whole = ordering.exact_quantiles(skewed, "v", probs, buckets=16, small_group=small_group).collect()
    assert {r["prob"]: pytest.approx(r["quantile"]) for r in whole} == {p: np.quantile(pdf.v, p) for p in probs}
    got = {(r["y"], r["prob"]): r["quantile"] for r in ordering.exact_quantiles(skewed, "v", probs, ["y"], 16, small_group).collect()}
    for y, g in pdf.groupby("y"):
        for p in probs:
            assert got[(y, p)] == pytest.approx(np.quantile(g.v, p))


def test_infinite_values_have_a_bucket(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(float("inf"),)] * 3 + [(float("-inf"),)] * 2 + [(float("nan"),)], "v double")
    got = {r["prob"]: r["quantile"] for r in ordering.exact_quantiles(df, "v", [0.0, 0.5, 1.0], buckets=4, small_group=0).collect()}
    assert got[0.0] == float("-inf") and got[1.0] == float("inf") and got[0.5] == 25.0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, skewed, descending):
    counts = skewed.groupBy("y", "v").agg(F.count("*").alias("n"))
    order = F.desc("v") if descending else F.asc("v")
    want = {(r["y"], r["v"]): r["c"] for r in counts.withColumn("c", F.sum("n").over(W.partitionBy("y").orderBy(order))).collect()}
    got = {(r["y"], r["v"]): r["cum_n"] for r in ordering.running_sums(counts, "v", ["n"], ["y"], descending, buckets=8).collect()}
    assert got == want


def test_running_sums_over_text(spark):
    words = spark.range(500).select(F.concat(F.lit("w"), F.col("id") * 7919 % 500).alias("w"), F.lit(1).alias("n"))
    got = [r["cum_n"] for r in ordering.running_sums(words, "w", ["n"], buckets=9).orderBy("w").collect()]
    assert got == list(range(1, 501))


def test_large_label_sets_use_running_sums(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 120).cast("string").alias("c"))
    want = {r["value"]: r["code"] for r in labels.label_table(df, "c").collect()}
    monkeypatch.setattr(labels, "SMALL_ROWS", 10)
    monkeypatch.setattr(ordering, "SMALL_ROWS", 10)
    assert {r["value"]: r["code"] for r in labels.label_table(df, "c").collect()} == want
    assert want == {v: i for i, v in enumerate(sorted(str(k) for k in range(120)))}


def test_bounded_side_falls_back(spark):
    df = spark.range(20).select("id", (F.col("id") * 2).alias("twice"))
    assert ordering.bounded_side(df, 5) is df
    assert spark.range(40).join(ordering.bounded_side(df, 5), "id").count() == 20


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_cutoffs_fill_quotas(spark, skewed, digits):
    plan = skewed.groupBy("y").agg(F.floor(F.count("*") / 3).alias("q"), F.lit(0).alias("none"), (F.count("*") + 5).alias("over"))
    cuts = ordering.hash_cutoffs(skewed, plan, ["y"], ["id"], 1, ["q", "none", "over"], digits)
    key = hash_key(1, "id")
    hit = skewed.join(cuts, "y").groupBy("y").agg(
        F.count_if(key <= F.col("q")).alias("q"), F.count_if(key <= F.col("none")).alias("none"), F.count_if(key <= F.col("over")).alias("over"), F.count("*").alias("n"))
    for r in hit.collect():
        assert (r["q"], r["none"], r["over"]) == (r["n"] // 3, 0, r["n"])


def test_split_is_complete_and_stable(spark, skewed):
    def run(df):
        return {r["id"]: r["split"] for r in split.split_rows(df, ["id"], "y", 0.7, 0.15, 3).collect()}

    first = run(skewed)
    assert len(first) == 6000
    assert first == run(skewed.repartition(1)) == run(skewed.repartition(13, "v"))
    counts = {s: list(first.values()).count(s) for s in ("train", "val", "test")}
    assert abs(counts["train"] - 4200) <= 40 and abs(counts["val"] - 900) <= 40


def test_small_classes_fall_back_to_a_random_split(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 2, 1).otherwise(0).alias("y"))
    got = [r["split"] for r in split.split_rows(df, ["id"], "y", 0.7, 0.15, 7).collect()]
    assert (got.count("train"), got.count("val"), got.count("test")) == (28, 6, 6)


def test_missing_rows_reach_every_part(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 20 != 0, F.lit(1)).alias("task"))
    got = split.split_missing_aware(df, ["id"], F.col("task").isNull(), None, 0.7, 0.15, 7).collect()
    assert {r["split"] for r in got if r["task"] is None} == {"train", "val", "test"}
    assert [sum(r["split"] == s for r in got) for s in ("train", "val", "test")] == [42, 9, 9]
    few = df.where("id > 20")  # one incomplete row: plain split
    assert split.split_missing_aware(few, ["id"], F.col("task").isNull(), None, 0.7, 0.15, 7).count() == 39


def test_folds_are_even(spark, skewed):
    folds = split.fold_rows(skewed, ["id"], "y", 4, 1).groupBy("y", "fold").count().toPandas()
    spread = folds.groupby("y")["count"].agg(["min", "max"])
    assert ((spread["max"] - spread["min"]) <= 1).all()


def test_sample_counts_null_as_a_class(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("y"))
    got = split.sample_stratified(df, ["id"], "y", 10, 42).toPandas()
    assert len(got) == 10 and got.y.isna().sum() == 5
    assert split.sample_stratified(df, ["id"], "y", 1000, 42).count() == 100


def test_bootstrap_draws_average_one(spark):
    draws = split.bootstrap_counts(spark.range(20000), ["id"], 5).agg(F.avg("draws"), F.var_pop("draws")).first()
    assert abs(draws[0] - 1) < 0.03 and abs(draws[1] - 1) < 0.05
    assert abs(split.bootstrap_rows(spark.range(20000), ["id"], 5).count() - 20000) < 600


@pytest.mark.parametrize("chunk", [1, 7, 100, 10**6])
def test_steps_do_not_depend_on_pieces(spark, chunk):
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)] + [("one", 0, 4.0)], "signal string, t bigint, value double")
    got = {r["signal"]: r for r in step_statistics(df.repartition(5), "signal", ["t"], chunk=F.floor(F.col("t") / chunk)).collect()}
    assert got["s"]["variation"] == pytest.approx(np.abs(np.diff(x)).mean())
    assert got["s"]["zero_cross_rate"] == pytest.approx(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
    assert got["one"]["variation"] == 0


@pytest.mark.parametrize("length", [2, 3, 97, 300, 1024, 1800])
def test_features_do_not_need_whole_signals(spark, monkeypatch, length):
    monkeypatch.setattr(waveform, "CHUNK", 400)
    monkeypatch.setattr(waveform, "SPECTRUM_VALUES", 128)
    rng = np.random.default_rng(length)
    rows = [(s, i, float(v)) for s in ("a", "b") for i, v in enumerate(rng.normal(size=length))]
    long = spark.createDataFrame(rows, "signal_id string, t bigint, value double").repartition(5)
    features = waveform.long_features(long, length)
    want = waveform.signal_features(waveform.gather(long), "wave", length).drop("wave")
    assert features.columns == want.columns
    got, want = ({r["signal_id"]: list(r)[1:] for r in df.collect()} for df in (features, want))
    assert sorted(got) == ["a", "b"]
    for s in got:
        assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_signal_table_gathers_no_signal(spark, tmp_path, monkeypatch):
    from signalframe.sources import readers
    monkeypatch.setattr(waveform, "gather", None)
    monkeypatch.setattr(readers, "gather", None, raising=False)
    spark.range(50).select((F.col("id") % 7).cast("double").alias("0")).coalesce(1).write.parquet(str(tmp_path / "w"))
    meta = spark.createDataFrame([(0, 0, 0, 1)], "signal_id int, id_measurement int, phase int, target int")
    assert readers.read_signal_table(spark, str(tmp_path / "w"), meta, "target").count() == 1


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_shuffle_partitions_do_not_matter(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = skewed.select("id", (F.col("y") > 0).cast("int").alias("y_true"), (F.col("v") > 0).cast("int").alias("y_pred"), F.col("v").alias("score"))
        s, a = summary(df).first(), curve_areas(df).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pdf = df.toPandas()
    assert s["accuracy"] == pytest.approx((pdf.y_true == pdf.y_pred).mean())
    assert 0 <= a["roc_auc"] <= 1


def test_plans_do_not_shuffle_the_payload(spark):
    """Splitting ends in a projection over the scan: only the broadcast of the cut-offs is exchanged."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = split.split_rows(e, ["vec_id"], "label", 0.7, 0.15, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_null_groups_stay(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("y"), (F.col("id") * 7 % 101).cast("double").alias("score"))
    assert split.split_rows(df, ["id"], "y").count() == 400
    assert split.fold_rows(df, ["id"], "y", 4).groupBy("y").count().count() == 4
    assert split.holdout_rows(df, ["id"], "y", 0.2, 1).count() == 400
    assert split.with_class_weights(df, "y").where("weight IS NULL").count() == 0
    sums = ordering.running_sums(df.groupBy("y", "score").agg(F.count("*").alias("n")), "score", ["n"], ["y"])
    assert {r["y"]: r["m"] for r in sums.groupBy("y").agg(F.max("cum_n").alias("m")).collect()} == {None: 80, 0: 107, 1: 107, 2: 106}
    for small in (10**9, 10):
        q = ordering.exact_quantiles(df, "score", [0.5], ["y"], small_group=small)
        assert q.count() == 4 and q.where("y IS NULL AND quantile IS NOT NULL").count() == 1


def test_ids_with_nulls_have_different_keys(spark):
    rows = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert rows.select(hash_key(1, "a", "b")).distinct().count() == 2


def test_long_signals_take_more_tasks_as_they_grow(spark, monkeypatch):
    """Rows that a task sorts stay bounded: more samples mean more tasks, with the same features."""
    long = spark.range(4096).select(F.lit("s").alias("signal_id"), F.col("id").alias("t"), F.sin(F.col("id") / 7).alias("value"))
    plain = waveform.long_features(long, 4096).first()
    monkeypatch.setattr(waveform, "TASK_ROWS", 200)
    dealt = waveform.long_features(long, 4096)
    assert all(abs(a - b) <= 1e-9 * max(1, abs(a)) for a, b in zip(plain[1:], dealt.first()[1:]))
    assert dealt._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 3
