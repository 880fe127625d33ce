"""Readers, writers and the stage cache on real files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators.waveform import time_statistics
from signalframe.sources import readers, sinks


def test_csv_and_parquet_agree(spark, tmp_path):
    df = spark.range(10).select((1 + F.col("id") / 9).alias("f1"), (F.col("id") % 2).cast("int").alias("label"))
    sinks.write_csv(df, str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    a, b = (sorted(map(tuple, readers.read_table(spark, str(tmp_path / n)).collect())) for n in ("t.csv", "t.parquet"))
    assert a == b and len(a) == 10
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.xlsx"))


def test_array_text_with_line_breaks_survives_csv(spark, tmp_path):
    text = "array([1.0, 2.0,\n       3.0])"
    sinks.write_csv(spark.createDataFrame([(1, text)], "id int, a string"), str(tmp_path / "a.csv"))
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), multiline=True).first()["a"] == text


def test_directory_prefers_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    spark.range(3).write.parquet(str(tmp_path / "z.parquet"))
    assert readers.read_directory(spark, str(tmp_path)).count() == 2
    assert readers.read_directory(spark, str(tmp_path), first_only=True).first()["x"] == 1
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        readers.read_directory(spark, str(tmp_path / "empty"))


def test_source_options():
    assert readers.parse_source("/d::max_signals=12::Seed = 7::junk") == ("/d", {"max_signals": "12", "seed": "7"})
    assert [readers.positive_int(t, 42) for t in (None, "7", "0", "-3", "x")] == [42, 7, 42, 42, 42]
    with pytest.raises(ValueError):
        readers.check_schema("image")


def test_npy_directory(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {f"{i % 2}_wave_{i}.npy": rng.normal(size=(8, 8)) for i in range(6)}
    for name, x in data.items():
        np.save(tmp_path / name, x)
    rows = {r["sample_id"]: r for r in readers.read_npy_directory(spark, str(tmp_path)).collect()}
    assert np.allclose(rows["1_wave_3.npy"]["features"], data["1_wave_3.npy"].ravel()) and rows["1_wave_3.npy"]["label"] == "1"
    (tmp_path / "labels.csv").write_text("file,label\n0_wave_0.npy,9\n")
    rows = {r["sample_id"]: r["label"] for r in readers.read_npy_directory(spark, str(tmp_path)).collect()}
    assert rows["0_wave_0.npy"] == "9" and rows["1_wave_1.npy"] == "1"
    np.save(tmp_path / "1_wave_9.npy", np.zeros(3))
    with pytest.raises(ValueError):
        readers.read_npy_directory(spark, str(tmp_path))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("signals")
    rng = np.random.default_rng(1)
    data = rng.normal(size=(120, 6))
    rows = spark.createDataFrame([tuple(float(v) for v in r) for r in data], ", ".join(f"`{i}` double" for i in range(6)))
    rows.coalesce(1).write.parquet(str(root / "one"))
    for name, part in (("a", data[:70]), ("b", data[70:])):
        frame = spark.createDataFrame([tuple(float(v) for v in r) for r in part], ", ".join(f"`{i}` double" for i in range(6)))
        frame.coalesce(1).write.parquet(str(root / "two" / f"part={name}"))
    meta = spark.createDataFrame([(i, i // 3, i % 3, (i % 2) if i != 4 else None) for i in range(8)],
                                 "signal_id int, id_measurement int, phase int, target int")
    return root, data, meta


@pytest.mark.parametrize("layout", ["one", "two"])
def test_row_numbers_follow_file_order(spark, wide, layout):
    root, data, _ = wide
    cols = [str(i) for i in range(6)]
    rows = readers.read_with_time(spark, str(root / layout), cols).orderBy("t").collect()
    assert [r["t"] for r in rows] == list(range(120))
    assert np.allclose([[r[c] for c in cols] for r in rows], data)
    assert readers.read_with_time(spark, str(root / layout), cols, 100).count() == 100


def test_signal_table(spark, wide):
    root, data, meta = wide
    out = {r["signal_id"]: r for r in readers.read_signal_table(spark, str(root / "one"), meta, "target", {"max_timesteps": "100"}).collect()}
    assert sorted(out) == ["0", "1", "2", "3", "5"]  # 4 has no target, 6 and 7 no column
    x = data[:100, 3]
    assert out["3"]["signal_mean"] == pytest.approx(x.mean()) and out["3"]["signal_zero_cross_rate"] == pytest.approx(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
    assert len([c for c in out["3"].asDict() if c.startswith(("signal_", "fft_", "stft_"))]) == 21  # 20 features and the id
    long = readers.read_signals_long(spark, str(root / "two"), ["0", "5"], 50, chunk=1)
    assert {r["signal_id"]: r["n"] for r in time_statistics(long).collect()} == {"0": 50, "5": 50}
    assert readers.read_signal_table(spark, str(root / "one"), meta, "target", {"max_signals": "2"}).count() == 2
    with pytest.raises(ValueError):
        readers.select_signals(spark, str(root / "one"), meta.where("signal_id > 5"), "target")


def test_cache_notices_changed_inputs(spark, tmp_path):
    source, calls = tmp_path / "in.csv", []
    source.write_text("x\n1\n")

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    def run(**options):
        return sinks.cached(spark, str(tmp_path / "cache"), options, compute, [str(source)]).count()

    assert run(seed=1) == 1 and run(seed=1) == 1 and len(calls) == 1
    assert run(seed=2) == 2 and len(calls) == 2
    source.write_text("x\n1\n2\n3\n")
    run(seed=1)
    assert len(calls) == 3


def test_histories_and_predictions(spark, tmp_path):
    for d, text in (("a", "run_dir,accuracy\nr1,0.5\n"), ("b", "run_dir,f1\nr2,0.25\n"), ("c", "")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "benchmark_metrics.csv").write_text(text)
    dirs = [str(tmp_path / d) for d in ("a", "b", "c", "missing")]
    got = {r["run_dir"]: (r["accuracy"], r["f1"]) for r in readers.read_run_histories(spark, dirs).collect()}
    assert got == {"r1": (0.5, None), "r2": (None, 0.25)}
    assert readers.read_run_histories(spark, dirs[2:]) is None
    (tmp_path / "p.csv").write_text("y_true,y_pred,is_labeled\n1,1,True\n-1,-1,False\n")
    assert readers.read_predictions(spark, str(tmp_path / "p.csv")).count() == 1


def test_fitted_projections_run_on_a_stream(spark, tmp_path):
    """Per-row operators with frozen constants apply to a streaming frame unchanged."""
    from signalframe.operators.scale import apply_scaler, fit_scaler
    from signalframe.operators.threephase import PHASES, add_three_phase

    rows = spark.range(20).select(*[(F.col("id") * (i + 1) % 7).cast("double").alias(p) for i, p in enumerate(PHASES)])
    rows.write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("features", F.array(*PHASES))
    scaler = fit_scaler(batch, "features", 6)
    want = apply_scaler(add_three_phase(batch), "features", scaler)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withColumn("features", F.array(*PHASES))
    query = apply_scaler(add_three_phase(stream), "features", scaler).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))
