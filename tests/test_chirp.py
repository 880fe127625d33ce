"""Spectra of signals of prime length, cut into pieces, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalframe.operators import chirp, waveform


def test_sizes():
    assert [chirp.smooth_size(k) for k in (1, 7, 11, 1415, 1441)] == [1, 8, 12, 1440, 1458]
    for n in (2, 3, 1009, 1_000_003, 2 * 500_009):
        side = chirp.side_of(n)
        assert side * side >= 2 * n - 1
    assert chirp.side_of(1_000_003) < 2 * np.sqrt(1_000_003)


@pytest.mark.parametrize("length", [2, 3, 13, 101, 1009, 2018])
@pytest.mark.parametrize("held", [1, 128])
def test_lines_are_those_of_numpy(spark, length, held):
    rng = np.random.default_rng(length)
    x = {s: rng.normal(size=length) for s in ("a", "b")}
    long = spark.createDataFrame([(s, i, float(v)) for s in x for i, v in enumerate(x[s])], "signal_id string, t bigint, value double").repartition(4)
    def finish(name, k, lines):
        return pd.DataFrame({"signal": name, "k": k, "m": lines})
    got = chirp.chirp_spectrum(long, length, finish, "signal string, k bigint, m double", held).toPandas()
    for s in x:
        mine = got[got.signal == s].sort_values("k")
        assert mine.k.tolist() == list(range(length // 2 + 1))
        assert np.allclose(mine.m, np.abs(np.fft.rfft(x[s])), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("length", [1009, 1046])
def test_features_of_prime_lengths(spark, monkeypatch, length):
    monkeypatch.setattr(waveform, "CHUNK", 400)
    monkeypatch.setattr(waveform, "SPECTRUM_VALUES", 128)
    rng = np.random.default_rng(length)
    rows = [(s, i, float(v)) for s in ("a", "b") for i, v in enumerate(rng.normal(size=length))]
    long = spark.createDataFrame(rows, "signal_id string, t bigint, value double").repartition(5)
    want = {r["signal_id"]: list(r)[1:] for r in waveform.signal_features(waveform.gather(long), "wave", length).drop("wave").collect()}
    for r in waveform.long_features(long, length).collect():
        assert list(r)[1:] == pytest.approx(want[r["signal_id"]], rel=1e-9, abs=1e-9)


def test_a_million_samples(spark):
    n = 1_000_003
    long = spark.range(n, numPartitions=8).select(F.lit("s").alias("signal_id"), F.col("id").alias("t"), F.sin(F.col("id") * 0.37).alias("value"))
    got = waveform.long_fft(long, n).first()
    want = waveform._spectra(np.sin(np.arange(n) * 0.37)[None, :], 1.0)[0]
    assert list(got)[1:] == pytest.approx(want.tolist(), rel=1e-6)
