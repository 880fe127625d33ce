"""Waveform features in the time and frequency domain.

Time-domain statistics run on long rows (signal, t, value) with partial aggregation, so one huge
signal is shared by all tasks.  ``long_features`` transforms long rows in pieces too; the functions on an
array column need a whole signal in one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import array_moments, fft_head, sum_abs, sum_squares, zero_cross_rate
from ..functions.numeric import EPS, signbit
from .chirp import chirp_spectrum

# Output names of the summaries, in order (fixed values).
TIME_STATS = ("mean", "std", "rms", "abs_mean", "max", "min", "peak_to_peak", "crest_factor")
FFT_STATS = ("total_power", "dominant_frequency", "dominant_amplitude", "spectral_centroid", "spectral_bandwidth", "spectral_flatness")
STFT_STATS = ("energy", "mean_magnitude", "std_magnitude", "max_magnitude", "temporal_flux")

SPECTRUM_VALUES = 1 << 20  # values of a spectrum that a task holds at once
BLOCK_VALUES = 1 << 22  # values a UDF transforms at once: 32 MB of doubles
CHUNK = 65_536  # samples per chunk of a long signal
TASK_ROWS = 1 << 20  # samples of long signals that a task sorts
CLASS_VALUES = 512  # samples of a residue class that need no other transform


def dealt(df: DataFrame, samples: int, *keys: str) -> DataFrame:
    """``df`` with its groups dealt over as many tasks as keep each at about ``TASK_ROWS`` samples; unchanged where Spark's own number is enough."""
    parts = -(-samples // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def wide_to_long(df: DataFrame, signals: Sequence[str], t: str = "t", signal: str = "signal_id", chunk: int = 256) -> DataFrame:
    """(signal, t, value) from one column per signal.

    ``chunk`` columns are unpivoted at a time; every chunk scans only its own columns.
    """
    parts = [
        df.select(t, *[F.col(f"`{s}`").cast("double").alias(s) for s in signals[i:i + chunk]])
        .unpivot([t], list(signals[i:i + chunk]), signal, "value")
        for i in range(0, len(signals), chunk)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(signal, t, "value")


def time_statistics(long: DataFrame, signal: str = "signal_id", value: str = "value", prefix: str = "stat_") -> DataFrame:
    """The eight time statistics per signal, and ``n``."""
    x = F.col(value)
    g = long.groupBy(signal).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(F.abs(x)).alias("abs_mean"), F.max(x).alias("max"), F.min(x).alias("min"),
    )
    g = g.withColumns({
        "peak_to_peak": F.col("max") - F.col("min"),
        "crest_factor": F.abs("max") / F.greatest("rms", F.lit(EPS)),
    })
    return g.select(signal, "n", *[F.col(c).alias(prefix + c) for c in TIME_STATS])


def step_statistics(long: DataFrame, signal: str, order: Sequence[str], value: str = "value", chunk: Column | None = None, samples: int = 0) -> DataFrame:
    """(signal, variation, zero_cross_rate): mean absolute step and share of sign changes over time.

    ``chunk`` must grow with the order; it cuts each signal into pieces that are ordered separately,
    so a signal with a third of all rows is not sorted by one task.  By default the first order
    column is a sample number and ``CHUNK`` samples make a piece.  Steps between pieces are added
    from the pieces' first and last values.  ``samples`` are all rows, where known: see ``dealt``.
    """
    piece = F.floor(F.col(order[0]) / CHUNK) if chunk is None else chunk
    rows = dealt(long.select(signal, *order, F.col(value).alias("_sf_x"), piece.alias("_sf_c")), samples, signal, "_sf_c")
    prev = F.lag("_sf_x").over(W.partitionBy(signal, "_sf_c").orderBy(*order))
    rows = rows.withColumn("_sf_p", prev)

    def step(a: str, b: str) -> Column:
        return F.coalesce(F.abs(F.col(a) - F.col(b)), F.lit(0.0))

    def flip(a: str, b: str) -> Column:
        return F.coalesce((signbit(F.col(a)) != signbit(F.col(b))).cast("bigint"), F.lit(0))

    when = F.struct(*order)
    pieces = rows.groupBy(signal, "_sf_c").agg(
        F.count("*").alias("n"), F.sum(step("_sf_x", "_sf_p")).alias("move"), F.sum(flip("_sf_x", "_sf_p")).alias("flips"),
        F.min_by("_sf_x", when).alias("first"), F.max_by("_sf_x", when).alias("last"),
    )
    pieces = pieces.withColumn("edge", F.lag("last").over(W.partitionBy(signal).orderBy("_sf_c")))
    total = pieces.groupBy(signal).agg(
        F.sum("n").alias("n"), F.sum(F.col("move") + step("first", "edge")).alias("move"),
        F.sum(F.col("flips") + flip("first", "edge")).alias("flips"),
    )
    steps = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    return total.select(signal, (F.col("move") / steps).alias("variation"), (F.col("flips") / steps).alias("zero_cross_rate"))


def gather(long: DataFrame, signal: str = "signal_id", t: str = "t", value: str = "value", max_timesteps: int | None = None) -> DataFrame:
    """(signal, wave): one ordered array per signal of all samples, or of its first ``max_timesteps``.

    A transform of a whole signal needs the signal in one place; statistics over time do not, see above.
    """
    rows = long.where(F.col(t) < max_timesteps) if max_timesteps else long
    packed = rows.groupBy(signal).agg(F.array_sort(F.collect_list(F.struct(t, value))).alias("_sf_w"))
    return packed.select(signal, F.transform("_sf_w", lambda s: s[value].cast("double")).alias("wave"))


def array_time_statistics(df: DataFrame, wave: str, prefix: str = "stat_") -> DataFrame:
    """The eight time statistics of an array column."""
    a = F.col(wave)
    staged = df.withColumns({"_sf_m": array_moments(a), "_sf_sq": sum_squares(a), "_sf_abs": sum_abs(a)})
    n, m = F.size(a).cast("double"), F.col("_sf_m")
    rms = F.sqrt(F.col("_sf_sq") / n)
    top, low = F.array_max(a), F.array_min(a)
    values = (m["mean"], F.sqrt(m["m2"] / n), rms, F.col("_sf_abs") / n, top, low, top - low, F.abs(top) / F.greatest(rms, F.lit(EPS)))
    return staged.withColumns({prefix + k: v for k, v in zip(TIME_STATS, values)}).drop("_sf_m", "_sf_sq", "_sf_abs")


def _by_length(waves: pd.Series, width: int, transform) -> np.ndarray:
    """Apply ``transform(matrix)`` to waves of equal length, in blocks of bounded size."""
    out = np.full((len(waves), width), np.nan)
    sizes = waves.map(lambda w: 0 if w is None else len(w)).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        per = max(1, BLOCK_VALUES // int(size))
        for s in range(0, len(rows), per):
            part = rows[s:s + per]
            out[part] = transform(np.stack(waves.iloc[part].to_numpy()).astype(float))
    return out


def _weighted_moments(weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total, mean and standard deviation of the places ``at`` under each row of weights; zero weight gives zeros."""
    order0, order1 = weights.sum(1), weights @ at
    mean = order1 / np.maximum(order0, EPS)
    # Moments about the middle of the range lose fewer digits than those about zero.
    middle = at[-1] / 2
    shifted = at - middle
    second = weights @ (shifted * shifted) - 2 * (mean - middle) * (weights @ shifted) + (mean - middle) ** 2 * order0
    return order0, mean, np.sqrt(np.maximum(second, 0) / np.maximum(order0, EPS))


def _spectra(signals: np.ndarray, sample_rate: float) -> np.ndarray:
    """The statistics of ``FFT_STATS`` for every row."""
    samples = signals.shape[1]
    if samples < 2:
        raise ValueError("a spectrum needs at least two samples")
    lines = np.abs(np.fft.rfft(signals))
    hertz = np.arange(lines.shape[1]) * (sample_rate / samples)
    strongest = np.argmax(lines, 1)
    energy, middle, width = _weighted_moments(np.square(lines), hertz)
    geometric = np.exp(np.mean(np.log(np.clip(lines, EPS, None)), 1))
    found = {
        "total_power": energy, "spectral_centroid": middle, "spectral_bandwidth": width,
        "dominant_frequency": hertz[strongest], "dominant_amplitude": np.take_along_axis(lines, strongest[:, None], 1)[:, 0],
        "spectral_flatness": geometric / np.clip(np.mean(lines, 1), EPS, None),
    }
    return np.stack([found[k] for k in FFT_STATS], 1)


def fft_summary(wave: Column, sample_rate: float = 1.0) -> Column:
    """Struct of the six spectrum statistics of an array of at least two samples."""

    @F.pandas_udf(", ".join(f"{n} double" for n in FFT_STATS))
    def summarize(waves: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_length(waves, len(FFT_STATS), lambda x: _spectra(x, sample_rate)), columns=list(FFT_STATS))

    return summarize(wave)


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop, :]


def frame_sizes(samples: int, wanted: int, overlap: int) -> tuple[int, int]:
    """(frame, step): frames of 2 samples at least and the signal at most, which advance by one sample at least."""
    frame = int(np.clip(wanted, 2, None)) if samples > 2 else samples
    frame = samples if frame > samples else frame
    return frame, frame - int(np.clip(overlap, 0, frame - 1))


def stft_summary(wave: Column, nperseg: int = 64, noverlap: int = 32) -> Column:
    """Struct of the five short-time spectrum statistics.

    Periodic Hann window scaled by its sum, whole frames only; sizes are clamped to the signal.
    """

    def short_time(x: np.ndarray) -> np.ndarray:
        frame, step = frame_sizes(x.shape[1], nperseg, noverlap)
        taper = np.ones(1) if x.shape[1] == 1 else (1 - np.cos(np.linspace(0, 2 * np.pi, frame, endpoint=False))) / 2
        frames = _frames(x, frame, step)
        count, bins = frames.shape[1], frame // 2 + 1
        total, square, top, moved = (np.zeros(len(x)) for _ in range(4))
        before = None
        # All signals advance together, some frames at a time; only sums and the last frame are kept.
        for first in range(0, count, per := max(1, BLOCK_VALUES // (len(x) * frame))):
            lines = np.abs(np.fft.rfft(frames[:, first:first + per] * taper)) / taper.sum()
            total += lines.sum((1, 2))
            square += np.square(lines).sum((1, 2))
            top = np.maximum(top, lines.max((1, 2)))
            joined = lines if before is None else np.concatenate([before, lines], 1)
            moved += np.abs(np.diff(joined, axis=1)).sum((1, 2))
            before = lines[:, -1:]
        cells = count * bins
        mean, energy = total / cells, square / cells
        found = {"energy": energy, "mean_magnitude": mean, "std_magnitude": np.sqrt(np.maximum(energy - mean * mean, 0)), "max_magnitude": top,
                 "temporal_flux": moved / max(1, (count - 1) * bins)}
        return np.stack([found[k] for k in STFT_STATS], 1)

    @F.pandas_udf(", ".join(f"{n} double" for n in STFT_STATS))
    def summarize(waves: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_by_length(waves, len(STFT_STATS), short_time), columns=list(STFT_STATS))

    return summarize(wave)


def waveform_bundle(df: DataFrame, wave: str, sample_rate: float = 1.0, nperseg: int | Column = 64, noverlap: int = 32,
                    stat_prefix: str = "stat_") -> DataFrame:
    """Append time, spectrum and short-time statistics (8 + 6 + 5 columns)."""
    out = array_time_statistics(df, wave, stat_prefix)
    out = out.withColumns({"_sf_fft": fft_summary(F.col(wave), sample_rate), "_sf_stft": stft_summary(F.col(wave), nperseg, noverlap)})
    out = out.withColumns({f"fft_{n}": F.col("_sf_fft")[n] for n in FFT_STATS})
    return out.withColumns({f"stft_{n}": F.col("_sf_stft")[n] for n in STFT_STATS}).drop("_sf_fft", "_sf_stft")


def signal_features(df: DataFrame, wave: str, length: int) -> DataFrame:
    """The 20 features of one signal table: the bundle under ``signal_`` names plus the zero-cross rate.

    Frame sizes follow the signal length: 256 samples at most, overlapping by a quarter up to 128.
    """
    size, lap = min(256, length), min(128, max(1, length // 4))
    out = waveform_bundle(df, wave, nperseg=size, noverlap=lap, stat_prefix="signal_")
    return out.withColumn("signal_zero_cross_rate", zero_cross_rate(F.col(wave)))


def long_stft(long: DataFrame, length: int, nperseg: int = 64, noverlap: int = 32, signal: str = "signal_id", t: str = "t", value: str = "value", signals: int = 1) -> DataFrame:
    """``stft_summary`` of (signal, t, value) rows, t from 0 to ``length`` - 1, in pieces of about ``CHUNK`` samples.

    A piece also holds the frame before its first, for the flux.  ``signals`` is their number, about.
    """
    frame, step = frame_sizes(length, nperseg, noverlap)
    taper = np.ones(1) if length == 1 else (1 - np.cos(np.linspace(0, 2 * np.pi, frame, endpoint=False))) / 2
    count, per = 1 + (length - frame) // step, max(1, CHUNK // step)
    kind = dict(long.dtypes)[signal]

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        frames = _frames(rows["value"].to_numpy(dtype=float)[None, :], frame, step)[0]
        lines = np.abs(np.fft.rfft(frames * taper)) / taper.sum()
        own = lines[1:] if rows["piece"].iloc[0] else lines
        sums = own.sum(), np.square(own).sum(), own.max(), np.abs(np.diff(lines, axis=0)).sum()
        return pd.DataFrame([(rows["signal"].iloc[0], *map(float, sums))], columns=["signal", "total", "square", "top", "moved"])

    # Frames that hold sample t, and the one after them, whose piece needs t for the flux.
    low = F.greatest(F.lit(0), F.ceil((F.col(t) - (frame - 1)) / step))
    high = F.least(F.floor(F.col(t) / step) + 1, F.lit(count - 1))
    pieces = F.sequence(F.floor(low / per), F.floor(high / per))
    rows = long.where(F.col(t) <= (count - 1) * step + frame - 1).select(
        F.col(signal).alias("signal"), F.col(t).alias("t"), F.col(value).cast("double").alias("value"), F.explode(pieces).alias("piece"))
    sums = dealt(rows, length * signals, "signal", "piece").groupBy("signal", "piece").applyInPandas(add_up, f"signal {kind}, total double, square double, top double, moved double")
    cells = count * (frame // 2 + 1)
    mean, energy = F.sum("total") / cells, F.sum("square") / cells
    values = (energy, mean, F.sqrt(F.greatest(energy - mean * mean, F.lit(0.0))), F.max("top"), F.sum("moved") / max(1, (count - 1) * (frame // 2 + 1)))
    return sums.groupBy(F.col("signal").alias(signal)).agg(*(v.alias(n) for n, v in zip(STFT_STATS, values)))


def long_fft(long: DataFrame, length: int, sample_rate: float = 1.0, signal: str = "signal_id", t: str = "t", value: str = "value", signals: int = 1) -> DataFrame:
    """``fft_summary`` of (signal, t, value) rows, t from 0 to ``length`` - 1, as a transform in two steps.

    With ``length`` = rest * step, each residue class of t modulo ``rest`` is transformed alone; then, after twiddling, the classes
    are transformed across, bin by bin.  ``rest`` is the divisor next below the root.  Where that leaves classes of more than
    ``CLASS_VALUES`` samples and four times the root, as for a prime, the chirp transform takes over, which cuts any length.
    ``signals`` is their number, about.
    """
    if length < 2:
        raise ValueError("a spectrum needs at least two samples")
    rest = next(k for k in range(int(np.sqrt(length)), 0, -1) if length % k == 0)
    step = length // rest
    wide = max(1, SPECTRUM_VALUES // rest)  # bins of the first transform that a block of the second holds
    kind = dict(long.dtypes)[signal]
    middle = (length // 2) * (sample_rate / length) / 2

    def summed(name, k: np.ndarray, lines: np.ndarray) -> pd.DataFrame:
        """Partial sums over spectrum lines ``k``, ascending."""
        if not len(k):
            return pd.DataFrame(columns=names)
        energy, at = np.square(lines), k * (sample_rate / length)
        best, off = int(np.argmax(lines)), at - middle
        return pd.DataFrame([(name, len(k), energy.sum(), energy @ at, energy @ off, energy @ (off * off), np.log(np.clip(lines, EPS, None)).sum(),
                              lines.sum(), lines[best], int(k[best]))], columns=names)

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        r = int(rows["r"].iloc[0])
        lines = np.fft.fft(rows["value"].to_numpy(dtype=float))
        lines *= np.exp(-2j * np.pi * (np.arange(step) * r % length) / length)
        cuts = range(0, step, wide)
        return pd.DataFrame({"signal": rows["signal"].iloc[0], "block": np.arange(len(cuts)), "r": r,
                             "re": [lines.real[a:a + wide] for a in cuts], "im": [lines.imag[a:a + wide] for a in cuts]})

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r")
        lines = np.abs(np.fft.fft(np.stack(rows["re"].to_numpy()) + 1j * np.stack(rows["im"].to_numpy()), axis=0))
        k = (int(rows["block"].iloc[0]) * wide + np.arange(lines.shape[1]))[None, :] + step * np.arange(rest)[:, None]
        half = k <= length // 2
        order = np.argsort(k[half])
        return summed(rows["signal"].iloc[0], k[half][order], lines[half][order])

    names = ["signal", "n", "s", "at", "off", "off2", "logs", "lines", "top", "k"]
    schema = f"signal {kind}, n bigint, s double, at double, off double, off2 double, logs double, lines double, top double, k bigint"
    if step > max(CLASS_VALUES, 4 * np.sqrt(length)):
        parts = chirp_spectrum(long, length, summed, schema, SPECTRUM_VALUES, signal, t, value, lambda df, values, *keys: dealt(df, values * signals, *keys))
    else:
        rows = long.select(F.col(signal).alias("signal"), F.col(t).alias("t"), F.col(value).cast("double").alias("value"), (F.col(t) % rest).cast("bigint").alias("r"))
        first = dealt(rows, length * signals, "signal", "r").groupBy("signal", "r").applyInPandas(along, f"signal {kind}, block bigint, r bigint, re array<double>, im array<double>")
        parts = dealt(first, length * signals, "signal", "block").groupBy("signal", "block").applyInPandas(across, schema)
    total = parts.groupBy("signal").agg(*(F.sum(c).alias(c) for c in names[1:8]), F.max(F.struct("top", (-F.col("k")).alias("k"))).alias("best"))
    c = F.col
    mean = c("at") / F.greatest(c("s"), F.lit(EPS))
    second = c("off2") - 2 * (mean - middle) * c("off") + (mean - middle) * (mean - middle) * c("s")
    found = {
        "total_power": c("s"), "spectral_centroid": mean,
        "spectral_bandwidth": F.sqrt(F.greatest(second, F.lit(0.0)) / F.greatest(c("s"), F.lit(EPS))),
        "dominant_frequency": -c("best.k") * (sample_rate / length), "dominant_amplitude": c("best.top"),
        "spectral_flatness": F.exp(c("logs") / c("n")) / F.greatest(c("lines") / c("n"), F.lit(EPS)),
    }
    return total.select(c("signal").alias(signal), *(found[k].alias(k) for k in FFT_STATS))


def long_features(long: DataFrame, length: int, signal: str = "signal_id", t: str = "t", value: str = "value", signals: int = 1) -> DataFrame:
    """``signal_features`` of (signal, t, value) rows, t from 0 to ``length`` - 1; no signal is gathered.  ``signals`` is their number, about."""
    size, lap = min(256, length), min(128, max(1, length // 4))
    tagged = lambda df, tag, names: df.select(signal, *(F.col(n).alias(tag + n) for n in names))
    stats = time_statistics(long, signal, value, "signal_").select(signal, *(f"signal_{n}" for n in TIME_STATS))
    flips = step_statistics(long, signal, [t], value, samples=length * signals).select(signal, F.col("zero_cross_rate").alias("signal_zero_cross_rate"))
    fft = tagged(long_fft(long, length, 1.0, signal, t, value, signals), "fft_", FFT_STATS)
    stft = tagged(long_stft(long, length, size, lap, signal, t, value, signals), "stft_", STFT_STATS)
    return stats.join(fft, signal).join(stft, signal).join(flips, signal)


# Names of the short waveform features, in order (fixed values).
HEAD_STATS = ("mean", "std", "max", "min", "rms")


def waveform_head(df: DataFrame, wave: str, bins: int = 8) -> DataFrame:
    """Append mean, std, max, min, rms and the magnitudes ``fft_0`` .. of the first spectrum bins."""
    a = F.col(wave)
    staged = df.withColumns({"_sf_m": array_moments(a), "_sf_sq": sum_squares(a)})
    n, m = F.size(a).cast("double"), F.col("_sf_m")
    values = (m["mean"], F.sqrt(m["m2"] / n), F.array_max(a), F.array_min(a), F.sqrt(F.col("_sf_sq") / n))
    out = staged.withColumns(dict(zip(HEAD_STATS, values)))
    return out.withColumns({f"fft_{k}": c for k, c in enumerate(fft_head(a, bins))}).drop("_sf_m", "_sf_sq")


def waveform_overview(long: DataFrame, signal: str = "signal_id", value: str = "value") -> DataFrame:
    """(signal, rms, peak_to_peak, max_abs)."""
    x = F.col(value)
    return long.groupBy(signal).agg(
        F.sqrt(F.avg(x * x)).alias("rms"), (F.max(x) - F.min(x)).alias("peak_to_peak"), F.max(F.abs(x)).alias("max_abs")
    )


def preview(long: DataFrame, signal: str, t: str, first_signal, points: int = 1024) -> DataFrame:
    """The first ``points`` samples of one signal; both filters reach the scan."""
    return long.where((F.col(signal) == F.lit(first_signal)) & (F.col(t) < points))


def stft_frames(df: DataFrame, key: str, wave: str, nperseg: int = 64, noverlap: int = 32) -> DataFrame:
    """(key, frame_index, freq_bin, magnitude) rows of the short-time spectrum.

    Symmetric Hann window, unscaled; the last frame is padded with zeros.
    """
    if nperseg < 1 or noverlap not in range(nperseg):
        raise ValueError(f"a frame of {nperseg} samples cannot overlap the next by {noverlap}")
    hop = nperseg - noverlap
    window = np.hanning(nperseg)
    freq = np.fft.rfftfreq(nperseg, d=1.0)
    kind = dict(df.dtypes)[key]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, w in zip(batch[key], batch[wave]):
                x = np.asarray(w, dtype=float)
                if len(x) == 0:
                    raise ValueError("a waveform needs at least one sample")
                count = 1 + max(0, -(-(len(x) - nperseg) // hop))
                padded = np.zeros(nperseg + (count - 1) * hop)
                padded[:len(x)] = x[:len(padded)]
                mag = np.abs(np.fft.rfft(_frames(padded[None, :], nperseg, hop)[0] * window, axis=1))
                yield pd.DataFrame({
                    key: k, "frame_index": np.repeat(np.arange(count), len(freq)),
                    "freq_bin": np.tile(freq, count), "magnitude": mag.ravel(),
                })

    return df.select(key, wave).mapInPandas(expand, f"{key} {kind}, frame_index int, freq_bin double, magnitude double")


def dominant_frequency(frames: DataFrame, key: str) -> DataFrame:
    """(key, dominant_freq, dominant_magnitude): peak of the mean spectrum, lowest frequency on ties."""
    mean = frames.groupBy(key, "freq_bin").agg(F.avg("magnitude").alias("m"))
    best = F.max_by(F.struct("freq_bin", "m"), F.struct(F.col("m"), (-F.col("freq_bin")).alias("f")))
    return mean.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.freq_bin").alias("dominant_freq"), F.col("b.m").alias("dominant_magnitude")
    )
