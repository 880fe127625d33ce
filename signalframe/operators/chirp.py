"""Spectra of signals of any length, prime ones too, by a chirp transform in bounded pieces.

X[k] = w[k] * sum over t of (x[t] * w[t]) * b[k - t] with w[t] = exp(-i pi t**2 / n) and b its conjugate: a convolution, which may be
done by transforms of any size M >= 2 n - 1.  M is the square of a number R with no prime factor above five, so each transform
is one of R residue classes and one across them, and a task never holds more than some columns of R values.  What the forward transform
leaves in a task (all bins j, j + R, j + 2 R, ...) is what the backward transform starts from: the product with the
chirp's own transform is taken there.  Three exchanges in all, of about 4 n values each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def smooth_size(least: int) -> int:
    """The smallest number from ``least`` on whose prime factors are 2, 3 and 5."""
    def reduced(k: int) -> int:
        for p in (2, 3, 5):
            while k % p == 0:
                k //= p
        return k

    return next(k for k in range(max(1, least), 2 * max(1, least) + 1) if reduced(k) == 1)


def side_of(length: int) -> int:
    """R for signals of so many samples."""
    return smooth_size(int(np.ceil(np.sqrt(2 * length - 1))))


def _turn(t: np.ndarray, length: int) -> np.ndarray:
    """exp(-i pi t**2 / length), the square reduced in whole numbers first."""
    return np.exp(-1j * np.pi * (t * t % (2 * length)) / length)


def _chirp_at(index: np.ndarray, size: int, length: int) -> np.ndarray:
    """b at the places of a cyclic convolution of ``size``."""
    t = np.minimum(index, size - index)
    return np.where(t < length, np.conj(_turn(t, length)), 0)


def _twiddle(a: np.ndarray, b: np.ndarray, size: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * (np.multiply.outer(a, b) % size) / size)


def chirp_spectrum(long: DataFrame, length: int, finish: Callable, schema: str, held: int, signal: str = "signal_id", t: str = "t", value: str = "value",
                   dealt: Callable = lambda df, values, *keys: df) -> DataFrame:
    """``finish(signal, bins, magnitudes)``, a DataFrame of ``schema``, over pieces of the spectrum up to bin ``length`` // 2.

    ``held`` is the number of values that a task should hold at once; it holds one column of R values at least.
    ``dealt(df, values of a signal, *keys)`` spreads the groups of an exchange over tasks.
    """
    side = side_of(length)
    size, wide = side * side, max(1, held // side)
    blocks = -(-side // wide)
    kind = dict(long.dtypes)[signal]
    cuts = [(b, b * wide, min(side, (b + 1) * wide)) for b in range(blocks)]
    piece = "block bigint, place bigint, re array<double>, im array<double>"
    names = ["block", "place", "re", "im"]

    def forward(x: np.ndarray, r: int) -> pd.DataFrame:
        lines = np.fft.fft(x) * _twiddle(np.array([r]), np.arange(side), size, -1)[0]
        return pd.DataFrame([(b, r, lines.real[lo:hi], lines.imag[lo:hi]) for b, lo, hi in cuts], columns=names)

    def columns_of(rows: pd.DataFrame) -> np.ndarray:
        rows = rows.sort_values("place")
        return np.stack(rows["re"].to_numpy()) + 1j * np.stack(rows["im"].to_numpy())

    def classes(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["t"].to_numpy(dtype=np.int64)
        x = np.zeros(side, complex)
        x[at // side] = rows["value"].to_numpy(dtype=float) * _turn(at, length)
        out = forward(x, int(at[0] % side))
        out.insert(0, "signal", rows["signal"].iloc[0])
        return out

    def chirp_classes(batches):
        for batch in batches:
            for r in batch["id"].tolist():
                yield forward(_chirp_at(r + side * np.arange(side), size, length), r)

    def chirp_columns(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.fft.fft(columns_of(rows), axis=0)
        return pd.DataFrame([(rows["block"].iloc[0], -1, found.real.ravel(), found.imag.ravel())], columns=names)

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        chirp = rows[rows["place"] < 0].iloc[0]
        mine = rows[rows["place"] >= 0]
        block, (_, lo, hi) = int(rows["block"].iloc[0]), cuts[int(rows["block"].iloc[0])]
        given = np.zeros((side, hi - lo), complex)
        given[mine["place"].to_numpy()] = np.stack(mine["re"].to_numpy()) + 1j * np.stack(mine["im"].to_numpy())
        lines = np.fft.fft(given, axis=0) * (np.asarray(chirp["re"]) + 1j * np.asarray(chirp["im"])).reshape(side, hi - lo)
        back = np.fft.ifft(lines, axis=0) * _twiddle(np.arange(side), np.arange(lo, hi), size, 1)
        out = pd.DataFrame([(b, block, back[a:e].real.ravel(), back[a:e].imag.ravel()) for b, a, e in cuts], columns=names)
        out.insert(0, "signal", rows["signal"].iloc[0])
        return out

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        _, a, e = cuts[int(rows["block"].iloc[0])]
        parts = [(np.asarray(re) + 1j * np.asarray(im)).reshape(e - a, -1) for re, im in zip(rows["re"], rows["im"])]
        found = np.fft.ifft(np.concatenate(parts, 1), axis=1)
        k = np.arange(a, e)[:, None] + side * np.arange(side)[None, :]
        half = k <= length // 2
        order = np.argsort(k[half])
        return finish(rows["signal"].iloc[0], k[half][order], np.abs(found[half])[order])

    rows = long.select(F.col(signal).alias("signal"), F.col(t).cast("bigint").alias("t"), F.col(value).cast("double").alias("value"))
    first = dealt(rows.withColumn("r", F.col("t") % side), length, "signal", "r").groupBy("signal", "r").applyInPandas(classes, f"signal {kind}, {piece}")
    chirp = long.sparkSession.range(side).mapInPandas(chirp_classes, piece).groupBy("block").applyInPandas(chirp_columns, piece)
    every = rows.select("signal").distinct().select("signal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    both = first.unionByName(every.join(chirp, "block").select("signal", *names))
    middle = dealt(both, size, "signal", "block").groupBy("signal", "block").applyInPandas(product, f"signal {kind}, {piece}")
    return dealt(middle, size, "signal", "block").groupBy("signal", "block").applyInPandas(last, schema)
