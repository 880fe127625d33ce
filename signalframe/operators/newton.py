"""Many logistic regressions at once: Newton steps for all of them from one scan per iteration.

Rows carry ``masks``, one value per training set (a fold, a fraction, a resample): whether the row is in it, or how many times; a fit
is a training set, a choice of feature columns and a penalty.  Every scan returns, per task and fit, the loss, the gradient and the weighted Gram matrix at the
fit's current coefficients.  Spark adds them up in two levels, so that no task holds more than a few dozen of them, and the
driver solves one small system per fit.  The number of jobs is that of the slowest fit's steps, whatever the
number of folds, fractions and recipes.

The objective is Spark ML's: weighted mean loss plus half of ``1 / (c * rows)`` times the squared coefficients of
standardised features, intercepts free; two classes have one coefficient vector, more have one each.  Classes are weighted
inversely to their counts in the training set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Parameters of one fit (class vectors times features and intercept) whose Gram matrix is worth moving.
MOST_PARAMETERS = 1024
#: Partial sums that one task adds up at the first level.
FAN_IN = 32
#: Rows whose weighted products are formed at once.
STEP_ROWS = 4096
#: Newton's method has arrived when no entry of the gradient is larger.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Fit:
    """Training set ``mask``, feature ``columns``, inverse penalty ``c``."""

    mask: int
    columns: tuple[int, ...]
    c: float = 1.0


@dataclass(frozen=True)
class Scale:
    """Row count, class weights, and the weighted mean and deviation of all features of a training set."""

    rows: int
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


@dataclass(frozen=True)
class Model:
    """Coefficients on raw features: classes x columns (one row for two classes) and intercepts."""

    columns: tuple[int, ...]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.columns] @ self.coefficients.T + self.intercepts

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = self.scores(x)
        if scores.shape[1] == 1:
            scores = np.concatenate([np.zeros((len(x), 1)), scores], 1)
        p = np.exp(scores - scores.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class codes; the lowest one on ties."""
        scores = self.scores(x)
        return (scores[:, 0] > 0).astype(np.int32) if scores.shape[1] == 1 else scores.argmax(1).astype(np.int32)


def _arrays(batch: pa.RecordBatch, n_masks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(batch)
    x = batch["features"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    masks = batch["masks"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, n_masks)
    return x, batch["y"].to_numpy().astype(np.int64), masks


def _added(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the packed doubles per ``fit``, in two levels."""
    def add(key, table):
        total = None
        for blob in table["sums"].combine_chunks():
            part = np.frombuffer(blob.as_buffer())
            total = part.copy() if total is None else total + part
        return pa.table({"fit": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    level = partials.withColumn("bucket", F.floor(F.col("task") / FAN_IN)).groupBy("fit", "bucket").applyInArrow(add, "fit int, sums binary")
    rows = level.groupBy("fit").applyInArrow(add, "fit int, sums binary").collect()
    return {r["fit"]: np.frombuffer(r["sums"]) for r in rows}


def _partial(rows: list[np.ndarray]) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                                      names=["fit", "task", "sums"])


def class_counts(rows: DataFrame, n_masks: int, classes: int) -> np.ndarray:
    """Rows of every training set and class, copies included."""
    found = rows.select("y", F.posexplode(F.col("masks").cast("array<double>")).alias("mask", "times")).where("times > 0").groupBy("mask", "y").agg(F.sum("times").alias("n")).collect()
    counts = np.zeros((n_masks, classes))
    for r in found:
        counts[r["mask"], r["y"]] = r["n"]
    return counts


def scales(rows: DataFrame, n_masks: int, classes: int, width: int) -> list[Scale]:
    """Class weights and weighted moments of every training set, from three scans."""
    counts = class_counts(rows, n_masks, classes)
    total = counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(counts > 0, total[:, None] / ((counts > 0).sum(1)[:, None] * counts), 0.0)

    def moments(batches: Iterator[pa.RecordBatch], centre: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_masks, 2 + width))
        for batch in batches:
            x, y, masks = _arrays(batch, n_masks)
            for m in range(n_masks):
                at = masks[:, m] > 0
                each, times = weights[m, y[at]], masks[at, m]
                v = x[at] if centre is None else (x[at] - centre[m]) ** 2
                sums[m] += np.concatenate([[(each * times).sum(), (each * each * times).sum()], (each * times) @ v])
        yield _partial(list(sums))

    made = rows.select("features", "y", "masks")
    first = _added(made.mapInArrow(lambda b: moments(b, None), "fit int, task int, sums binary"))
    mean = np.stack([first[m][2:] / max(first[m][0], 1e-300) for m in range(n_masks)])
    second = _added(made.mapInArrow(lambda b: moments(b, mean), "fit int, task int, sums binary"))
    out = []
    for m in range(n_masks):
        w, w2 = second[m][:2]
        free = w - w2 / w if w else 0.0
        out.append(Scale(int(total[m]), weights[m], mean[m], np.sqrt(second[m][2:] / free) if free > 0 else np.zeros(width)))
    return out


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Weight, loss, gradient and Gram matrix (packed) of rows ``x`` with a last column of ones."""
    k, d = theta.shape
    scores = x @ theta.T
    if k == 1:
        scores = np.concatenate([np.zeros((len(x), 1)), scores], 1)
    top = scores.max(1, keepdims=True)
    p = np.exp(scores - top)
    norm = p.sum(1, keepdims=True)
    p /= norm
    loss = (w * (np.log(norm[:, 0]) + top[:, 0] - scores[np.arange(len(x)), y])).sum()
    off = p.copy()
    off[np.arange(len(x)), y] -= 1
    p, off = p[:, -k:], off[:, -k:]
    gram = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            gram[a, :, b] = (x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
            gram[b, :, a] = gram[a, :, b].T
    return np.concatenate([[w.sum(), loss], ((off * w[:, None]).T @ x).ravel(), gram.ravel()])


def _scan(rows: DataFrame, fits: Sequence[Fit], thetas: Sequence[np.ndarray], scaled: Sequence[Scale], open_fits: Sequence[int]) -> dict[int, np.ndarray]:
    """``_sums`` of the open fits over their training sets."""
    n_masks, n_open = len(scaled), list(open_fits)
    chosen = [(fits[i], thetas[i], scaled[fits[i].mask]) for i in n_open]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 + t.size + t.size ** 2) for _, t, _ in chosen]
        for batch in parts:
            all_x, all_y, masks = _arrays(batch, n_masks)
            for i, (fit, theta, s) in enumerate(chosen):
                cols = list(fit.columns)
                inverse = np.where(s.deviation[cols] > 0, 1 / np.where(s.deviation[cols] > 0, s.deviation[cols], 1), 0.0)
                inside = np.flatnonzero(masks[:, fit.mask])
                for a in range(0, len(inside), STEP_ROWS):
                    at = inside[a:a + STEP_ROWS]
                    z = (all_x[np.ix_(at, cols)] - s.mean[cols]) * inverse
                    sums[i] += _sums(np.concatenate([z, np.ones((len(at), 1))], 1), all_y[at], s.weights[all_y[at]] * masks[at, fit.mask], theta)
        yield _partial(sums)

    made = _added(rows.select("features", "y", "masks").mapInArrow(batches, "fit int, task int, sums binary"))
    return {i: made[k] for k, i in enumerate(n_open)}


class _Search:
    """Newton's method for one fit, with halved steps where the objective does not fall."""

    def __init__(self, fit: Fit, scale: Scale, classes: int):
        k = 1 if classes == 2 else classes
        self.theta = np.zeros((k, len(fit.columns) + 1))
        self.penalty = 1.0 / (fit.c * max(scale.rows, 1))
        self.best, self.base, self.step = np.inf, self.theta, None
        self.done = scale.rows == 0

    def advance(self, sums: np.ndarray) -> None:
        k, d = self.theta.shape
        weight, loss = sums[:2]
        coefficients = self.theta.copy()
        coefficients[:, -1] = 0
        value = loss / weight + self.penalty / 2 * (coefficients ** 2).sum()
        if value > self.best + 1e-13 * abs(self.best):
            self.step = self.step / 2
            if np.abs(self.step).max() < 1e-14:
                self.theta, self.done = self.base, True
            else:
                self.theta = self.base + self.step
            return
        gradient = sums[2:2 + k * d].reshape(k, d) / weight + self.penalty * coefficients
        self.best, self.base = value, self.theta
        if np.abs(gradient).max() < TOLERANCE:
            self.done = True
            return
        gram = (sums[2 + k * d:] / weight).reshape(k, d, k, d).copy()
        for a in range(k):
            gram[a, range(d - 1), a, range(d - 1)] += self.penalty
        if k > 1:  # intercepts are only known up to a common shift; their sum stays zero
            gram[:, -1, :, -1] += 1.0
        matrix = gram.reshape(k * d, k * d)
        self.step = -np.linalg.solve(matrix + 1e-14 * np.eye(k * d), gradient.ravel()).reshape(k, d)
        self.theta = self.base + self.step


def fit_all(rows: DataFrame, fits: Sequence[Fit], n_masks: int, classes: int, width: int, iterations: int = 100) -> list[Model]:
    """The models of all ``fits``; ``rows`` has ``features`` (array of ``width``), ``y`` (codes from 0) and ``masks``.

    The table is read once per iteration and three times before, so it should be a written one.  A training set without rows gives a model that
    always says class 0.
    """
    scaled = scales(rows, n_masks, classes, width)
    searches = [_Search(f, scaled[f.mask], classes) for f in fits]
    for _ in range(iterations):
        open_fits = [i for i, s in enumerate(searches) if not s.done]
        if not open_fits:
            break
        for i, sums in _scan(rows, fits, [s.theta for s in searches], scaled, open_fits).items():
            searches[i].advance(sums)
    out = []
    for f, s in zip(fits, searches):
        cols, scale = list(f.columns), scaled[f.mask]
        inverse = np.where(scale.deviation[cols] > 0, 1 / np.where(scale.deviation[cols] > 0, scale.deviation[cols], 1), 0.0)
        raw = s.base[:, :-1] * inverse
        out.append(Model(f.columns, raw, s.base[:, -1] - raw @ scale.mean[cols]))
    return out


def predict_all(rows: DataFrame, models: Sequence[tuple[int, Model | int]]) -> DataFrame:
    """(fit, tag, y, y_pred): ``models`` are (mask, model or a constant class); a row is scored by the models whose mask has a tag in its ``tags``."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n = len(batch)
            if not n:
                continue
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            tags = np.array(batch["tags"].to_pylist(), dtype=object).reshape(n, -1)
            y = batch["y"].to_numpy()
            for i, (mask, model) in enumerate(models):
                at = np.flatnonzero(tags[:, mask] != None)  # noqa: E711
                if len(at):
                    found = model.predict(x[at]) if isinstance(model, Model) else np.full(len(at), model, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(tags[at, mask].tolist(), pa.string()), pa.array(y[at].astype(np.int32)), pa.array(found)],
                                                     names=["fit", "tag", "y", "y_pred"])

    return rows.select("features", "y", "tags").mapInArrow(batches, "fit int, tag string, y int, y_pred int")
