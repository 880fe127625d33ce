"""Centroid clustering of vectors behind zone maps along a Hilbert curve.

Vectors become whole numbers, so that distances, sums and ties are exact.  They are range-partitioned and sorted by
their place on a Hilbert curve over all dimensions and written once, in blocks of ``BLOCK`` neighbours with a box: the
least and greatest value of each dimension, and the block's sum.  In every round a block first meets the boxes' bounds:
over a box, the difference of the squared distances to two centroids is linear, so its greatest value is known
from the corners.  A centroid that is farther than another one over the whole box is no candidate.  A block with one
candidate adds its sum as it is; the others compare their vectors with the candidates exactly.  Partial sums per
task are added up by Spark; only the centroids, k rows, come to the driver and go out with the next round.

The curve's key is followed by a hash of the id, so a vector that very many rows share is dealt over many tasks.

Vectors with another number of components, or with null or non-finite ones, are left out.  Null ids are kept and never
start a centroid.  Repeated rows count each time.  With fewer vectors than centroids there are as many centroids as vectors; without
vectors the result is empty.  A component beyond +-2**27 after scaling is an error, as exact distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Vectors of a block, and bits of each dimension on the curve.
BLOCK, BITS = 128, 4
#: Largest component after scaling, and the largest for which doubles hold all distances exactly.
LARGEST, EXACT = 1 << 27, 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of every row of ``cells`` (n x d, values below 2**bits) on the Hilbert curve, as bytes in curve order."""
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            high = (x[i] & bit) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(level) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([x >> np.uint32(level) & np.uint32(1) for level in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Blocks x centroids: may the centroid be the nearest one of any vector in the box?  Ties stay in."""
    middle = lo + hi  # twice the centre
    guess = ((middle[:, None, :] - 2 * centroids) ** 2).sum(2).argmin(1)
    base = centroids[guess]
    norms = (centroids ** 2).sum(1)
    out = np.ones((len(lo), len(centroids)), bool)
    for k, other in enumerate(centroids):
        step = base - other
        # greatest value over the box of |x - base|**2 - |x - other|**2
        most = norms[guess] - norms[k] - 2 * np.where(step > 0, lo * step, hi * step).sum(1)
        out[:, k] = most >= 0
    return out


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the centroids ``among`` (ascending), and the squared distance, of every row; exact."""
    c = centroids[among]
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(float), c.astype(float)
        d = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    best = d.argmin(1)
    return among[best], d[np.arange(len(x)), best]


@dataclass(frozen=True)
class Vectors:
    """Where the vectors are and what they become: ``width`` components, floor(scale * x) each."""

    vec_id: str = "vec_id"
    vector: str = "embedding"
    width: int = 64
    scale: int = 1024

    def valid(self) -> Column:
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.coalesce((F.size(self.vector) == self.width) & ~F.exists(F.col(self.vector).cast("array<double>"), bad), F.lit(False))

    def whole(self, flat: np.ndarray) -> np.ndarray:
        out = np.floor(flat.astype(np.float64) * self.scale).reshape(-1, self.width)
        if len(out) and np.abs(out).max() > LARGEST:
            raise ValueError(f"a component is beyond +-{LARGEST} after scaling")
        return out.astype(np.int64)


def _matrix(column: pa.Array, v: Vectors) -> np.ndarray:
    return v.whole(column.flatten().to_numpy(zero_copy_only=False))


def _bounds(rows: DataFrame, v: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each dimension."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = _matrix(batch["x"], v)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.width)), pa.array(x.min(0)), pa.array(x.max(0))], names=["i", "lo", "hi"])

    found = rows.select("x").mapInArrow(batches, "i long, lo long, hi long").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    return np.array([r["lo"] for r in found], np.int64), np.array([r["hi"] for r in found], np.int64)


def _blocks(rows: DataFrame, v: Vectors, id_type) -> DataFrame:
    """The blocks: ``ids``, ``x`` (32-bit whole numbers, a row each), box ``lo`` and ``hi`` and ``total``, as packed arrays."""
    lo, hi = _bounds(rows, v)
    span = np.maximum(hi - lo + 1, 1)

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = _matrix(batch["x"], v)
            keys = hilbert_keys(((x - lo) << BITS) // span)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())], names=["id", "key", "x"])

    def packed(ids: pa.Array, blobs: list[bytes]) -> tuple:
        x = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, v.width)
        return ids.to_pylist(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), x.sum(0, dtype=np.int64).tobytes()

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        kinds = [pa.list_(id_arrow), *[pa.binary()] * 4]

        def cut(rows: pa.Table, last: bool) -> tuple[list, pa.Table]:
            out = []
            while rows.num_rows >= BLOCK or last and rows.num_rows:
                part, rows = rows.slice(0, BLOCK).combine_chunks(), rows.slice(BLOCK)
                out.append(packed(part["id"], part["x"].to_pylist()))
            return out, rows

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["ids", "x", "lo", "hi", "total"])

        for batch in parts:
            waiting.append(batch)
            if sum(map(len, waiting)) >= 16 * BLOCK:
                out, rest = cut(pa.Table.from_batches(waiting), False)
                waiting = rest.to_batches()
                yield batch_of(out)
        if waiting:
            out, _ = cut(pa.Table.from_batches(waiting), True)
            if out:
                yield batch_of(out)

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    name = id_type.simpleString()
    made = rows.mapInArrow(keyed, f"id {name}, key binary, x binary")
    # The hash after the key deals out a vector that many rows share.
    dealt = made.repartitionByRange("key", F.xxhash64("id")).sortWithinPartitions("key", F.xxhash64("id")).select("id", "x")
    return cut_lineage(dealt.mapInArrow(blocks, f"ids array<{name}>, x binary, lo binary, hi binary, total binary"))


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(batch[c].to_pylist()), np.int32).reshape(-1, width).astype(np.int64) for c in ("lo", "hi"))


def _sums(blocks: DataFrame, centroids: np.ndarray, distances: bool) -> list:
    """(cluster, i, value) of the vectors' assignment: component sums i >= 0, counts at -1, and summed distances at -2 if wanted."""
    k, width = centroids.shape

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, far = np.zeros((k, width), np.int64), np.zeros(k, np.int64), [0] * k
        for batch in parts:
            lo, hi = _unpacked(batch, width)
            open_to = candidates(lo, hi, centroids)
            for j, blob in enumerate(batch["x"]):
                among = np.flatnonzero(open_to[j])
                if len(among) == 1 and not distances:
                    sums[among[0]] += np.frombuffer(batch["total"][j].as_buffer(), np.int64)
                    counts[among[0]] += len(blob.as_buffer()) // (4 * width)
                    continue
                x = np.frombuffer(blob.as_buffer(), np.int32).reshape(-1, width).astype(np.int64)
                best, d = nearest(x, centroids, among)
                for c in np.unique(best).tolist():
                    mine = best == c
                    sums[c] += x[mine].sum(0)
                    counts[c] += int(mine.sum())
                    if distances:
                        far[c] += int(d[mine].astype(object).sum())
        rows = [(c, i, v) for c in range(k) if counts[c] for i, v in [*enumerate(sums[c].tolist()), (-1, int(counts[c])), (-2, far[c])]]
        for a in range(0, len(rows), 4096):
            part = list(zip(*rows[a:a + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array([str(v) for v in part[2]])], names=["cluster", "i", "value"])

    made = blocks.select("x", "lo", "hi", "total").mapInArrow(batches, "cluster int, i int, value string")
    return made.groupBy("cluster", "i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()


def _moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Componentwise floor of the mean; an empty centroid stays."""
    totals = {(r["cluster"], r["i"]): int(r["value"]) for r in sums}
    return np.array([[totals[k, i] // totals[k, -1] for i in range(len(c))] if (k, -1) in totals else c.tolist() for k, c in enumerate(centroids)], np.int64)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 1024) -> DataFrame:
    """Per kept vector: its id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (the final one of its cluster).

    Centroids start as the k vectors of smallest sha256 of ``seed:id``, ties by the vector.  Each round assigns every
    vector to the nearest centroid, ties to the smaller number, and moves each non-empty centroid to the floor of its mean.
    """
    v = Vectors(vec_id, vector, width, scale)
    id_type = df.schema[vec_id].dataType
    rows = df.where(v.valid()).select(F.col(vec_id).alias("id"), F.col(vector).alias("x"))
    start = rows.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "x").limit(k).collect()
    result = f"id {id_type.simpleString()}, cluster int, distance long"
    if start:
        centroids = np.concatenate([v.whole(np.array(r["x"], np.float64)) for r in start])
        blocks = _blocks(rows, v, id_type)
        for _ in range(rounds):
            centroids = _moved(centroids, _sums(blocks, centroids, False))
        inertia = {r["cluster"]: int(r["value"]) for r in _sums(blocks, centroids, True) if r["i"] == -2}
    else:
        centroids, inertia = np.zeros((0, width), np.int64), {}
        blocks = None

    def assigned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            open_to = candidates(*_unpacked(batch, width), centroids)
            for j, blob in enumerate(batch["x"]):
                x = np.frombuffer(blob.as_buffer(), np.int32).reshape(-1, width).astype(np.int64)
                best, d = nearest(x, centroids, np.flatnonzero(open_to[j]))
                yield pa.RecordBatch.from_arrays([batch["ids"][j].values, pa.array(best.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    if blocks is None:
        out = df.sparkSession.createDataFrame([], result)
    else:
        out = blocks.select("ids", "x", "lo", "hi").mapInArrow(assigned, result)
    # k values each
    per = F.array(*(F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids)))) if len(centroids) else F.array().cast("array<bigint>")
    where = F.array(*(F.array(*(F.lit(int(x)).cast("long") for x in c)) for c in centroids)) if len(centroids) else F.array().cast("array<array<bigint>>")
    return out.select(F.col("id").alias(vec_id), "cluster", "distance", F.get(per, F.col("cluster")).alias("cluster_inertia"),
                      F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(where, F.col("cluster")).alias("centroid"))


def centroid_digest(centroid: Column) -> Column:
    """sha256 of the components as decimal numbers, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
