"""Byte-level text helpers shared by the operators of this package; all run inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Translation of A-Z only; every other byte stays, so UTF-8 text stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Translation that lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Text handled at once inside a task; bounds the arrays of a batch, a longer text is handled alone.
CHUNK_BYTES = 2 << 20

_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def batches_of(spark, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows inside the block, for rows that carry whole sets; then as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: a bijection of uint64, different for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=False) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [b or b"" for b in texts.cast(kind).to_pylist()]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices (first row, texts) of about ``limit`` bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def mix_rounds(x: np.ndarray, first: int, rounds: int) -> np.ndarray:
    """``mix`` of x under ``rounds`` consecutive seeds, a row each."""
    seeds = (np.arange(first + 1, first + rounds + 1, dtype=np.uint64) * _GOLDEN)[:, None]
    out = x + seeds
    out ^= out >> np.uint64(30)
    out *= _M1
    out ^= out >> np.uint64(27)
    out *= _M2
    out ^= out >> np.uint64(31)
    return out


class Words:
    """The words of several texts as numbers.

    ``ids[k]`` numbers word k among ``vocabulary``; ``counts`` holds the words of each text, ``starts``
    the first word of each text, ``owner[k]`` the text of word k.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None):
        lists = [(t.translate(table) if table else t).split() for t in texts]
        self.counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = [w for ws in lists for w in ws]
        coded = pa.array(flat, type=pa.binary()).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary: list[bytes] = coded.dictionary.to_pylist()
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.counts)


def hash_words(vocabulary: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, equal on every machine."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values (uint64); has len(values) - n + 1 entries, none if shorter."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = values[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * _GOLDEN + values[k:k + m]
            out ^= out >> np.uint64(29)
    return mix(out)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Boolean mask of the n positions inside [start, start + length) of any span."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values per owner, exact below 2**53."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def row_key(doc_id: str, text: str) -> Column:
    """Names a row by its id and a hash of its text; equal rows share the name."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))
