"""Removal of repeated passages by prefix-free parsing.

A rolling hash of ``TRIGGER`` bytes cuts every text into phrases at places that depend on content alone, so two
copies of a passage are cut alike.  At each cut the next ``SHORT`` bytes are a dictionary entry.  A passage of ``LENGTH``
bytes can only be repeated if every entry inside it is; texts without repeated entries are done after this step.
For the others the parse is compared in corpus order: first the passages that begin or end at a cut or at an
end of the text.  Where what these cover leaves a gap, the dictionary entry behind each start in the gap and its
distance name the other starts in the corpus that could hold the same passage; all of them are compared.  Comparing means sorting 64-bit fingerprints of passages, in partitions of the fingerprint
space; equal fingerprints stand next to each other as equal suffixes do in a suffix array.

Work travels in units of some hundred texts: a unit sends each fingerprint at most twice, so a passage in a third of
all rows costs a partition no more than one in two rows per unit, and the number of partitions grows with the
corpus.  What a fingerprint repeats is judged on the input as it is, over all texts, within one text too.

Null and empty texts and texts shorter than a passage keep all bytes unless nothing is there to keep; repeated rows
repeat each other; rows of one id are told apart by their text; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, discard, work_path
from .text import as_bytes, chunks, covered, mix, row_key
from .url_filter import BROADCAST_BLOCKS, bloom_blocks, bloom_probe

#: Bytes of a passage.
LENGTH = 400
#: Bytes of the rolling hash, of a dictionary entry, and mean bytes between two cuts.
TRIGGER, SHORT, MEAN = 12, 100, 48
#: Bytes of text in a chunk, texts in a unit, and fingerprints in a partition, about.
CHUNK, UNIT_TEXTS, PART_KEYS = 1 << 20, 256, 500_000

_FACTOR = 0x9E3779B97F4A7C15 | 1
_CODES = mix(np.arange(256, dtype=np.uint64), 17)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2**64; kept for the longest text so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + LENGTH)
        made = []
        for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            p = np.full(size, f, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS


class Hashed:
    """Bytes with the fingerprint of any stretch at constant cost."""

    def __init__(self, data: bytes):
        self.size = len(data)
        up, self.down = _powers(self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(_CODES[np.frombuffer(data, np.uint8)] * up[:self.size], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def cuts(self) -> np.ndarray:
        """Places where the rolling hash triggers and an entry fits behind, in a single text or several joined ones."""
        n = self.size - SHORT + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        rolled = mix((self.sums[TRIGGER:TRIGGER + n] - self.sums[:n]) * self.down[:n])
        return np.flatnonzero(rolled % np.uint64(MEAN) == 0)


def entries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all texts in a row, how many each has, and whether a text has a passage without any."""
    joined = Hashed(b"".join(texts))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    cuts = joined.cuts()
    owner = np.searchsorted(ends, cuts, side="right")
    inside = cuts + SHORT <= ends[owner] if len(cuts) else np.zeros(0, bool)
    cuts, owner = cuts[inside], owner[inside]
    counts = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    # A passage from s has no entry if no cut lies in [s, s + LENGTH - SHORT]: look at the gaps between cuts.
    marks = np.concatenate([cuts, ends - (LENGTH - SHORT) + (LENGTH - SHORT + 1)])
    whose = np.concatenate([owner, np.arange(len(texts))])
    order = np.lexsort((marks, whose))
    marks, whose = marks[order], whose[order]
    first = np.concatenate([[True], whose[1:] != whose[:-1]])[:len(whose)]
    before = np.where(first, (ends - sizes)[whose] - 1, np.concatenate([[0], marks[:-1]])[:len(marks)])
    last_start = (ends - LENGTH)[whose]
    bare_from, bare_to = before + 1, np.minimum(marks - (LENGTH - SHORT) - 1, last_start)
    bare = np.bincount(whose, weights=bare_from <= bare_to, minlength=len(texts)) > 0
    return joined.at(cuts, SHORT), counts, bare


def limited(keys: np.ndarray, copies: int = 1) -> np.ndarray:
    """Sorted keys, each once, or twice if it occurs more than once."""
    unique, counts = np.unique(keys, return_counts=True)
    return np.repeat(unique, np.minimum(2, counts * copies))


class Suspect:
    """A text with a repeated entry, or with a passage that has none; ``flags`` tell which entries are repeated."""

    def __init__(self, text: bytes, flags: bytes):
        self.hashed = Hashed(text)
        self.size = len(text)
        self.cuts = self.hashed.cuts()
        self.fresh = np.concatenate([[0], np.cumsum(np.frombuffer(flags, np.uint8) == 0)])

    def allowed(self, starts: np.ndarray) -> np.ndarray:
        """The starts whose passages have repeated entries only."""
        low, high = np.searchsorted(self.cuts, starts), np.searchsorted(self.cuts, starts + (LENGTH - SHORT), side="right")
        return starts[self.fresh[low] == self.fresh[high]]

    def anchors(self) -> np.ndarray:
        starts = np.unique(np.concatenate([self.cuts, self.cuts - LENGTH, [0, self.size - LENGTH]]))
        return self.allowed(starts[(starts >= 0) & (starts <= self.size - LENGTH)])

    def keys(self, starts: np.ndarray) -> np.ndarray:
        return self.hashed.at(starts, LENGTH)

    def repeated(self, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The starts whose passages are among the sorted keys ``known``."""
        return starts[_among(self.keys(starts), known)]

    def wants(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For allowed starts of passages that the found ones do not cover: the first entry behind and the distance to it."""
        if self.size < LENGTH:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        bare = np.concatenate([[0], np.cumsum(~covered(self.size, found, LENGTH))])
        starts = self.allowed(np.flatnonzero(bare[LENGTH:] > bare[:self.size - LENGTH + 1]))
        cut, has = self._next(starts)
        return self.hashed.at(self.cuts[cut[has]], SHORT), self.cuts[cut[has]] - starts[has]

    def _next(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first cut at or behind each start, and whether its entry lies in the passage."""
        cut = np.searchsorted(self.cuts, starts)
        if not len(self.cuts):
            return cut, np.zeros(len(starts), bool)
        return cut, (cut < len(self.cuts)) & (self.cuts[np.minimum(cut, len(self.cuts) - 1)] <= starts + (LENGTH - SHORT))

    def asked(self, entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Allowed starts at the distances asked for before an entry (sorted), and all starts without an entry."""
        if self.size < LENGTH:
            return np.zeros(0, np.int64)
        every = np.arange(self.size - LENGTH + 1)
        out = [every[~self._next(every)[1]]]
        if len(entries) and len(self.cuts):
            keys = self.hashed.at(self.cuts, SHORT)
            place = np.minimum(np.searchsorted(entries, keys), len(entries) - 1)
            hit = np.flatnonzero(entries[place] == keys)
            before = np.concatenate([[-1], self.cuts[:-1]])
            first = np.maximum(np.maximum(self.cuts[hit] - high[place[hit]], before[hit] + 1), 0)
            last = np.minimum(self.cuts[hit] - low[place[hit]], self.size - LENGTH)
            n = np.maximum(last - first + 1, 0)
            out.append(np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum()))
        return self.allowed(np.concatenate(out))

    def has(self) -> np.ndarray:
        """All repeated entries of the text."""
        return self.hashed.at(self.cuts[np.diff(self.fresh) == 0], SHORT)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _array(blobs) -> np.ndarray:
    """Sorted keys from binary values."""
    return np.sort(np.frombuffer(b"".join(blobs or ()), np.uint64))


def _parted(fn, dtype: np.dtype, field: str | None, parts: int):
    """UDF: what ``fn`` gives (binary, sorted by the key in ``field``), cut by ranges of the key into (part, data)."""
    kind = T.ArrayType(T.StructType([T.StructField("part", T.LongType()), T.StructField("data", T.BinaryType())]))

    def split(*columns: pa.Array) -> pa.Array:
        rows = []
        for blob in fn(*columns).to_pylist():
            data = np.frombuffer(blob, dtype)
            keys = data[field] if field else data
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]]) if len(keys) else [0]
            rows.append([{"part": int(part[a]), "data": data[a:b].tobytes()} for a, b in zip(edges[:-1], edges[1:])])
        return pa.array(rows, type=pa.list_(pa.struct([("part", pa.int64()), ("data", pa.binary())])))

    return F.arrow_udf(split, kind, F.ArrowUDFType.SCALAR)


def repeated_keys(units: DataFrame, columns: list[str], fn, parts: int) -> DataFrame:
    """``unit`` and ``known``: of the keys (sorted uint64, at most two of each) that ``fn`` makes of a unit, those that occur twice anywhere."""
    def compare(table: pa.Table) -> pa.Table:
        unit = table["unit"].to_numpy()
        blobs = table["data"].to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.uint64)
        row = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b) // 8 for b in blobs])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        twice = np.zeros(len(ranked), bool)
        same = ranked[1:] == ranked[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.sort(order[twice])  # back in the order of rows, sorted within each
        out, whose = keys[hit], row[hit]
        fresh = np.concatenate([[True], (out[1:] != out[:-1]) | (whose[1:] != whose[:-1])])[:len(out)]
        out, whose = out[fresh], whose[fresh]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(whose)) + 1, [len(out)]]) if len(out) else np.zeros(1, np.int64)
        return pa.table({"unit": pa.array(unit[whose[edges[:-1]]], pa.int64()),
                         "keys": pa.array([out[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})

    sent = units.select("unit", F.explode(_parted(fn, np.dtype(np.uint64), None, parts)(*columns)).alias("p")).select("unit", "p.*")
    found = sent.groupBy("part").applyInArrow(compare, "unit long, keys binary")
    return found.groupBy("unit").agg(F.collect_list("keys").alias("known"))


#: What a unit asks about an entry, and what it is told: entry, least and greatest distance; nothing asked: 0 and -1.
_ASK = np.dtype([("entry", np.uint64), ("low", np.int32), ("high", np.int32)])


def _asks(entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One record per entry, in order, with the widest range asked."""
    order = np.argsort(entries, kind="stable")
    entries, low, high = entries[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]])[:len(entries)])
    out = np.zeros(len(first), _ASK)
    if len(first):
        out["entry"] = entries[first]
        asked = high >= low
        # an entry that nobody asks about keeps an empty range
        out["low"] = np.minimum.reduceat(np.where(asked, low, LENGTH), first)
        out["high"] = np.maximum.reduceat(np.where(asked, high, -1), first)
    return out


def shared_asks(units: DataFrame, columns: list[str], fn, parts: int) -> DataFrame:
    """``unit`` and ``told``: what any unit asks about the entries that a unit has; ``fn`` makes the asks of a unit."""
    def answer(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, _ASK) for b in table["data"].to_pylist()]
        every = np.concatenate(blobs)
        told = _asks(every["entry"], every["low"], every["high"])
        told = told[told["high"] >= told["low"]]
        answers = [told[_among(told["entry"], b["entry"])].tobytes() for b in blobs]
        return pa.table({"unit": table["unit"].cast(pa.int64()), "told": pa.array(answers, pa.binary())})

    sent = units.select("unit", F.explode(_parted(fn, _ASK, "entry", parts)(*columns)).alias("p")).select("unit", "p.*")
    found = sent.groupBy("part").applyInArrow(answer, "unit long, told binary").where(F.octet_length("told") > 0)
    return found.groupBy("unit").agg(F.collect_list("told").alias("told"))


def _told(blobs) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(blobs or ()), _ASK), order="entry")


_PARSED = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())),
                        T.StructField("bare", T.ArrayType(T.BooleanType())), T.StructField("entries", T.BinaryType())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in chunks(batch["text"], CHUNK):
            keys, counts, bare = entries(as_bytes(part))
            yield pa.RecordBatch.from_arrays([
                pa.array([batch["row"].slice(first, len(part)).to_pylist()], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())),
                pa.array([bare.tolist()], pa.list_(pa.bool_())), pa.array([keys.tobytes()], pa.binary())], names=_PARSED.names)


def _limited(blobs: pa.Array) -> pa.Array:
    return pa.array([limited(np.frombuffer(b, np.uint64)).tobytes() for b in blobs.to_pylist()], type=pa.binary())


def _as_is(blobs: pa.Array) -> pa.Array:
    return blobs


def _flagged(counts: Column, bare: Column, keys: Column, rows: Column, known: Column) -> Column:
    """Row and flags of the suspects of a chunk."""
    kind = T.ArrayType(T.StructType([T.StructField("row", T.StringType()), T.StructField("flags", T.BinaryType())]))

    def flag(counts: pa.Array, bare: pa.Array, keys: pa.Array, rows: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for n, b, k, names, found in zip(*(x.to_pylist() for x in (counts, bare, keys, rows, known))):
            flags = _among(np.frombuffer(k, np.uint64), _array(found)).astype(np.uint8)
            ends = np.cumsum(n)
            out.append([{"row": name, "flags": f.tobytes()} for name, f, bare_one in zip(names, np.split(flags, ends[:-1]), b) if bare_one or f.any()])
        return pa.array(out, type=pa.list_(pa.struct([("row", pa.string()), ("flags", pa.binary())])))

    return F.arrow_udf(flag, kind, F.ArrowUDFType.SCALAR)(counts, bare, keys, rows, known)


_REMOVED = T.ArrayType(T.StructType([
    T.StructField("row", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("n_kept", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]))
_REMOVED_ARROW = pa.list_(pa.struct([("row", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                     ("n_kept", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))


def _suspects(texts: list[dict], flags: list[dict]) -> Iterator[tuple[dict, bytes, Suspect]]:
    """The suspects of a unit, one at a time; texts that the filter let in for nothing are passed over."""
    bodies = {t["row"]: t["text"] for t in texts}
    for f in flags:
        data = bodies[f["row"]].encode()
        yield f, data, Suspect(data, f["flags"])


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    for i in range(len(columns[0])):
        yield tuple(c[i].as_py() for c in columns)


def _anchor_keys(texts: pa.Array, flags: pa.Array) -> pa.Array:
    return pa.array([limited(np.concatenate([np.repeat(s.keys(s.anchors()), min(2, f["copies"])) for f, _, s in _suspects(*unit)])).tobytes()
                     for unit in _rows(texts, flags)], type=pa.binary())


def _unit_asks(texts: pa.Array, flags: pa.Array, known: pa.Array) -> pa.Array:
    """All repeated entries of a unit, with the distances that its gaps ask about."""
    out = []
    for *unit, blobs in _rows(texts, flags, known):
        found, entries_, low, high = _array(blobs), [], [], []
        for _, _, s in _suspects(*unit):
            asked, distance = s.wants(s.repeated(s.anchors(), found))
            had = s.has()
            entries_ += [asked, had]
            low += [distance, np.zeros(len(had), np.int64)]
            high += [distance, np.full(len(had), -1)]
        out.append(_asks(*map(np.concatenate, (entries_, low, high))).tobytes())
    return pa.array(out, type=pa.binary())


def _asked_keys(texts: pa.Array, flags: pa.Array, told: pa.Array) -> pa.Array:
    out = []
    for *unit, blobs in _rows(texts, flags, told):
        t = _told(blobs)
        out.append(limited(np.concatenate([np.repeat(s.keys(s.asked(t["entry"], t["low"], t["high"])), min(2, f["copies"])) for f, _, s in _suspects(*unit)])).tobytes())
    return pa.array(out, type=pa.binary())


def _spans(with_text: bool):
    def spans(texts: pa.Array, flags: pa.Array, known: pa.Array, told: pa.Array, more: pa.Array) -> pa.Array:
        out = []
        for body, marks, *blobs in _rows(texts, flags, known, told, more):
            found, t, rest, rows = _array(blobs[0]), _told(blobs[1]), _array(blobs[2]), []
            for f, data, s in _suspects(body, marks):
                starts = np.concatenate([s.repeated(s.anchors(), found), s.repeated(s.asked(t["entry"], t["low"], t["high"]), rest)])
                if len(starts):
                    mask = covered(s.size, starts, LENGTH)
                    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                    kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                    rows.append({"row": f["row"], "n_kept": len(kept), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None,
                                 "spans": [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]})
            out.append(rows)
        return pa.array(out, type=_REMOVED_ARROW)

    return spans


def _udf(fn, kind=T.BinaryType()):
    return F.arrow_udf(fn, kind, F.ArrowUDFType.SCALAR)


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``row`` (see ``row_key``), ``spans`` (removed bytes, maximal), ``n_kept`` and ``kept_sha256`` of each text that loses any.

    ``kept`` holds the other bytes if ``with_text``.  Equal rows are one row here.  The suspects' texts are written
    once, bucketed by unit, so that they are shuffled once and every later join moves fingerprints alone.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text")).where(F.octet_length("text") >= LENGTH)
    parsed = cut_lineage(rows.mapInArrow(_parsed, _PARSED).withColumn("unit", F.monotonically_increasing_id()))
    n_entries = parsed.agg(F.sum(F.octet_length("entries"))).first()[0] or 0
    parts = 1 + n_entries // 8 // PART_KEYS
    known = repeated_keys(parsed.select("unit", "entries"), ["entries"], _limited, parts)
    joined = parsed.join(known, "unit", "left")
    flagged = joined.select(F.explode(_flagged(*map(F.col, ("counts", "bare", "entries", "texts", "known")))).alias("f")).select("f.*")
    flagged = cut_lineage(flagged.groupBy("row").agg(F.first("flags").alias("flags"), F.count("*").alias("copies")))

    n = flagged.count()
    blocks = min(BROADCAST_BLOCKS, max(1, n // 16))
    bloom = F.broadcast(bloom_blocks(flagged, "row", blocks))
    unit = F.pmod(F.xxhash64("row"), F.lit(max(1, n // UNIT_TEXTS))).alias("unit")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = bloom_probe(rows, "row", bloom, blocks).where("possible").select(unit, "row", "text")
    # Equal rows meet here and all but one go, so that a unit never holds the copies of a row.
    texts = texts.repartition(buckets, "unit").dropDuplicates(["unit", "row"]).groupBy("unit").agg(F.collect_list(F.struct("row", "text")).alias("texts"))
    flags = flagged.select(unit, "*").groupBy("unit").agg(F.collect_list(F.struct("row", "flags", "copies")).alias("flags"))
    name = f"repeats_units_{uuid.uuid4().hex}"
    # Below the shared folder: the warehouse folder may be one machine's.
    texts.join(flags, "unit").write.option("path", work_path(spark, "cut")).bucketBy(buckets, "unit").saveAsTable(name)
    stored = units = spark.table(name)
    try:
        at_anchors = cut_lineage(repeated_keys(units, ["texts", "flags"], _anchor_keys, parts))
        units = units.join(at_anchors, "unit", "left")
        told = cut_lineage(shared_asks(units, ["texts", "flags", "known"], _unit_asks, parts))
        units = units.join(told, "unit", "left")
        asked = cut_lineage(units.select("unit", _udf(_asked_keys)("texts", "flags", "told").alias("keys")))
        n_asked = (asked.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
        more = repeated_keys(asked, ["keys"], _as_is, 1 + n_asked // PART_KEYS).withColumnRenamed("known", "more")
        done = units.join(more, "unit", "left").select(F.explode(_udf(_spans(with_text), _REMOVED)("texts", "flags", "known", "told", "more")).alias("r"))
        return cut_lineage(done.select("r.*"))
    finally:
        discard(stored)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
