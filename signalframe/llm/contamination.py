"""Benchmark decontamination: an FM-index per shard of the training text.

Test items are cut into windows of ``WINDOW`` words.  A shard is a run of documents inside a task.  Its words
become numbers of the test vocabulary; a word that no test item has can never be in a match, so it only
separates runs, and runs shorter than the shortest window are left out.  The rest of the shard is indexed:
suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks, sampled positions.  All windows are
searched backwards at once; the rows found are walked back to a sampled position; their words are merged to
removal spans.

Test items are broadcast in blocks of at most ``BLOCK_WORDS`` words; more words mean more passes over the
shards, never fewer items.  Null and empty texts have no words and no hits; an item without words has no
window; repeated items and documents are judged like single ones; empty tables on either side are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, as_bytes, chunks, covered

WINDOW = 13
#: Words of test items in one broadcast block; 20 bytes each at most besides the vocabulary.
BLOCK_WORDS = 1_000_000
#: Bytes of text whose words make a shard.
SHARD_BYTES = 12 << 20
#: Every such position of the indexed text is sampled, and each start of a run.
SAMPLE = 16

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]


def split_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other code points from 128 on, A-Z lower-cased."""
    return text.translate(ALNUM).split()


class Phrases:
    """The windows of some test items: one matrix of word numbers per window length, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[i:i + window]), set()).add(name)
        self.groups = []
        for length in sorted({len(k) for k in found}):
            keys = [k for k in found if len(k) == length]
            self.groups.append((length, np.array(keys, dtype=np.int64), [found[k] for k in keys]))
        self.shortest = min((g[0] for g in self.groups), default=0)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    fresh = np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    step = 1
    while True:
        tied = ~fresh | np.append(~fresh[1:], False)
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        suffixes = order[rows]
        after = np.where(suffixes + step < n, rank[np.minimum(suffixes + step, n - 1)] + 1, 0)
        key = first[rows] * (n + 1) + after
        again = np.argsort(key, kind="stable")
        order[rows] = suffixes[again]
        key = key[again]
        fresh[rows] = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = first
        step *= 2


class FMIndex:
    """Index of a text of positive symbols in which zeros separate runs; the text ends with a zero."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        breaks = text == 0
        ranks = text + np.count_nonzero(breaks)
        ranks[breaks] = np.arange(np.count_nonzero(breaks))  # each separator differs, so no suffix compares beyond its run
        order = suffix_array(ranks)
        self.size = n
        bwt = text[order - 1]  # before the first position stands the last symbol, a zero
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = max(1, int(text.max()).bit_length())
        self.zeros, self.ones = [], []
        column = bwt
        for level in reversed(range(self.levels)):
            bit = (column >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.before = bwt
        sampled = (order % sample == 0) | (bwt == 0)
        self.sampled, self.known = sampled, order[sampled]
        self.index = np.cumsum(sampled) - 1

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``place`` of the transform."""
        begin, end = np.zeros_like(place), place
        for depth, level in enumerate(reversed(range(self.levels))):
            ones, bit = self.ones[depth], ((symbol >> level) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin = np.where(bit, self.zeros[depth] + b, begin - b)
            end = np.where(bit, self.zeros[depth] + e, end - e)
        return end - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row after the last of each pattern (a row of the matrix); equal where there is none."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        top = len(self.starts) - 1
        for k in reversed(range(patterns.shape[1])):
            live = np.flatnonzero(low < high)
            symbol = patterns[live, k]
            absent = symbol >= top
            low[live[absent]] = high[live[absent]] = 0
            live, symbol = live[~absent], symbol[~absent]
            if not len(live):
                break
            low[live] = self.starts[symbol] + self.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text until a sampled position."""
        out, steps, rows = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            there = self.sampled[rows[live]]
            done = live[there]
            out[done] = self.known[self.index[rows[done]]] + steps[done]
            live = live[~there]
            symbol = self.before[rows[live]]
            rows[live] = self.starts[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
        return out


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list, list]:
    """Words, merged spans and sorted item names of every text."""
    get = phrases.vocabulary.get
    ids = [np.fromiter((get(w, 0) for w in split_words(t)), dtype=np.int64) for t in texts]
    counts = np.array([len(x) for x in ids], dtype=np.int64)
    spans: list = [[] for _ in texts]
    names: list = [[] for _ in texts]
    if not phrases.groups or not counts.sum():
        return counts, spans, names
    # One zero after each text keeps runs inside their text.
    flat = np.concatenate([y for x in ids for y in (x, np.zeros(1, np.int64))])
    first = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
    known = np.concatenate([[0], (flat > 0).astype(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return counts, spans, names
    lengths = end - begin + 1  # with the separator behind the run; ``flat`` has a zero there
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    index = FMIndex(flat[place])
    starts, sizes, owners = [], [], []
    for length, windows, items in phrases.groups:
        low, high = index.search(windows)
        found = np.flatnonzero(high > low)
        n = (high - low)[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low[:0], n) + np.arange(n.sum())
        at = place[index.locate(rows)]
        starts.append(at)
        sizes.append(np.full(len(at), length))
        text_of = np.searchsorted(first, at, side="right") - 1
        for doc, window in np.unique(np.stack([text_of, np.repeat(found, n)], 1), axis=0).tolist():
            owners.append((doc, items[window]))
    at = np.concatenate(starts)
    if not len(at):
        return counts, spans, names
    mask = covered(len(flat), at, np.concatenate(sizes))
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for doc, a, b in zip((np.searchsorted(first, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist()):
        spans[doc].append({"start": int(a - first[doc]), "end": int(b - first[doc])})
    together: dict[int, set] = {}
    for doc, some in owners:
        together.setdefault(doc, set()).update(some)
    for doc, some in together.items():
        names[doc] = sorted((x for x in some if x is not None)) + [None] * (None in some)
    return counts, spans, names


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, words = [], 0
    for name, body in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        split = split_words((body or "").encode())
        if block and words + len(split) > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((name, split))
        words += len(split)
    yield block


def _searched(text: Column, phrases) -> Column:
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            counts, spans, names = [], [], []
            for _, part in chunks(texts, SHARD_BYTES):
                c, s, n = search_shard(as_bytes(part), phrases.value)
                counts += c.tolist()
                spans += s
                names += n
            yield pa.StructArray.from_arrays([pa.array(x, type=t) for x, t in zip((counts, spans, names), _ARROW)], names=SCHEMA.names)

    return F.arrow_udf(batches, SCHEMA, F.ArrowUDFType.SCALAR_ITER)(text)


def with_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, name: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words``, ``n_hit``, merged ``spans`` of hit words, sorted distinct ``items``.

    A null item id is kept as a null at the end of ``items``.
    """
    sc = docs.sparkSession.sparkContext
    reports = [_searched(F.col(text), sc.broadcast(Phrases(b, window))) for b in _blocks(items, item_id, item_text)]
    held = [f"{name} {i}" for i in range(len(reports))]
    out = docs.select(F.struct("*").alias("row"), *(r.alias(h) for r, h in zip(reports, held)))
    spans, found = F.col(f"`{held[0]}`.spans"), F.col(f"`{held[0]}`.items")
    if len(held) > 1:
        spans = _merged(F.flatten(F.array(*(F.col(f"`{h}`.spans") for h in held))))
        found = F.sort_array(F.array_distinct(F.flatten(F.array(*(F.col(f"`{h}`.items") for h in held)))))
    out = out.select("row", F.col(f"`{held[0]}`.n_words").alias("n_words"), spans.alias("spans"), found.alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != name]
    return out.select(*kept, F.struct("n_words", hit.alias("n_hit"), "spans", "items").alias(name))


def _merged(spans: Column) -> Column:
    """Union of overlapping and touching spans of several blocks."""

    def merge(lists: pa.Array) -> pa.Array:
        rows = []
        for row in lists.to_pylist():
            out: list[dict] = []
            for s in sorted(row, key=lambda s: s["start"]):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            rows.append(out)
        return pa.array(rows, type=_ARROW[1])

    return F.arrow_udf(merge, SCHEMA["spans"].dataType, F.ArrowUDFType.SCALAR)(spans)


def is_contaminated(report: Column) -> Column:
    """The rule: some words are hit, and they are at least a twentieth of the text."""
    return (report["n_hit"] > 0) & (20 * report["n_hit"] >= report["n_words"])
