"""Language-model scores: cross-entropy difference between a target and a background model.

Both models are smoothed word bigrams over one vocabulary and one set of bigrams, so their losses can be
compared token by token.  The background is all documents; the target those marked as such.  Every word is in the
vocabulary and every bigram is kept, at every size of the corpus, so the counts grow with it.  They are never
broadcast or sent to the driver.

Most bigrams are rare, so what moves is made small.  The corpus is written once in chunks of about ``CHUNK_BYTES`` of text,
compressed.  A chunk sends each part of the key range one row: the sorted hashes of its bigrams and of its words there, as
differences, with their counts.  A part adds up equal keys and answers every chunk with the totals in the order of the
chunk's keys; the keys need not travel back.  A chunk then knows the counts of all its bigrams and words, and adds up the
loss differences per document.  A bigram that every document has is one entry per chunk, so no key is hot, and documents
are in none of these exchanges but as compressed chunks.  Words and bigrams are compared by 64-bit hashes.

A token's loss difference is kept in millionths of a bit as an integer: sums do not depend on their order.  The
score is the mean difference, target loss minus background loss: the lower, the closer to the target.

Null and empty texts have no tokens and a null score; a null id is no target; repeated rows count again and get
equal scores; an empty table gives an empty table, and without any target the target model is flat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, work_path
from .text import ALNUM, Words, as_bytes, batches_of, hash_words, mix, row_key, sums

#: Text of a chunk, and its documents at most.
CHUNK_BYTES, CHUNK_ROWS = 6 << 20, 1 << 16
#: Text of the corpus per part of the key range; a part counts the keys of so much text in one task.
PART_BYTES = 8 << 20
#: Weight of the word model in the bigram model, in observations.
PRIOR = 200.0
#: Integer units per bit.
UNIT = 1e6
#: Rows of an Arrow batch; a row holds a compressed chunk.
BATCH_ROWS = 16

_OWN = "chunk long, rows array<string>, ids array<string>, sizes array<int>, n_bytes long, body binary"
_SENT = "chunk long, part long, pairs binary, words binary"
_TOLD = _SENT + ", size long, total long, goal long"


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length, byte by byte of rising weight, compressed."""
    raw = np.stack(columns).astype(np.int64).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _chunked(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts, their row names and ids as rows of about ``limit`` bytes; case and punctuation are gone."""
    schema = pa.schema([("chunk", pa.int64()), ("rows", pa.list_(pa.string())), ("ids", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("n_bytes", pa.int64()), ("body", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        rows: list[str] = []
        ids: list[str | None] = []
        size = number = 0

        def chunk() -> pa.RecordBatch:
            body = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            values = [first + number, rows, ids, [len(t) for t in texts], size, body]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for text, row, name in zip(as_bytes(batch["text"]), batch["row"].to_pylist(), batch["id"].to_pylist()):
                if texts and (size + len(text) > limit or len(texts) == CHUNK_ROWS):
                    yield chunk()
                    number, texts, rows, ids, size = number + 1, [], [], [], 0
                texts.append(text.translate(ALNUM))
                rows.append(row)
                ids.append(name)
                size += len(text)
        if texts:
            yield chunk()

    return cut


class _Bigrams:
    """Words and bigrams of a chunk, each in the order of their hashes.

    ``word_of`` and ``pair_of`` tell the word of each token and the bigram of each token in ``later``, those that are not
    the first of their text; ``before`` and ``after`` are the two words of a bigram.
    """

    def __init__(self, body: bytes, sizes: list[int]):
        whole = pa.decompress(body, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b""
        ends = np.cumsum([0, *sizes]).tolist()
        words = Words([whole[a:b] for a, b in zip(ends, ends[1:])])
        self.counts, self.owner = words.counts, words.owner
        hashes = hash_words(words.vocabulary)
        order = np.argsort(hashes, kind="stable")
        self.word_keys = hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.word_of = rank[words.ids]
        first = np.zeros(len(self.word_of), bool)
        first[words.starts[words.counts > 0]] = True
        self.later = np.flatnonzero(~first)
        codes, place = np.unique(self.word_of[self.later - 1] << 32 | self.word_of[self.later], return_inverse=True)
        before, after = codes >> 32, codes & 0xFFFFFFFF
        keys = mix(mix(self.word_keys[before], 1) ^ self.word_keys[after], 2)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.before, self.after = keys[order], before[order], after[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair_of = rank[place]


def _sender(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk and part of the key range, which has ``2 ** bits`` parts: keys and counts, all and in targets."""

    def part_of(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)

    def cut(keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> dict[int, bytes]:
        parts = part_of(keys)
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])[:len(parts)]).tolist()
        steps = np.diff(keys, prepend=np.zeros(1, np.uint64)).view(np.int64)
        out = {}
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            step = steps[a:b].copy()
            step[0] = keys[a:a + 1].view(np.int64)[0]
            out[int(parts[a])] = _pack(step, n[a:b], m[a:b])
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                found = _Bigrams(own["body"], own["sizes"])
                flags = np.zeros(len(own["sizes"]), np.int64)
                flags[own["targets"] or []] = 1
                goal = flags[found.owner]
                many = lambda place, size, goal: (np.bincount(place, minlength=size), sums(goal, place, size))
                words = cut(found.word_keys, *many(found.word_of, len(found.word_keys), goal))
                pairs = cut(found.pair_keys, *many(found.pair_of, len(found.pair_keys), goal[found.later]))
                parts = sorted(words.keys() | pairs.keys())
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own["chunk"]] * len(parts)), pa.array(parts), pa.array([pairs.get(p) for p in parts], pa.binary()), pa.array([words.get(p) for p in parts], pa.binary())],
                        names=["chunk", "part", "pairs", "words"])

    return send


def _totals(blobs: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """For sent keys of one part the totals in the order of each blob, and the totals of its distinct keys."""
    sent = [(i, _unpack(b, 3)) for i, b in enumerate(blobs) if b]
    out: list[bytes | None] = [None] * len(blobs)
    if not sent:
        return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([np.cumsum(x[0].view(np.uint64)) for _, x in sent])
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    n, m = (np.add.reduceat(np.concatenate([x[k] for _, x in sent])[order], starts) for k in (1, 2))
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff([*starts, len(keys)]))
    end = 0
    for i, x in sent:
        here = place[end:end + x.shape[1]]
        out[i] = _pack(n[here], m[here])
        end += x.shape[1]
    return out, n, m


def _answer(table: pa.Table) -> pa.Table:
    """All rows of one part, with totals in place of keys; the first row has the sums of the part's words."""
    words, n, m = _totals(table["words"].to_pylist())
    pairs = _totals(table["pairs"].to_pylist())[0]
    once = lambda x: pa.array([int(x), *[0] * (len(table) - 1)], pa.int64())
    return pa.table([table["chunk"], table["part"], pa.array(pairs, pa.binary()), pa.array(words, pa.binary()), once(len(n)), once(n.sum()), once(m.sum())],
                    names=["chunk", "part", "pairs", "words", "size", "total", "goal"])


def _scorer(size: int, total: int, goal: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Loss differences of a chunk's documents from the chunk and the totals of its words and bigrams."""

    def rounded(bits: np.ndarray) -> np.ndarray:
        return np.floor(bits * UNIT + 0.5).astype(np.int64)

    def told(rows: list[dict], side: str) -> np.ndarray:
        blobs = [_unpack(r[side], 2) for r in rows if r[side]]
        return np.concatenate(blobs, 1).astype(float) if blobs else np.zeros((2, 0))

    def score(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        own = chunk.to_pylist()[0]
        answers = sorted(totals.to_pylist(), key=lambda r: r["part"])
        found = _Bigrams(own["body"], own["sizes"])
        (base, good), (n, m) = told(answers, "words"), told(answers, "pairs")
        p, q = (base + 1) / (total + size + 1), (good + 1) / (goal + size + 1)
        units = rounded(np.log2(p) - np.log2(q))[found.word_of]
        c, w = found.before, found.after
        after = rounded(np.log2((n + PRIOR * p[w]) / (base[c] + PRIOR)) - np.log2((m + PRIOR * q[w]) / (good[c] + PRIOR)))
        units[found.later] = after[found.pair_of]
        return pa.table([pa.array(own["rows"], pa.string()), pa.array(found.counts), pa.array(sums(units, found.owner, len(own["sizes"])))], names=["row", "n_tokens", "loss_units"])

    return score


def loss_differences(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``row`` (see ``row_key``), ``n_tokens`` and ``loss_units``, the sum over the tokens of a row; ``target_ids`` has the ids of the target documents.

    The result and what it is made of are written in turn; only the result stays.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lm_chunks_{uuid.uuid4().hex}"
    with batches_of(spark, BATCH_ROWS):
        narrow = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), row_key(doc_id, text).alias("row"))
        # Below the shared folder: the warehouse folder may be one machine's.
        narrow.mapInArrow(_chunked(CHUNK_BYTES), _OWN).write.option("path", work_path(spark, "cut")).bucketBy(buckets, "chunk").saveAsTable(name)
        own = spark.table(name)
        try:
            # The target grows with the corpus, so it is merged with ids alone at every size; the texts stay where they are.
            target = target_ids.select(F.col(doc_id).cast("string").alias("id")).where("id IS NOT NULL").distinct()
            marked = own.select("chunk", F.posexplode("ids").alias("place", "id")).join(target.hint("merge"), "id", "left_semi")
            marks = marked.groupBy("chunk").agg(F.collect_list("place").alias("targets"))
            n_bytes = own.agg(F.sum("n_bytes")).first()[0] or 0
            bits = max(0, n_bytes // PART_BYTES).bit_length()
            sent = own.select("chunk", "sizes", "body").join(marks, "chunk", "left").mapInArrow(_sender(bits), _SENT)
            told = cut_lineage(sent.groupBy("part").applyInArrow(_answer, _TOLD))
            size, total, goal = told.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "total", "goal"))).first()
            texts, totals = own.select("chunk", "rows", "sizes", "body"), told.select("chunk", "part", "pairs", "words")
            scored = texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scorer(size, total, goal), "row string, n_tokens long, loss_units long")
            found = cut_lineage(scored.groupBy("row").agg(F.max("n_tokens").alias("n_tokens"), F.max("loss_units").alias("loss_units")))
            discard(told)
            return found
        finally:
            discard(own)
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_score(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", name: str = "lm") -> DataFrame:
    """``docs`` with a struct ``name``: ``n_tokens``, ``loss_units`` and ``score`` in bits per token."""
    found = loss_differences(docs, target_ids, text, doc_id).select(
        F.col("row").alias("_sf_row"), F.struct("n_tokens", "loss_units", F.when(F.col("n_tokens") > 0, F.col("loss_units") / F.col("n_tokens") / UNIT).alias("score")).alias("_sf_lm"))
    return docs.withColumn("_sf_row", row_key(doc_id, text)).join(found, "_sf_row", "left").select(*(F.col(f"`{c}`") for c in docs.columns if c != name), F.col("_sf_lm").alias(name))
