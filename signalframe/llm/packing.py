"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

Two documents of one source, or of one cluster of copies, never share a bin.  Within a shard, documents are
placed longest first.  Open bins are ordered by what they have left; a bit set of the residuals in use finds
the successor of a length, and the search goes on to the next residual until a bin is found whose source and
cluster bitmaps do not touch the document's: the tightest compatible bin.  If there is none, a bin is opened.

A document longer than a bin is cut into full bins and a rest that is packed like any other.  Only ids, sizes,
sources and clusters move; rows are dealt evenly, so a source with a third of all rows is in every shard,
and each task packs shards of ``SHARD_ROWS`` rows one after the other.

Null source or cluster conflicts with nothing; a null or negative size counts 0, and an empty document takes
no room but has its place; repeated rows are placed one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Rows packed together; bounds the bins and the search within a task.
SHARD_ROWS = 8192


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, start in document, length, bin, start in bin) of every piece; rows are given in order of placement."""
    out: list[tuple[int, int, int, int, int]] = []
    at_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r is set while a bin with residual r is open
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    source_bits: dict = {None: 0}
    cluster_bits: dict = {None: 0}
    for row in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        full, need = divmod(sizes[row], capacity)
        source = source_bits.setdefault(sources[row], 1 << len(source_bits))
        cluster = cluster_bits.setdefault(clusters[row], 1 << len(cluster_bits))
        for k in range(full):
            out.append((row, k * capacity, capacity, len(bin_sources), 0))
            bin_sources.append(source)
            bin_clusters.append(cluster)
        if full and not need:
            continue
        r, found = need, -1
        while rest := used >> r:
            r += (rest & -rest).bit_length() - 1
            found = next((b for b in at_residual[r] if not (bin_sources[b] & source or bin_clusters[b] & cluster)), -1)
            if found >= 0:
                at_residual[r].remove(found)
                if not at_residual[r]:
                    used ^= 1 << r
                break
            r += 1
        if found < 0:
            found, r = len(bin_sources), capacity
            bin_sources.append(0)
            bin_clusters.append(0)
        bin_sources[found] |= source
        bin_clusters[found] |= cluster
        at_residual[r - need].append(found)
        used |= 1 << (r - need)
        out.append((row, full * capacity, need, found, capacity - r))
    return out


def pack(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", cluster: Column | None = None,
         capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: the id, ``start`` and ``length`` in the document, ``bin``, ``position`` in the bin.

    ``bin`` is unique over the whole result.  The rows are dealt round robin (which Spark does in a fixed order)
    and sorted inside each partition, so a task that runs again packs the same rows in the same order.
    """
    narrow = docs.select(
        F.col(doc_id).alias("id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
        F.col(source).cast("string").alias("source"), (F.lit(None).cast("long") if cluster is None else F.xxhash64(cluster)).alias("cluster"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = narrow.repartition(parts).sortWithinPartitions("id", "size", "source", "cluster")
    kind = docs.schema[doc_id].dataType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, waiting, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            placed = pack_shard(*(table[c].to_pylist() for c in ("size", "source", "cluster")), capacity)
            row, start, length, number, position = zip(*placed)
            # 24 bits of task, 16 of shard and 23 of bin stay below the sign bit.
            bins = [(task << 39) | (shard << 23) | b for b in number]
            ids = table["id"].combine_chunks().take(pa.array(row, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, bins, position))],
                                              names=["id", "start", "length", "bin", "position"])

        for batch in parts:
            while len(batch):
                part, batch = batch.slice(0, shard_rows - rows), batch.slice(shard_rows - rows)
                waiting.append(part)
                rows += len(part)
                if rows == shard_rows:
                    yield packed()
                    shard, waiting, rows = shard + 1, [], 0
        if rows:
            yield packed()

    made = dealt.mapInArrow(batches, f"id {kind.simpleString()}, start long, length long, bin long, position long")
    return made.withColumnRenamed("id", doc_id)


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; 0 for null."""
    blank = F.regexp_replace(text, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.coalesce(F.when(blank != "", F.size(F.split(blank, r"[\x20\x09-\x0D]+"))), F.lit(0))
