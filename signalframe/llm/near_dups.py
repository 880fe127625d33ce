"""Near copies by fast similarity sketches, banding and exact verification.

A document's set are the hashes of its distinct word shingles.  Its sketch has T coordinates.  In round i every
element is hashed to one bin with a value; a bin keeps the smallest value of the first round that reaches it.
T rounds spread elements over the bins; in the T rounds after them, round j puts every element into
bin j, so every coordinate is filled, however small the set.  Bands of ``ROWS`` coordinates are the
buckets in which links are looked for: two sets with a Jaccard similarity s share a band with s ** ROWS.

Equal sets form one class, and only classes are compared, in two searches of the same form.  In every bucket those
pairs are possible links whose sizes can reach the threshold (exact) and whose sketches do not differ so much that the
threshold lies more than six standard deviations away; what possible links join is a coarse group.  Then the full
sets of each coarse group are compared.  A task holds a block of a group, or two blocks that meet, and compares only
members that nothing joins yet; it gives the links that join them, fewer than it has members, never their
pairs.  A group of several blocks has its smallest member in each; what is still apart from its largest part after
that meets all blocks.  So no pair that could join two components is left out.

Null and empty texts, and texts without words, have an empty set and are linked with nothing.  With fewer words
than a shingle has, the whole sequence is one.  Rows with equal text are linked, also under one id.  A row
with a null id is linked like any other but is never the one that stays.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, discard
from .components import components
from .text import LOWER, Words, as_bytes, batches_of, chunks, hash_words, mix, mix_rounds, row_key, window_hashes
from .url_filter import BROADCAST_BLOCKS, bloom_blocks, bloom_probe

#: Coordinates of a band, and bands: at similarity 0.85 a pair is in no common bucket with 2e-8, at 0.8 with 3e-8 (see ``bands_for``).
ROWS = 8
#: Largest chance that a pair at the threshold shares no bucket.
MISS = 3e-8
#: Coordinates that are kept, a byte each, to estimate the similarity of a pair; the estimate may lie this far below.
BRIEF, SLACK = 256, 0.145
#: Members of a block, and elements of their full sets, about.
BLOCK, ELEMENTS = 1024, 1 << 20
#: Rows of an Arrow batch, as sets of long texts come in them; rows and bytes that wait for the end of their block.
BATCH_ROWS = 500
WAIT_ROWS, WAIT_BYTES = 8192, 32 << 20

SCHEMA = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("brief", T.BinaryType()),
])


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that are needed to miss a pair at the threshold with a chance of ``miss`` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-threshold ** rows)))


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Coordinates of a set of distinct uint64 hashes, at least one."""
    out, empty = np.zeros(size, np.uint64), np.ones(size, bool)
    n, first = len(elements), 0
    while first < size and empty.any():
        rounds = min(size - first, max(1, 4096 // n))
        values = mix_rounds(elements, first, rounds).ravel()
        bins = ((values >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((values, np.repeat(np.arange(rounds), n), bins))
        bins = bins[order]
        lead = np.concatenate([[True], bins[1:] != bins[:-1]])
        lead[lead] = empty[bins[lead]]
        out[bins[lead]] = values[order[lead]]
        empty[bins[lead]] = False
        first += rounds
    left = np.flatnonzero(empty)
    if len(left):
        out[left] = mix_rounds(elements, size, size).min(1)[left]
    return out


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = Words(texts, LOWER)
    hashes = hash_words(words.vocabulary)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    rolled = window_hashes(hashes, shingle)
    out = []
    for start, count in zip(words.starts.tolist(), words.counts.tolist()):
        if count >= shingle:
            out.append(np.unique(rolled[start:start + count - shingle + 1]))
        else:
            out.append(window_hashes(hashes[start:start + count], count) if count else np.zeros(0, np.uint64))
    return out


def _sketched(text: Column, shingle: int, bands: int) -> Column:
    salts = mix(np.arange(bands, dtype=np.uint64), 99)

    def rows(part: pa.Array):
        sets = shingle_sets(as_bytes(part), shingle)
        full = [s for s in sets if len(s)]
        if full:
            table = np.stack([sketch(s, bands * ROWS) for s in full])
            cut = table.reshape(len(full), bands, ROWS)
            keys = cut[:, :, 0] ^ salts
            for k in range(1, ROWS):
                keys = mix(keys) ^ cut[:, :, k]
            keys = mix(keys).view(np.int64)
            briefs = (table[:, :BRIEF] & np.uint64(255)).astype(np.uint8)
        i = 0
        for s in sets:
            if len(s):
                yield len(s), xxhash.xxh3_128_digest(s.tobytes()), keys[i], briefs[i].tobytes()
                i += 1
            else:
                yield 0, None, None, None

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        for texts in columns:
            columns_out: list[list] = [[], [], [], []]
            for _, part in chunks(texts):
                for row in rows(part):
                    for c, v in zip(columns_out, row):
                        c.append(v)
            yield pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns_out, kinds)], names=SCHEMA.names)

    return F.arrow_udf(batches, SCHEMA, F.ArrowUDFType.SCALAR_ITER)(text)


def _sets(text: Column, shingle: int) -> Column:
    """The sets of a text column and their hashes, from one Python worker per task."""
    kind = T.StructType([T.StructField("elements", T.BinaryType()), T.StructField("key", T.BinaryType())])

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            blobs = [s.tobytes() or None for _, part in chunks(texts) for s in shingle_sets(as_bytes(part), shingle)]
            keys = [b and xxhash.xxh3_128_digest(b) for b in blobs]
            yield pa.StructArray.from_arrays([pa.array(blobs, pa.binary()), pa.array(keys, pa.binary())], names=kind.names)

    return F.arrow_udf(batches, kind, F.ArrowUDFType.SCALAR_ITER)(text)


class _Elements:
    """The full sets of some rows, as numbers of their elements."""

    def __init__(self, blobs: list[bytes]):
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
        self.own = np.zeros(len(known), bool)

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        self.own[self.sets[row]] = True
        out = np.array([np.count_nonzero(self.own[self.sets[k]]) for k in others.tolist()], np.int64)
        self.own[self.sets[row]] = False
        return out


@dataclass(frozen=True)
class Threshold:
    """intersection * down >= union * up, in whole numbers."""

    up: int
    down: int

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common * self.down >= (a + b - common) * self.up

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No set of size a can be linked with one of size b if this is false."""
        return np.minimum(a, b) * self.down >= np.maximum(a, b) * self.up

    @property
    def alike(self) -> int:
        """Equal coordinates of two brief sketches below which no link is looked for."""
        return int(np.floor((self.up / self.down - SLACK) * BRIEF))


def _joins(t: Threshold, n: np.ndarray, brief: np.ndarray, sets: _Elements | None, label: np.ndarray, drivers: np.ndarray, others: np.ndarray | None) -> list[tuple[int, int]]:
    """Links of drivers with others that join all labels which their links could join; ``label`` follows.

    Without others, drivers meet those behind them; all that stand before the first driver have been met.
    """
    out = []
    for y in drivers.tolist():
        x = np.arange(y + 1, len(n)) if others is None else others
        x = x[label[x] != label[y]]
        x = x[t.possible(n[x], n[y])]
        if len(x):
            x = x[(brief[x] == brief[y]).sum(1, dtype=np.int16) >= t.alike]
        if sets and len(x):
            x = x[t.linked(sets.common(y, x), n[x], n[y])]
        if len(x):
            joined, first = np.unique(label[x], return_index=True)
            out += [(y, k) for k in x[first].tolist()]
            label[np.isin(label, joined)] = label[y]
    return out


def _met(rows: DataFrame, t: Threshold, exact: bool, strays: bool) -> DataFrame:
    """Distinct (a, b): links that join the nodes of each block (bucket, i, j) as far as the pairs in it do.

    With ``strays`` these meet the other rows, else all rows meet each other.  Links are judged by full sets if ``exact``.
    """
    def meet(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        node, n, label = (table[k].to_numpy().copy() for k in ("node", "n", "c"))
        stray = table["stray"].to_numpy().astype(bool)
        brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(len(node), BRIEF)
        pairs, skip = [np.zeros((0, 2), np.int64)], 0
        if not exact and not strays:
            # Most buckets are one group: the first of each is compared with its others at once.
            first, skip = np.repeat(starts, ends - starts), 1
            near = (label != label[first]) & t.possible(n, n[first])
            near[near] = (brief[near] == brief[first[near]]).sum(1, dtype=np.int16) >= t.alike
            pairs.append(np.stack([first[near], np.flatnonzero(near)], 1))
            label[near] = label[first[near]]
            apart = np.add.reduceat(label != label[first], starts)
            starts, ends = starts[(apart > 0) & (ends - starts > 2)], ends[(apart > 0) & (ends - starts > 2)]
        for a, e in zip(starts.tolist(), ends.tolist()):
            part = slice(a, e)
            drivers = np.flatnonzero(stray[part]) if strays else np.arange(skip, e - a)
            others = np.flatnonzero(~stray[part]) if strays else None
            if len(drivers) and (others is None or len(others)):
                sets = _Elements(table["elements"].slice(a, e - a).to_pylist()) if exact else None
                found = _joins(t, n[part], brief[part], sets, label[part], drivers, others)
                pairs.append(np.array(found, np.int64).reshape(-1, 2) + a)
        ends_of = node[np.concatenate(pairs)]
        return np.unique(np.sort(ends_of, axis=1), axis=0)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            keys = np.stack([table[k].to_numpy().astype(np.int64) for k in ("bucket", "i", "j")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            whole = len(table) if last else int(starts[-1])
            starts = starts[starts < whole]
            found = meet(table.slice(0, whole), starts, np.append(starts[1:], whole)) if whole else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"]), table.slice(whole)

        waiting: pa.Table | None = None
        for batch in parts:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            if len(waiting) >= WAIT_ROWS or waiting.nbytes >= WAIT_BYTES:
                found, waiting = met(waiting.combine_chunks(), False)
                yield found
        if waiting is not None and len(waiting):
            yield met(waiting.combine_chunks(), True)[0]

    # The smallest node leads its block: the same one in all blocks of a bucket.
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return dealt.mapInArrow(batches, "a long, b long").distinct()


def _joined(members: DataFrame, t: Threshold, exact: bool) -> DataFrame:
    """``node`` and ``root`` of all nodes that pairs within a bucket link; ``members`` has bucket, blocks, node, n, brief and, if ``exact``, elements."""
    shown = ["node", "n", "brief", *(["elements"] if exact else [])]
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    wide = members.where("blocks > 1")
    leads = wide.groupBy("bucket").agg(F.min_by(F.struct("blocks", *shown), "node").alias("lead")).select("bucket", "lead.*")
    leads = leads.select("bucket", upto(F.col("blocks")).alias("i"), home.alias("home"), *shown).where("i <> home").drop("home")
    rows = members.select("bucket", home.alias("i"), *shown).unionByName(leads)
    roots = cut_lineage(components(_met(rows.select("*", F.lit(0).alias("j"), F.lit(False).alias("stray"), F.col("node").alias("c")), t, exact, False)))
    labels = wide.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("c"))
    parts = labels.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"))
    apart = cut_lineage(labels.join(parts.where("parts > 1"), "bucket").select("bucket", "node", "c", (F.col("c") != F.col("main")).alias("stray")))
    if not apart.isEmpty():
        # Every pair of two components has a member outside the bucket's largest one: these meet all.
        far = apart.groupBy("bucket").agg((F.count_if("stray") / F.count("*")).alias("share"))
        every = wide.join(apart, ["bucket", "node"]).join(far, "bucket")
        across = F.ceil(F.col("blocks") * F.col("share")).cast("int")
        left = every.select("bucket", home.alias("i"), upto(across).alias("j"), F.lit(False).alias("stray"), "c", *shown)
        right = every.where("stray").select("bucket", upto(F.col("blocks")).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), across).cast("int").alias("j"), "stray", "c", *shown)
        more = cut_lineage(_met(left.unionByName(right), t, exact, True))
        if not more.isEmpty():
            older = roots
            roots = cut_lineage(components(older.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
            discard(older)
        discard(more)
    discard(apart)
    return roots


def groups(docs: DataFrame, shingle: int = 5, up: int = 4, down: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` (smallest id of the group) and ``kept`` (id is that one).

    Documents are linked if intersection * down >= union * up.
    """
    component = F.coalesce("component_id", "id")
    return _labelled(docs, shingle, up, down, text, doc_id).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _slimmer(written: DataFrame, *columns: str) -> DataFrame:
    """A written table with these columns alone; the wider one is deleted."""
    slim = cut_lineage(written.select(*columns))
    discard(written)
    return slim


def _labelled(docs: DataFrame, shingle: int, up: int, down: int, text: str, doc_id: str) -> DataFrame:
    """``id``, ``row`` (see ``row_key``), ``n``, and group ``c`` with its ``component_id``, null for rows without words."""
    t = Threshold(up, down)
    bands = bands_for(up / down)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        rows = cut_lineage(docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("row"), _sketched(F.col(text), shingle, bands).alias("s")).select("id", "row", "s.*"))
        classes = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("brief").alias("brief"))
        classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
        rows = _slimmer(rows, "id", "row", "n", "key")

        # One exchange serves the count and the join; buckets of one member go before the sketches move.
        slots = classes.select("node", F.explode("bands").alias("bucket")).repartition("bucket")
        shared = slots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        several = cut_lineage(slots.join(shared.hint("merge"), "bucket").select("bucket", "node", "size"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
        members = cut_lineage(several.join(classes.select("node", "n", "brief"), "node").select("bucket", blocks, "node", "n", "brief"))
        discard(several)
        classes = _slimmer(classes, "node", "key", "n", "least", "brief")
        coarse = _joined(members, t, False)
        discard(members)
        sets = _coarse_sets(docs, classes, coarse, shingle, text, doc_id)
        discard(coarse)
        found = _joined(sets, t, True)
        discard(sets)
        classes = classes.join(found, "node", "left").select("key", "least", F.coalesce("root", "node").alias("c"))
    least = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    found = classes.select("key", "c").join(least, "c")
    return rows.select("id", "row", "n", "key").join(found, "key", "left").select("id", "row", "n", "c", "component_id")


def _coarse_sets(docs: DataFrame, classes: DataFrame, coarse: DataFrame, shingle: int, text: str, doc_id: str) -> DataFrame:
    """``bucket`` (its coarse group), ``blocks``, ``node``, ``n``, ``brief`` and ``elements`` of the classes in ``coarse``, made again from one text of each.

    A Bloom filter of bounded size lets few other texts into the shuffle; past its bound it lets in more.
    """
    wanted = coarse.join(classes, "node").withColumnRenamed("root", "bucket")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("int").alias("blocks")
    wanted = cut_lineage(wanted.join(wanted.groupBy("bucket").agg(blocks), "bucket"))
    shown = ["bucket", "blocks", "node", "n", "brief"]
    blocks = min(BROADCAST_BLOCKS, max(1, wanted.count() // 16))
    bloom = F.broadcast(bloom_blocks(wanted, "least", blocks))
    texts = docs.select(F.col(doc_id).alias("least"), F.col(text).alias("text"))
    texts = bloom_probe(texts, "least", bloom, blocks).where("possible").select("least", "text")
    # An id may have several texts: the set's own hash tells them apart.
    made = texts.join(wanted.select("least").distinct(), "least", "left_semi").select(_sets(F.col("text"), shingle).alias("s")).select("s.*")
    sets = made.dropDuplicates(["key"]).join(wanted.select("key", *shown), "key").select(*shown, "elements")
    # A class whose ids are all null has no id to look up; its text is found by its hash.
    lost = wanted.where("least IS NULL")
    if not lost.isEmpty():
        nameless = docs.where(F.col(doc_id).isNull()).select(_sets(F.col(text), shingle).alias("s")).select("s.*").dropDuplicates(["key"])
        sets = sets.unionByName(nameless.join(lost.select("key", *shown), "key").select(*shown, "elements"))
    sets = cut_lineage(sets)
    discard(wanted)
    return sets


def keep_one(docs: DataFrame, shingle: int = 5, up: int = 4, down: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each group one row of the smallest id, rows without id coming last.

    Rows alone in their group stay.  A Bloom filter of bounded size tells which rows may be in a larger group; the
    others are passed on without a shuffle.
    """
    found = cut_lineage(_labelled(docs, shingle, up, down, text, doc_id).where("c IS NOT NULL").select("row", "id", "c"))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first")
    large = found.groupBy("c").agg(F.count("*").alias("size"), first).where("size > 1")
    grouped = cut_lineage(found.join(large, "c").groupBy("row").agg(F.max(F.col("row") == F.col("first.row")).alias("stays")))
    blocks = min(BROADCAST_BLOCKS, max(1, grouped.count() // 16))
    rows = docs.select(F.struct("*").alias("whole"), row_key(doc_id, text).alias("row"))
    probed = bloom_probe(rows, "row", F.broadcast(bloom_blocks(grouped, "row", blocks)), blocks)
    maybe = probed.where("possible").join(grouped, "row", "left")
    alone = probed.where("NOT possible").select("whole").unionByName(maybe.where("stays IS NULL").select("whole"))
    kept = maybe.where("stays").groupBy("row").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole")).select("whole")
    return alone.unionByName(kept).select("whole.*")
