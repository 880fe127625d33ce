"""Mixing sources to target weights: hash-random order within each source, cut at the source's exact budget.

Budgets first: all sources together share ``share`` times the corpus by weight; a source's budget stops at ``most`` times its
size, and what is left over goes to the others by weight until none is above.  That takes a few aggregates over the
table of sources, one for each time that another source reaches its bound.

Then every document gets a hash-random key and the table is range-partitioned and sorted by (source, key).  A source of any size
spreads over as many tasks as it needs.  The sums of each (source, partition) give the offsets of the partitions, so that a running
sum inside each partition becomes the running sum within the source.  A budget is a number of whole epochs of the source and a
rest: all documents are taken once per epoch, and in one more pass those before the cut, the one across it in part.  A
source's words are so exactly its budget, rounded down to a whole word.

Null sources are one source, named last.  A null or negative size counts 0; such documents take nothing.  A null id has a key like any
other; rows that agree in id, source and size share the cut in a fixed way, so reruns agree.  An empty table gives an empty table.
Only ids, sources and sizes move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def source_table(narrow: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``name``, ``source_size`` and ``weight``: weights repeat along the sources by code point, null (an empty name) last.

    Sources are numbered without gathering them: range partitions, their counts, and a row number inside each.
    """
    sums, last = narrow.groupBy("name").agg(F.sum("size").alias("source_size")), F.col("name") == ""
    dealt = cut_lineage(sums.repartitionByRange(last, "name").withColumn("part", F.spark_partition_id()))
    # one row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(last, "name")) - 1).join(before, "part")
    weight = F.get(F.lit(list(weights)), F.pmod(F.col("before") + F.col("place"), F.lit(len(weights))).cast("int"))
    return cut_lineage(numbered.select("name", "source_size", weight.cast("long").alias("weight")))


def with_targets(sources: DataFrame, share: tuple[int, int], most: int) -> DataFrame:
    """``sources`` with ``target``: ``share`` (a fraction) of all sizes by weight, never above ``most`` times a source's size."""
    bound = F.col("source_size") * most
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, seen = 0.0, None  # words per unit of weight
    while True:
        full = F.col("weight") * level > bound
        held, rest = sources.agg(F.coalesce(F.sum(F.when(full, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if (held, rest) == seen:
            break
        seen, left = (held, rest), max(0.0, total * share[0] / share[1] - held)
        level = left / rest if rest else level
    return sources.withColumn("target", F.when(full, bound.cast("double")).otherwise(F.col("weight") * F.lit(left) / F.lit(max(rest, 1))))


def mix(docs: DataFrame, size: Column, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2,
        doc_id: str = "doc_id", source: str = "source", seed: int = 13) -> DataFrame:
    """Per document: its id, source and ``size``, ``source_size`` and ``target`` of its source, ``epochs`` (whole passes) and ``taken`` words.

    ``taken`` is ``epochs`` times the size and what the last, partial pass takes.
    """
    text = F.col(source).cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    # A source is named by "=" and itself, null by nothing, so that names can be compared as they are.
    narrow = cut_lineage(docs.select(F.col(doc_id).alias("id"), F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text)).alias("name"),
                                     F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), key.alias("key")))
    sources = cut_lineage(with_targets(source_table(narrow, weights), share, most))

    # Equal rows are told apart by their place in the table; which of them is cut does not show.
    order = ["key", "id", "size", "copy"]
    placed = narrow.withColumn("copy", F.monotonically_increasing_id())
    dealt = cut_lineage(placed.repartitionByRange("name", *order).withColumn("part", F.spark_partition_id()))
    ahead = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("name", "part").agg(F.sum("size").alias("n")).select("name", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("name", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumn("running", F.sum("size").over(inside)).join(offsets.join(sources, "name"), ["name", "part"])

    budget, whole = F.floor("target").cast("long"), F.col("source_size")
    rows = rows.withColumn("epochs", F.when(whole > 0, F.floor(budget / whole)).otherwise(0).cast("long"))
    before = F.col("offset") + F.col("running") - F.col("size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - F.col("epochs") * whole - before))
    return rows.select(F.col("id").alias(doc_id), F.when(F.col("name") != "", F.substring("name", 2, 1 << 30)).alias(source), "size", "source_size", "target", "epochs",
                       (F.col("epochs") * F.col("size") + cut).alias("taken"))
