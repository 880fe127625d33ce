"""Exact global order statistics without a single-task window.

Three tools, all built on "cut the value range into buckets, add bucket totals, finish inside the
bucket":

* ``running_sums``    cumulative sums along a sorted column (ROC curves, prefix totals);
* ``exact_quantiles`` interpolated quantiles per group;
* ``hash_cutoffs``    the k-th smallest hash key per group, which turns quota sampling and
  splitting into a comparison per row: the wide payload is never shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import hash_key

DEFAULT_BUCKETS = 256
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
SMALL_ROWS = 50_000
SMALL_GROUP = 2_000_000


def bounded_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` ready to be the small side of a join.

    At most ``max_rows + 1`` rows are fetched.  If that is everything, they come back as a local
    table with a broadcast hint; otherwise ``df`` returns unchanged and the join shuffles.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def split_points(df: DataFrame, value: str, buckets: int = DEFAULT_BUCKETS, sample: int = 4096) -> list:
    """Sorted boundaries that cut the rows of ``value`` into about equal buckets.

    Numbers use a quantile sketch, one pass that combines on the map side: a bucket holds about
    1/buckets of the rows, or one repeated value.  Other types use the ``sample`` distinct values
    with the smallest hashes.  A poor cut only makes buckets uneven, never the result wrong.
    """
    kind = dict(df.dtypes)[value]
    if kind in NUMBERS:
        grid = [i / buckets for i in range(1, buckets)]
        cuts = df.agg(F.percentile_approx(value, grid, 20 * buckets).alias("q")).first()["q"]
        return sorted(set(cuts or []))
    picked = (
        df.select(value).where(F.col(value).isNotNull()).distinct()
        .orderBy(F.xxhash64(value), value).limit(sample)
    )
    values = sorted(r[0] for r in picked.collect())
    if len(values) <= buckets:
        return values[1:]
    step = len(values) / buckets
    return [values[int(i * step)] for i in range(1, buckets)]


def with_bucket(df: DataFrame, value: str, points: list, out: str = "_sf_b") -> DataFrame:
    """Add the number of boundaries at or below the value, by binary search for numbers.

    The bucket is never null, so a join on it adds no null test that would search a second time.
    """
    if not points:
        return df.withColumn(out, F.lit(0))
    if dict(df.dtypes)[value] in NUMBERS:
        edges = [float("-inf"), *[float(p) for p in points], float("inf")]
        search = Bucketizer(splits=edges, inputCol="_sf_num", outputCol="_sf_bucket", handleInvalid="keep")
        found = search.transform(df.withColumn("_sf_num", F.col(value).cast("double")))
        return found.withColumn(out, F.coalesce(F.col("_sf_bucket").cast("int"), F.lit(0))).drop("_sf_num", "_sf_bucket")
    at_or_below = F.size(F.filter(F.lit(points), lambda p: p <= F.col(value)))
    return df.withColumn(out, F.coalesce(at_or_below, F.lit(0)))


def running_sums(
    df: DataFrame,
    order_col: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Add ``cum_<c>`` = total of ``c`` up to and including each row, in ``order_col`` order.

    ``order_col`` must be distinct per ``by`` group (aggregate ties first).  Windows run inside
    (group, bucket); only the bucket totals, at most ``buckets`` rows per group, are ordered whole.
    """
    by = list(by)
    keyed = with_bucket(df, order_col, split_points(df, order_col, buckets))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = keyed.groupBy(*by, "_sf_b").agg(*[F.sum(c).alias(f"_sf_t_{c}") for c in sums])
    before = W.partitionBy(*by).orderBy(direction("_sf_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_sf_b", *[F.coalesce(F.sum(f"_sf_t_{c}").over(before), F.lit(0)).alias(f"_sf_o_{c}") for c in sums]
    )
    inside = W.partitionBy(*by, "_sf_b").orderBy(direction(order_col)).rowsBetween(W.unboundedPreceding, 0)
    ranked = keyed.withColumns({f"_sf_c_{c}": F.sum(c).over(inside) for c in sums})
    joined = join_groups(ranked, offsets, [*by, "_sf_b"])
    out = joined.withColumns({f"cum_{c}": F.col(f"_sf_c_{c}") + F.col(f"_sf_o_{c}") for c in sums})
    return out.drop("_sf_b", *[f"_sf_c_{c}" for c in sums], *[f"_sf_o_{c}" for c in sums])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    buckets: int = 4 * DEFAULT_BUCKETS,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """(by..., prob, quantile): linear-interpolated quantiles of the non-null values.

    The built-in exact percentile keeps every distinct value of a group in one task, so it is used
    only when no group has more than ``small_group`` rows.  Otherwise three scans shuffle little: a
    sketch for bucket bounds, a histogram that says which buckets hold the wanted ranks, and an
    ordering of just those buckets, 1/buckets of the rows each.
    """
    by = list(by)
    keep = df.select(*by, F.col(value).cast("double").alias("_sf_v")).where("_sf_v IS NOT NULL AND NOT isnan(_sf_v)")
    largest = keep.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= small_group:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        found = keep.groupBy(*by).agg(F.percentile("_sf_v", grid).alias("_sf_q"))
        return found.select(*by, F.inline(F.arrays_zip(grid.alias("prob"), F.col("_sf_q").alias("quantile")))).toDF(*by, "prob", "quantile")
    points = split_points(keep, "_sf_v", buckets)
    totals = with_bucket(keep, "_sf_v", points).groupBy(*by, "_sf_b").agg(F.count("*").alias("_sf_t"))
    whole = W.partitionBy(*by)
    upto = whole.orderBy("_sf_b").rowsBetween(W.unboundedPreceding, 0)
    totals = totals.withColumns(
        {"_sf_hi": F.sum("_sf_t").over(upto), "_sf_total": F.sum("_sf_t").over(whole)}
    ).withColumn("_sf_lo", F.col("_sf_hi") - F.col("_sf_t"))
    pos = F.col("prob") * (F.col("_sf_total") - 1)
    wanted = totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumns({"_sf_pos": pos, "_sf_k": F.floor(pos)}).withColumn(
        "_sf_rank", F.explode(F.array(F.col("_sf_k"), F.least(F.col("_sf_k") + 1, F.col("_sf_total") - 1)))
    )
    wanted = wanted.where((F.col("_sf_rank") >= F.col("_sf_lo")) & (F.col("_sf_rank") < F.col("_sf_hi")))
    # NaN sorts above every number, so it closes the last bucket even for infinite values.
    bounds = F.lit([float("-inf"), *points]), F.lit([*points, float("nan")])
    wanted = wanted.select(
        *by, "_sf_b", "_sf_lo", "prob", "_sf_pos", "_sf_k", "_sf_rank",
        F.get(bounds[0], F.col("_sf_b")).alias("_sf_from"), F.get(bounds[1], F.col("_sf_b")).alias("_sf_to"),
    )
    wanted = bounded_side(wanted)
    ranges = wanted.select(*by, "_sf_b", "_sf_lo", "_sf_from", "_sf_to").distinct()
    v = F.col("_sf_v")
    if by:
        inside = attach(keep, ranges, by).where((v >= F.col("_sf_from")) & (v < F.col("_sf_to")))
    else:
        few = ranges.collect()  # at most two per probability
        near = F.lit(False)
        for r in few:
            near = near | ((v >= F.lit(r["_sf_from"])) & (v < F.lit(r["_sf_to"])))
        inside = with_bucket(keep.where(near), "_sf_v", points).join(bounded_side(ranges), "_sf_b")
    counts = inside.groupBy(*by, "_sf_b", "_sf_lo", "_sf_v").agg(F.count("*").alias("_sf_n"))
    order = W.partitionBy(*by, "_sf_b").orderBy("_sf_v").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("_sf_end", F.col("_sf_lo") + F.sum("_sf_n").over(order))
    placed = placed.withColumn("_sf_start", F.col("_sf_end") - F.col("_sf_n")).drop("_sf_lo")
    hit = join_groups(placed, wanted.drop("_sf_lo", "_sf_from", "_sf_to"), [*by, "_sf_b"]).where(
        (F.col("_sf_rank") >= F.col("_sf_start")) & (F.col("_sf_rank") < F.col("_sf_end"))
    )
    low = F.max(F.when(F.col("_sf_rank") == F.col("_sf_k"), v))
    high = F.max(F.when(F.col("_sf_rank") == F.col("_sf_k") + 1, v))
    frac = F.max("_sf_pos") - F.max("_sf_k")
    between = F.when(frac == 0, low).otherwise(low + (F.coalesce(high, low) - low) * frac)
    return hit.groupBy(*by, "prob").agg(between.alias("quantile"))


def hash_cutoffs(
    df: DataFrame,
    quotas: DataFrame,
    by: Sequence[str],
    ids: Sequence[str],
    seed: int,
    cuts: Sequence[str],
    digits: int = 4,
) -> DataFrame:
    """One row per group: for every quota column in ``cuts`` the largest hash key inside the quota.

    ``quotas`` holds ``by`` and integer quota columns.  Rows are counted by the first ``digits`` hex
    digits of their key; only rows in the digit group where a quota ends are ranked, which is about
    1/16**digits of each group however skewed the groups are.  Ids must be unique.
    """
    by, cuts = list(by), list(cuts)
    keyed = df.select(*by, hash_key(seed, *ids).alias("_sf_key")).withColumn(
        "_sf_b", F.substring("_sf_key", 1, digits)
    )
    counts = keyed.groupBy(*by, "_sf_b").agg(F.count("*").alias("_sf_n"))
    upto = W.partitionBy(*by).orderBy("_sf_b").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_sf_hi", F.sum("_sf_n").over(upto))
    counts = counts.withColumn("_sf_lo", F.col("_sf_hi") - F.col("_sf_n"))
    if by:
        pairs = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).cast("bigint").alias("quota")) for c in cuts])
        long = quotas.select(*by, F.inline(pairs))
        joined = join_groups(counts, long, by)
    else:
        wanted = quotas.first()
        pairs = F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(int(wanted[c])).cast("bigint").alias("quota")) for c in cuts])
        joined = counts.select("*", F.inline(pairs))
    ends = joined.where((F.col("quota") > F.col("_sf_lo")) & (F.col("quota") <= F.col("_sf_hi"))).select(
        *by, "_sf_b", "cut", (F.col("quota") - F.col("_sf_lo")).alias("_sf_rank")
    )
    ends = bounded_side(ends)
    inside = W.partitionBy(*by, "cut", "_sf_b").orderBy("_sf_key")
    found = (
        join_groups(keyed, ends, [*by, "_sf_b"])
        .withColumn("_sf_rn", F.row_number().over(inside))
        .where(F.col("_sf_rn") == F.col("_sf_rank"))
    )
    keys = found.groupBy(*by).agg(*[F.max(F.when(F.col("cut") == c, F.col("_sf_key"))).alias(f"_sf_k_{c}") for c in cuts])

    # A quota of zero has no last row: the empty key admits nothing.  A quota beyond the group
    # size has none either: "~" sorts after every hex digit and admits the whole group.
    def edge(quota: Column) -> Column:
        return F.when(quota <= 0, F.lit("")).otherwise(F.lit("~"))

    if not by:
        return keys.select(*[F.coalesce(f"_sf_k_{c}", edge(F.lit(int(wanted[c])))).alias(c) for c in cuts])
    merged = join_groups(quotas.select(*by, *[edge(F.col(c)).alias(f"_sf_z_{c}") for c in cuts]), keys, by, "left")
    return merged.select(*by, *[F.coalesce(f"_sf_k_{c}", f"_sf_z_{c}").alias(c) for c in cuts])


def join_groups(df: DataFrame, side: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group columns in which null equals null; the columns of ``df`` come first."""
    by = list(by)
    names = {c: f"_sf_g_{i}" for i, c in enumerate(by)}
    right = side.select(*[F.col(f"`{c}`").alias(names[c]) for c in by], *[f"`{c}`" for c in side.columns if c not in names])
    condition = F.lit(True)
    for c in by:
        condition = condition & df[c].eqNullSafe(right[names[c]])
    return df.join(right, condition, how).drop(*names.values())


def attach(df: DataFrame, side: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group constants, null being a group like any other; a table without groups is one row of literals."""
    if by:
        return join_groups(df, bounded_side(side), by)
    row = side.first()
    return df.withColumns({c: F.lit(row[c]) for c in side.columns})
