"""Train/validation/test splits, folds and quota samples.

Quotas follow the half-even rounding rules exactly.  Which rows fill a quota is decided by the
md5 order of (seed, id), so the result does not depend on partitioning.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import fine_uniform_of, hash_key, poisson1_of
from ..functions.numeric import half_even
from .ordering import attach, hash_cutoffs, join_groups


def split_sizes(n: int, train_ratio: float, val_ratio: float) -> tuple[int, int, int]:
    """Row counts of the three parts; raises when a part would be empty."""
    if not 0 < train_ratio < 1 or not 0 <= val_ratio < 1:
        raise ValueError("train_ratio must lie in (0, 1) and val_ratio in [0, 1)")
    if train_ratio + val_ratio >= 1:
        raise ValueError("train_ratio + val_ratio must stay below 1")
    train = max(1, min(round(n * train_ratio), n - 2))
    val = max(1, min(round(n * val_ratio), n - train - 1))
    if n - train - val <= 0:
        raise ValueError("the test part would be empty")
    return train, val, n - train - val


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_quotas(counts: DataFrame, label: str, total: int, n_train: int, n_val: int) -> DataFrame:
    """Per class the last rank of the train part and of the validation part."""
    n = F.col("n")
    scaled = n.cast("double")
    val = F.greatest(F.lit(1).cast("bigint"), half_even(scaled * n_val / total))
    train = F.greatest(F.lit(1).cast("bigint"), half_even(scaled * n_train / total))
    train = F.when(n - train - val <= 0, F.greatest(n - val - 1, F.lit(0))).otherwise(train)
    return counts.select(label, "n", train.alias("train_end"), (train + val).alias("val_end"))


def split_plan(df: DataFrame, label: str | None, train_ratio: float, val_ratio: float) -> tuple[DataFrame, list[str]]:
    """Quota table and its grouping columns: per class, or one row when classes are too small."""
    spark = df.sparkSession
    if label is not None:
        counts = _class_counts(df, label)
        s = counts.agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.min("n").alias("least")).first()
        n_train, n_val, _ = split_sizes(s["n"] or 0, train_ratio, val_ratio)
        if s["classes"] >= 2 and s["least"] >= 3:
            return class_quotas(counts, label, s["n"], n_train, n_val), [label]
        total = s["n"]
    else:
        total = df.count()
        n_train, n_val, _ = split_sizes(total, train_ratio, val_ratio)
    row = [(total, n_train, n_train + n_val)]
    return spark.createDataFrame(row, "n bigint, train_end bigint, val_end bigint"), []


def _by_cuts(df: DataFrame, plan: DataFrame, by: list[str], ids: Sequence[str], seed: int) -> DataFrame:
    cuts = hash_cutoffs(df, plan, by, ids, seed, ["train_end", "val_end"])
    key = hash_key(seed, *ids)
    part = F.when(key <= F.col("train_end"), "train").when(key <= F.col("val_end"), "val").otherwise("test")
    return attach(df, cuts, by).withColumn("split", part).drop("train_end", "val_end")


def split_rows(
    df: DataFrame,
    ids: Sequence[str],
    label: str | None = None,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train, val, test), stratified by ``label`` where every class has three rows."""
    plan, by = split_plan(df, label, train_ratio, val_ratio)
    return _by_cuts(df, plan, by, ids, seed)


def split_missing_aware(
    df: DataFrame,
    ids: Sequence[str],
    any_missing: Column,
    label: str | None = None,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Like ``split_rows``, but with three or more incomplete rows each part gets one of them.

    The parts keep the sizes of the plain split; all other rows fill them in hash order, without
    stratification.
    """
    plan, by = split_plan(df, label, train_ratio, val_ratio)
    key = hash_key(seed, *ids)
    firsts = [r[0] for r in df.where(any_missing).select(key.alias("k")).orderBy("k").limit(3).collect()]
    if len(firsts) < 3:
        return _by_cuts(df, plan, by, ids, seed)
    size = plan.agg(F.sum("train_end").alias("t"), F.sum("val_end").alias("v")).first()
    rest = df.where(~key.isin(firsts))
    ends = df.sparkSession.createDataFrame(
        [(int(size["t"]) - 1, int(size["v"]) - 2)], "train_end bigint, val_end bigint"
    )
    cut = hash_cutoffs(rest, ends, [], ids, seed, ["train_end", "val_end"]).first()
    part = (
        F.when(key == firsts[0], "train").when(key == firsts[1], "val").when(key == firsts[2], "test")
        .when(key <= F.lit(cut["train_end"]), "train").when(key <= F.lit(cut["val_end"]), "val")
        .otherwise("test")
    )
    return df.withColumn("split", part)


def fold_rows(df: DataFrame, ids: Sequence[str], label: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1, with the rows of every class spread evenly over the folds."""
    ends = [f"end_{j}" for j in range(1, k)]
    n = F.col("n")
    plan = _class_counts(df, label).select(
        label, *[(F.floor(n / k) * j + F.least(n % k, F.lit(j))).cast("bigint").alias(f"end_{j}") for j in range(1, k)]
    )
    cuts = hash_cutoffs(df, plan, [label], ids, seed, ends)
    key = hash_key(seed, *ids)
    fold = F.lit(0)
    for c in ends:
        fold = fold + (key > F.col(c)).cast("int")
    return attach(df, cuts, [label]).withColumn("fold", fold).drop(*ends)


def holdout_rows(df: DataFrame, ids: Sequence[str], label: str, ratio: float, seed: int) -> DataFrame:
    """Add ``part`` (train, val): per class max(1, half-even(n * ratio)) rows are held out."""
    quota = F.least(F.greatest(F.lit(1).cast("bigint"), half_even(F.col("n") * F.lit(ratio))), F.col("n") - 1)
    plan = _class_counts(df, label).select(label, quota.alias("held"))
    cuts = hash_cutoffs(df, plan, [label], ids, seed, ["held"])
    part = F.when(hash_key(seed, *ids) <= F.col("held"), "val").otherwise("train")
    return attach(df, cuts, [label]).withColumn("part", part).drop("held")


def fraction_rows(df: DataFrame, ids: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """The first max(2, half-even(n * fraction)) rows in hash order."""
    quota = max(2, round(df.count() * fraction))
    plan = df.sparkSession.createDataFrame([(quota,)], "quota bigint")
    cut = hash_cutoffs(df, plan, [], ids, seed, ["quota"]).first()["quota"]
    return df.where(hash_key(seed, *ids) <= F.lit(cut))


def sample_quotas(counts: Sequence[int], wanted: int) -> list[int]:
    """Rows to take per class so that the total is exactly ``wanted`` where possible.

    Starts from half-even proportional shares (at least one), then takes from the largest share or
    gives to the class with most rows left, first class on ties.
    """
    total = sum(counts)
    if wanted >= total:
        return list(counts)
    take = [min(c, max(1, round(wanted * c / total))) for c in counts]
    gap = wanted - sum(take)
    step = 1 if gap > 0 else -1
    room = (lambda i: counts[i] - take[i]) if gap > 0 else (lambda i: take[i] - 1)
    size = room if gap > 0 else (lambda i: take[i])
    heap = [(-size(i), i) for i in range(len(take)) if room(i) > 0]
    heapq.heapify(heap)
    while gap and heap:
        _, i = heapq.heappop(heap)
        take[i] += step
        gap -= step
        if room(i) > 0:
            heapq.heappush(heap, (-size(i), i))
    return take


def sample_stratified(df: DataFrame, ids: Sequence[str], label: str, wanted: int, seed: int = 42,
                      max_classes: int = 100_000) -> DataFrame:
    """``wanted`` rows in class proportion; the whole frame when it has no more than that."""
    rows = _class_counts(df, label).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    if wanted >= sum(r["n"] for r in rows):
        return df
    quota = sample_quotas([r["n"] for r in rows], wanted)
    kind = dict(df.dtypes)[label]
    group = F.col(label)
    plan = df.sparkSession.createDataFrame(
        [(r[0], q) for r, q in zip(rows, quota)], f"`{label}` {kind}, quota bigint"
    )
    # Null is a class of its own here, so the join runs on a non-null rendering of the label.
    tag = F.coalesce(group.cast("string"), F.lit("\u0000null"))
    tagged = df.withColumn("_sf_class", tag)
    plan = plan.select(tag.alias("_sf_class"), "quota")
    cuts = hash_cutoffs(tagged, plan, ["_sf_class"], ids, seed, ["quota"])
    return (
        attach(tagged, cuts, ["_sf_class"])
        .where(hash_key(seed, *ids) <= F.col("quota")).drop("_sf_class", "quota")
    )


def ranked_rows(df: DataFrame, ids: Sequence[str], seed: int | str | Column, by: Sequence[str] = (), column: str = "rank", digits: int = 4) -> DataFrame:
    """Add ``rank``, the place from 0 of each row in the md5 order of its group.

    Rows are counted by the first hex digits of their key; running totals of those counts give the place of each digit
    group, and only the rows inside one, about 1/16**digits of a group, are ordered with each other.
    """
    by = list(by)
    keyed = df.withColumn("_sf_key", hash_key(seed, *ids)).withColumn("_sf_b", F.substring("_sf_key", 1, digits))
    ahead = Window.partitionBy(*by).orderBy("_sf_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_sf_b").agg(F.count("*").alias("_sf_n")).withColumn("_sf_at", F.coalesce(F.sum("_sf_n").over(ahead), F.lit(0))).drop("_sf_n")
    inside = Window.partitionBy(*by, "_sf_b").orderBy("_sf_key", *ids)
    placed = join_groups(keyed.withColumn("_sf_rn", F.row_number().over(inside)), counts, [*by, "_sf_b"])
    return placed.withColumn(column, F.col("_sf_at") + F.col("_sf_rn") - 1).drop("_sf_key", "_sf_b", "_sf_rn", "_sf_at")


def _draws(spark, n: int, seed: int | str, even: bool) -> DataFrame:
    """``draw`` 0..n-1 with ``u`` in [0, 1), from md5 of (seed, draw); ``even``: draw t inside [t / n, (t + 1) / n)."""
    u = fine_uniform_of(hash_key(seed, F.col("draw")))
    rows = spark.range(n).withColumnRenamed("id", "draw")
    return rows.withColumn("u", (F.col("draw") + u) / F.lit(float(max(n, 1))) if even else u)


def _located(n: int) -> Column:
    """The row that a uniform falls on, of n rows of equal weight."""
    return F.least(F.floor(F.col("u") * F.lit(float(n))), F.lit(n - 1)).alias("_sf_rank")


def resampled_counts(df: DataFrame, ids: Sequence[str], seed: int | str, column: str = "draws") -> DataFrame:
    """How often each row enters a bootstrap resample of exactly as many rows, drawn independently with replacement."""
    n = df.count()
    hits = _draws(df.sparkSession, n, seed, False)
    hits = hits.groupBy(_located(n)).agg(F.count("*").alias("_sf_hits"))
    rows = ranked_rows(df, ids, seed, column="_sf_rank").join(hits, "_sf_rank", "left")
    return rows.withColumn(column, F.coalesce("_sf_hits", F.lit(0)).cast("int")).drop("_sf_rank", "_sf_hits")


def resampled_bags(df: DataFrame, ids: Sequence[str], seed: int, bags: int, column: str = "draws") -> DataFrame:
    """``column``: an array with the counts of ``bags`` resamples; bag b is ``resampled_counts`` with seed "seed-b".

    Only ids are copied per bag, and all bags are ranked and drawn together.
    """
    n, ids = df.count(), list(ids)
    bag = F.concat(F.lit(f"{seed}-"), F.col("_sf_bag").cast("string"))
    draws = df.sparkSession.range(n * bags).select((F.col("id") % bags).cast("int").alias("_sf_bag"), F.floor(F.col("id") / bags).alias("draw"))
    draws = draws.withColumn("u", fine_uniform_of(hash_key(bag, F.col("draw"))))
    hits = draws.groupBy("_sf_bag", _located(n)).agg(F.count("*").alias("_sf_hits"))
    copies = df.select(*ids, F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("_sf_bag"))
    drawn = ranked_rows(copies, ids, bag, ["_sf_bag"], "_sf_rank").join(hits, ["_sf_bag", "_sf_rank"])
    per = drawn.groupBy(*ids).agg(F.array(*(F.coalesce(F.max(F.when(F.col("_sf_bag") == b, F.col("_sf_hits"))), F.lit(0)).cast("int") for b in range(bags))).alias("_sf_per"))
    return join_groups(df, per, ids, "left").withColumn(column, F.coalesce("_sf_per", F.lit([0] * bags).cast("array<int>"))).drop("_sf_per")


def balanced_resample(df: DataFrame, ids: Sequence[str], label: str, seed: int, n: int | None = None, even: bool = False, max_classes: int = 100_000) -> DataFrame:
    """``n`` rows (as many as there are) drawn with replacement, every class as likely as any other: all columns and ``draw``.

    Weights 1 / (classes * class size) laid end to end, class after class, make one interval per row.  A draw's uniform falls
    into a class, and within it on a row by its rank, so classes of any size are located by an equal join.  ``even`` spreads the uniforms
    so that every class gets its share to within one draw.
    """
    spark = df.sparkSession
    counts = _class_counts(df, label).limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    counts.sort(key=lambda r: (r[0] is None, r[0]))
    kind = df.select(label).schema[0].dataType.simpleString()
    named = spark.createDataFrame([(i, r[0], r["n"]) for i, r in enumerate(counts)], f"_sf_class bigint, `{label}` {kind}, _sf_n bigint")
    total, classes = sum(r["n"] for r in counts), len(counts)
    place = F.col("u") * F.lit(float(classes))
    draws = _draws(spark, total if n is None else n if classes else 0, seed, even).withColumn("_sf_class", F.least(F.floor(place), F.lit(classes - 1)))
    draws = draws.join(named.select("_sf_class", "_sf_n"), "_sf_class")
    rank = F.least(F.floor((place - F.col("_sf_class")) * F.col("_sf_n")), F.col("_sf_n") - 1)
    tagged = join_groups(df, named.select(label, "_sf_class"), [label])
    rows = ranked_rows(tagged, ids, seed, ["_sf_class"], "_sf_rank")
    return draws.select("draw", "_sf_class", rank.alias("_sf_rank")).join(rows, ["_sf_class", "_sf_rank"]).select(*df.columns, "draw")


def bootstrap_counts(df: DataFrame, ids: Sequence[str], seed: int, column: str = "draws") -> DataFrame:
    """How often each row enters a bootstrap resample (independent Poisson(1) draws)."""
    return df.withColumn(column, poisson1_of(hash_key(seed, *ids)))


def bootstrap_rows(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """The resample itself: each row repeated by its draw count."""
    drawn = bootstrap_counts(df, ids, seed, "_sf_draws").where(F.col("_sf_draws") > 0)
    return drawn.withColumn("_sf_copy", F.explode(F.sequence(F.lit(1), F.col("_sf_draws")))).drop("_sf_draws", "_sf_copy")


def class_weights(df: DataFrame, label: str, kind: str = "balanced") -> DataFrame:
    """(label, n, weight): N / (classes * n) for "balanced", 1 / n for "inverse"."""
    counts = _class_counts(df, label)
    if kind == "inverse":
        return counts.withColumn("weight", 1.0 / F.col("n"))
    if kind != "balanced":
        raise ValueError("kind must be 'balanced' or 'inverse'")
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("c"))
    per = total.select((F.col("t").cast("double") / F.col("c")).alias("share")).scalar()
    return counts.withColumn("weight", per / F.col("n"))


def with_class_weights(df: DataFrame, label: str, kind: str = "balanced") -> DataFrame:
    """Attach ``weight`` to every row."""
    return attach(df, class_weights(df, label, kind).select(label, "weight"), [label])
