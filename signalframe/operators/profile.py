"""Profiles of datasets and of class-conditional behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import is_missing
from .ordering import exact_quantiles, join_groups
from .spec import as_number


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def missing_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(missing_values, missing_ratio) over all cells of the columns, NaN included; one pass."""
    kinds = dict(df.dtypes)
    cells = [is_missing(f"`{c}`", kinds[c] in ("float", "double")).cast("bigint") for c in columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    counted = df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("missing_values"), (F.count("*") * len(columns)).alias("cells"))
    ratio = F.coalesce(F.try_divide(F.col("missing_values").cast("double"), F.col("cells")), F.lit(0.0))
    return counted.select("missing_values", ratio.alias("missing_ratio"))


def dataset_statistics(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(metric, value): sample and feature counts, missing cells, and one class_count[x] per class."""
    wide = missing_cells(df, features)
    rows = df.agg(F.count("*").alias("n"))
    head = rows.select(F.inline(F.array(
        F.struct(F.lit("samples").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("features").alias("metric"), F.lit(float(len(features))).alias("value")),
    )))
    gaps = wide.select(F.inline(F.array(
        F.struct(F.lit("missing_values").alias("metric"), F.col("missing_values").cast("double").alias("value")),
        F.struct(F.lit("missing_ratio").alias("metric"), F.col("missing_ratio").alias("value")),
    )))
    name = F.coalesce(F.col(label).cast("string"), F.lit("missing"))
    per = df.groupBy(name.alias("c")).agg(F.count("*").cast("double").alias("value"))
    classes = per.select(F.concat(F.lit("class_count["), "c", F.lit("]")).alias("metric"), "value")
    return head.unionByName(gaps).unionByName(classes)


def category_crosstab(df: DataFrame, category: str, label: str, classes: Sequence) -> DataFrame:
    """(category, class_<c>..., exclusive): rows per class, and whether some class never occurs with it.

    One conditional sum per class instead of a pivot: the same partial aggregation, one shuffle.
    """
    named = F.coalesce(F.col(category).cast("string"), F.lit("missing")).alias("category")
    counts = df.groupBy(named).agg(*[F.count_if(F.col(label) == F.lit(c)).alias(f"class_{c}") for c in classes])
    least = F.least(*[F.col(f"class_{c}") for c in classes]) if len(classes) > 1 else F.col(f"class_{classes[0]}")
    return counts.withColumn("exclusive", least == 0)


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[Column | str]) -> DataFrame:
    """(keep..., feature, x) with one row per present value."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("feature"), as_number(c, kinds[c]).alias("x")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells))).where("x IS NOT NULL")


def class_describe(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(label, feature, n, mean, std, min, max, median, constant, all_zero) per class; sample std."""
    long = long_numbers(df, columns, [label])
    stats = long.groupBy(label, "feature").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    median = exact_quantiles(long, "x", [0.5], [label, "feature"]).select(label, "feature", F.col("quantile").alias("median"))
    return join_groups(stats, median, [label, "feature"]).withColumns({
        "constant": F.col("min") == F.col("max"),
        "all_zero": (F.col("min") == 0) & (F.col("max") == 0),
    })


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null instead of an error for constant input."""
    x, y = x.cast("double"), y.cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_ranking(df: DataFrame, columns: Sequence[str], target: str, least: int = 10) -> DataFrame:
    """(feature, r, n) for columns with at least ``least`` values that vary, strongest first."""
    long = long_numbers(df.where(F.col(target).isNotNull()), columns, [target])
    r = long.groupBy("feature").agg(safe_corr(F.col("x"), F.col(target)).alias("r"), F.count("*").alias("n"))
    return r.where((F.col("n") >= least) & F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "feature")


def element_correlations(df: DataFrame, array: str, target: str, top: int | None = 20) -> DataFrame:
    """(pos, r): correlation of every array element with the target, strongest first."""
    long = df.select(F.col(target).cast("double").alias("y"), F.posexplode(array).alias("pos", "x"))
    r = long.groupBy("pos").agg(safe_corr(F.col("x"), F.col("y")).alias("r")).where("r IS NOT NULL")
    r = r.orderBy(F.desc(F.abs("r")), "pos")
    return r if top is None else r.limit(top)


def cohens_d(df: DataFrame, columns: Sequence[str], label: str, one, zero) -> DataFrame:
    """(feature, d): standardised distance between the means of two classes, population spread."""
    long = long_numbers(df.where(F.col(label).isin([one, zero])), columns, [label])
    is_one, x = F.col(label) == F.lit(one), F.col("x")
    g = long.groupBy("feature").agg(
        F.avg(F.when(is_one, x)).alias("m1"), F.avg(F.when(~is_one, x)).alias("m0"),
        F.var_pop(F.when(is_one, x)).alias("v1"), F.var_pop(F.when(~is_one, x)).alias("v0"),
    )
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2.0)
    return g.select("feature", F.try_divide(F.abs(F.col("m1") - F.col("m0")), pooled).alias("d"))


def length_profile(df: DataFrame, array: Column) -> DataFrame:
    """(min_len, max_len, mean_len, distinct_len, mode_len, is_square) of an array column."""
    sizes = df.select(F.size(array).alias("s")).where("s >= 0").groupBy("s").agg(F.count("*").alias("n"))
    out = sizes.agg(
        F.min("s").alias("min_len"), F.max("s").alias("max_len"),
        (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean_len"),
        F.count("*").alias("distinct_len"), F.max_by("s", F.struct("n", -F.col("s"))).alias("mode_len"),
    )
    root = F.round(F.sqrt("mode_len")).cast("int")
    return out.withColumn("is_square", root * root == F.col("mode_len"))


def majority_rate(df: DataFrame, label: str) -> DataFrame:
    """One row ``rate``: share of the largest class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.try_divide(F.max("n").cast("double"), F.sum("n")).alias("rate"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): distinct non-null values, one row each, so no list has to fit in a task."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n)."""
    return distinct_values(df, columns).groupBy("column").agg(F.count("*").alias("n"))
