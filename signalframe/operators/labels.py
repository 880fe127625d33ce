"""Label encoding and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import is_missing
from .ordering import SMALL_ROWS, attach, bounded_side, running_sums
from .spec import is_numeric


def _label(df: DataFrame, column: str) -> Column:
    """Label value: numbers keep null for missing (and NaN), texts call it "missing"."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind in ("float", "double"):
        return F.when(~F.isnan(c), c)
    return c if is_numeric(kind) else F.coalesce(c.cast("string"), F.lit("missing"))


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct labels numbered from 0.

    A small label set is numbered in one ordered window.  A larger one is numbered by bucketed
    running sums, so no task holds all of it.
    """
    values = df.select(_label(df, column).alias("value")).where("value IS NOT NULL").distinct()
    rows = values.limit(SMALL_ROWS + 1).collect()
    if len(rows) <= SMALL_ROWS:
        spark = df.sparkSession
        kind = values.schema["value"].dataType.simpleString()
        known = sorted(r["value"] for r in rows)
        return spark.createDataFrame(list(zip(known, range(len(known)))), f"value {kind}, code int")
    numbered = running_sums(values.withColumn("one", F.lit(1)), "value", ["one"])
    return numbered.select("value", (F.col("cum_one") - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, column: str, out: str = "y") -> DataFrame:
    """Codes of a single target; rows with a missing number are dropped, null text is a class."""
    table = label_table(df, column).select(F.col("value").alias("_sf_value"), F.col("code").alias(out))
    keyed = df.withColumn("_sf_value", _label(df, column))
    return attach(keyed.where(F.col("_sf_value").isNotNull()), table, ["_sf_value"]).drop("_sf_value")


def encode_task(df: DataFrame, column: str, task: str | None = None) -> DataFrame:
    """Add ``y_<task>`` (-1 where missing) and ``missing_<task>``."""
    task = task or column
    kind = dict(df.dtypes)[column]
    table = label_table(df, column).select(F.col("value").alias("_sf_value"), F.col("code").alias("_sf_code"))
    keyed = df.withColumn("_sf_value", _label(df, column))
    joined = keyed.join(bounded_side(table), "_sf_value", "left")
    return joined.withColumns({
        f"y_{task}": F.coalesce("_sf_code", F.lit(-1)),
        f"missing_{task}": F.col("_sf_value").isNull() if is_numeric(kind) else F.lit(False),
    }).drop("_sf_value", "_sf_code")


def encode_tasks(df: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """``encode_task`` for every {task: column}."""
    for task, column in tasks.items():
        df = encode_task(df, column, task)
    return df


def any_task_missing(tasks: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in tasks:
        out = out | F.col(f"missing_{t}")
    return out


def tasks_long(df: DataFrame, ids: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """(ids..., task, y, missing): one row per sample and task."""
    cells = [F.struct(F.lit(t).alias("task"), F.col(f"y_{t}").alias("y"), F.col(f"missing_{t}").alias("missing")) for t in tasks]
    return df.select(*ids, F.inline(F.array(*cells)))


def normalize_code(y: Column, floating: bool = False) -> Column:
    """-1 for null, NaN and negative codes."""
    return F.when(is_missing(y, floating) | (y < 0), F.lit(-1)).otherwise(y.cast("int"))


def class_counts_per_task(long: DataFrame, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """(task, classes): largest valid code in the fitting splits, plus one."""
    seen = long.where(F.col("split").isin(list(splits)) & (F.col("y") >= 0))
    return seen.groupBy("task").agg((F.max("y") + 1).alias("classes"))


def decode_labels(df: DataFrame, code: str, table: DataFrame, out: str) -> DataFrame:
    """Label text of a code; a code outside the table is shown as its number."""
    names = table.select(F.col("code").alias(code), F.col("value").cast("string").alias("_sf_name"))
    joined = df.join(bounded_side(names), code, "left")
    return joined.withColumn(out, F.coalesce("_sf_name", F.col(code).cast("string"))).drop("_sf_name")


def rename_tasks(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the code and mask columns of tasks: {old task: new task}."""
    renames = {f"{kind}_{old}": f"{kind}_{new}" for old, new in mapping.items() for kind in ("y", "missing")}
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
