"""Writers and stage caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import list_files


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def _write_note(spark: SparkSession, note: Mapping, path: str) -> None:
    spark.createDataFrame([(json.dumps(note, sort_keys=True, default=str),)], "value string").write.mode("overwrite").text(path)


def _read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_prepared(df: DataFrame, path: str, scaler: DataFrame | None = None, metadata: Mapping | None = None) -> str:
    """Rows partitioned by ``split``, so a stage that needs one split scans only that folder."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    if scaler is not None:
        scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    _write_note(df.sparkSession, metadata or {}, f"{path}/metadata")
    return path


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), _read_note(spark, f"{path}/metadata")


def write_feature_bundle(df: DataFrame, importance: DataFrame, path: str, summary: Mapping | None = None) -> str:
    """Reduced rows by split, the ranked importance table as CSV and a summary note."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    write_csv(importance.orderBy("rank"), f"{path}/importance")
    _write_note(df.sparkSession, summary or {}, f"{path}/summary")
    return path


def read_feature_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    rows = spark.read.parquet(f"{path}/rows")
    importance = spark.read.option("header", True).schema("idx int, feature string, score double, rank int").csv(f"{path}/importance")
    return rows, importance, _read_note(spark, f"{path}/summary")


def write_run(tables: Mapping[str, DataFrame], path: str, run_id: str) -> str:
    """Result tables of one run, each below ``<path>/<table>/run_id=<id>`` so histories scan as one table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")
    return path


def cache_key(spark: SparkSession, options: Mapping, inputs: Sequence[str] = ()) -> str:
    """16 hex digits over the options and the size and time of every input file."""
    prints = []
    for p in inputs:
        state = list_files(spark, p, "*").agg(
            F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("newest")
        ).first()
        prints.append([p, state["n"], state["bytes"], state["newest"]])
    text = json.dumps({"options": dict(options), "inputs": prints}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, options: Mapping, compute: Callable[[], DataFrame], inputs: Sequence[str] = ()) -> DataFrame:
    """The stored result for these options and inputs, computed and written when there is none.

    A marker is written after the data, so a stage that died half-way is never taken for complete.
    """
    path = f"{root.rstrip('/')}/stage-{cache_key(spark, options, inputs)}"
    try:
        spark.read.text(f"{path}/ready").first()
    except AnalysisException:
        compute().write.mode("overwrite").parquet(f"{path}/data")
        _write_note(spark, dict(options), f"{path}/ready")
    return spark.read.parquet(f"{path}/data")
