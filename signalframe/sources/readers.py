"""Readers: tables, directories, .npy samples, wide signal files, run histories, predictions."""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.clean import drop_missing_target, require_columns
from ..operators.ordering import attach
from ..operators.split import sample_stratified
from ..operators.waveform import long_features, wide_to_long

SCHEMAS = ("tabular", "waveform", "spectrum")
# Seed of the signal sample and columns that are unpivoted at once, where the caller gives none.
SEED, CHUNK = 42, 256


def check_schema(schema: str) -> str:
    if schema not in SCHEMAS:
        raise ValueError(f"unknown schema {schema!r}, expected one of {', '.join(SCHEMAS)}")
    return schema


def parse_source(source: str) -> tuple[str, dict[str, str]]:
    """("path", options) of "path::key=value::key=value"; parts without "=" are ignored."""
    path, *tail = str(source).split("::")
    pairs = [part.split("=", 1) for part in tail if "=" in part]
    return path, {k.strip().lower(): v.strip() for k, v in pairs if k.strip()}


def positive_int(text: str | None, default: int | None) -> int | None:
    """The number if it is a positive integer, else the default."""
    try:
        value = int(text) if text is not None else default
    except ValueError:
        return default
    return value if value is not None and value > 0 else default


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of matching files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header.

    Spark splits large files, so no value may hold a line break.  ``multiline=True`` reads quoted line breaks
    too and keeps each file in one task.  A ``schema`` saves the pass that infers one.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """One CSV or Parquet file or dataset, by its suffix."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, schema, multiline)
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def read_directory(spark: SparkSession, path: str, first_only: bool = False, multiline: bool = False) -> DataFrame:
    """All CSV files of a directory, or all Parquet files when there is no CSV.

    ``first_only`` reads just the alphabetically first file of that kind.
    """
    for pattern, read in (("*.csv", lambda s, p: read_csv(s, p, None, multiline)), ("*.parquet", lambda s, p: s.read.parquet(p))):
        first = list_files(spark, path, pattern).agg(F.min("path").alias("p")).first()["p"]
        if first is None:
            continue
        if first_only:
            return read(spark, first)
        if pattern == "*.csv":
            return read_csv(spark, f"{path.rstrip('/')}/*.csv", None, multiline)
        return spark.read.option("pathGlobFilter", pattern).parquet(path)
    raise ValueError(f"no CSV or Parquet file in {path}")


# --- .npy samples ----------------------------------------------------------------------------


def decode_npy(content: Column) -> Column:
    """Flattened ARRAY<DOUBLE> of .npy file bytes."""

    @F.pandas_udf("array<double>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.load(io.BytesIO(b), allow_pickle=False).astype(float).ravel())

    return decode(content)


def npy_samples(files: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(sample_id, label, features) from (path, content) rows.

    The label comes from ``labels`` (file, label) where the file is listed, else from the part of
    the file name before the first underscore.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.npy$", "")
    rows = files.select(name.alias("sample_id"), F.split(stem, "_")[0].alias("_sf_own"), decode_npy(F.col("content")).alias("features"))
    if labels is None:
        return rows.select("sample_id", F.col("_sf_own").alias("label"), "features")
    known = labels.select(F.col("file").alias("sample_id"), F.col("label").cast("string").alias("_sf_listed"))
    joined = rows.join(known, "sample_id", "left")
    return joined.select("sample_id", F.coalesce("_sf_listed", "_sf_own").alias("label"), "features")


def check_same_length(df: DataFrame, features: str = "features") -> int:
    """The common array length; an error when lengths differ."""
    ends = df.agg(F.min(F.size(features)).alias("lo"), F.max(F.size(features)).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no samples")
    if ends["lo"] != ends["hi"]:
        raise ValueError("all samples must have the same flattened length")
    return ends["lo"]


def read_npy_directory(spark: SparkSession, path: str) -> DataFrame:
    """One sample per .npy file, labelled by labels.csv or by file name; lengths must agree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    labels = None
    if not list_files(spark, path, "labels.csv").isEmpty():
        table = read_csv(spark, f"{path.rstrip('/')}/labels.csv")
        labels = table if {"file", "label"} <= set(table.columns) else None
    samples = npy_samples(files, labels)
    check_same_length(samples)
    return samples


# --- wide signal files -----------------------------------------------------------------------


def read_with_time(spark: SparkSession, path: str, columns: Sequence[str] | None = None, max_timesteps: int | None = None) -> DataFrame:
    """Parquet columns plus ``t``, the row number in file order.

    Later files continue the numbering of earlier ones (by path).  The row limit is a filter on the
    scan's own row index, applied before anything is unpivoted or shuffled.
    """
    raw = spark.read.parquet(path)
    wanted = [F.col(f"`{c}`") for c in (columns if columns is not None else raw.columns)]
    rows = raw.select(*wanted, F.col("_metadata.row_index").alias("_sf_row"), F.col("_metadata.file_path").alias("_sf_file"))
    files = sorted(raw.select("_metadata.file_path").inputFiles())
    if len(files) <= 1:
        out = rows.withColumnRenamed("_sf_row", "t").drop("_sf_file")
        return out.where(F.col("t") < max_timesteps) if max_timesteps else out
    counts = raw.select(F.col("_metadata.file_path").alias("_sf_file")).groupBy("_sf_file").agg(F.count("*").alias("n")).collect()
    start, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["_sf_file"]):
        offsets.append((r["_sf_file"], start))
        start += r["n"]
    table = spark.createDataFrame(offsets, "_sf_file string, _sf_start bigint")
    out = attach(rows, table, ["_sf_file"]).withColumn("t", F.col("_sf_row") + F.col("_sf_start"))
    out = out.drop("_sf_row", "_sf_file", "_sf_start")
    return out.where(F.col("t") < max_timesteps) if max_timesteps else out


def available_signals(spark: SparkSession, metadata: DataFrame, columns: Sequence[str], signal: str = "signal_id") -> DataFrame:
    """Metadata rows whose signal is a column of the wide file."""
    ids = spark.createDataFrame([(c,) for c in columns], "_sf_id string")
    return metadata.join(F.broadcast(ids), metadata[signal].cast("string") == ids["_sf_id"], "left_semi")


def select_signals(spark: SparkSession, path: str, metadata: DataFrame, target: str, max_signals: int | None = None,
                   seed: int = SEED, signal: str = "signal_id") -> DataFrame:
    """Metadata of the signals to read: present in the file, with a target, all of them or a stratified sample of ``max_signals``."""
    require_columns(metadata, [signal, target])
    present = drop_missing_target(available_signals(spark, metadata, spark.read.parquet(path).columns, signal), target)
    if present.isEmpty():
        raise ValueError("no signal of the metadata is a column of the file")
    return sample_stratified(present, [signal], target, max_signals, seed) if max_signals else present


def read_signals_long(spark: SparkSession, path: str, signals: Sequence[str], max_timesteps: int | None = None,
                      chunk: int = CHUNK, signal: str = "signal_id") -> DataFrame:
    """(signal, t, value) of the wanted columns only, all rows or the first ``max_timesteps``."""
    rows = read_with_time(spark, path, signals, max_timesteps)
    return wide_to_long(rows, list(signals), "t", signal, chunk)


def read_signal_table(spark: SparkSession, path: str, metadata: DataFrame, target: str, options: dict[str, str] | None = None,
                      signal: str = "signal_id") -> DataFrame:
    """Metadata joined with the 20 features of each selected signal.

    All signals and rows are read unless the options ``max_signals`` and ``max_timesteps`` limit them.  Quota and
    column choice come first, so only selected columns are scanned.
    """
    o = options or {}
    steps = positive_int(o.get("max_timesteps"), None)
    chosen = select_signals(spark, path, metadata, target, positive_int(o.get("max_signals"), None),
                            positive_int(o.get("seed"), SEED), signal)
    ids = sorted(str(r[0]) for r in chosen.select(signal).collect())  # names of columns
    long = read_signals_long(spark, path, ids, steps, positive_int(o.get("signal_chunk_size"), CHUNK), signal)
    length = long.agg(F.max("t").alias("t")).first()["t"]
    length = 0 if length is None else length + 1
    if length < 2:
        raise ValueError("signals need at least two timesteps")
    features = long_features(long, length, signal, signals=len(ids))
    keyed = chosen.withColumn(signal, F.col(signal).cast("string"))
    return keyed.join(features, signal)


# --- run histories and predictions -----------------------------------------------------------


def _plain(path: str) -> str:
    """A path without scheme and host."""
    return re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", path).rstrip("/")


def _scan_directories(spark: SparkSession, directories: Sequence[str], names: Sequence[str]) -> DataFrame | None:
    """(origin, position, name, file, text) of the files or dataset folders ``names`` in all directories, whole files, by one scan.

    ``origin`` is the directory as given.  Directories without any of the files are skipped; None when all are.
    """
    found = list(dict.fromkeys(d.rstrip("/") for d in directories))
    if not found:
        return None
    root = found[0] if len(found) == 1 else os.path.commonprefix([d + "/" for d in found]).rpartition("/")[0]
    quoted = [re.sub(r"([\\{},*?\[\]])", r"\\\1", d[len(root):].lstrip("/")) for d in found]
    base = re.sub(r"([\\{},*?\[\]])", r"\\\1", root)
    inner = f"/{{{','.join(quoted)}}}" if len(found) > 1 else ""
    try:
        raw = spark.read.text(f"{base}{inner}/{{{','.join(names)}}}", wholetext=True)
    except AnalysisException:
        return None
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    path = F.regexp_replace(path, r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "")
    place = "|".join(re.escape(n) for n in names)
    rows = raw.select(F.col("value").alias("text"), F.regexp_extract(path, rf"^(.*)/(?:{place})(?:/[^/]*)?$", 1).alias("_sf_dir"),
                      F.regexp_extract(path, rf"^.*/({place})(?:/[^/]*)?$", 1).alias("name"), path.alias("file"))
    origins = spark.createDataFrame([(_plain(d), i, d) for i, d in enumerate(found)], "_sf_dir string, position int, origin string")
    return rows.join(origins, "_sf_dir").select("origin", "position", "name", "file", "text")


def _csv_rows(text: Column) -> Column:
    """The rows of whole CSV files as maps by column name; empty cells are null."""
    def rows(one: str) -> list[dict]:
        lines = csv.reader(io.StringIO(one))
        header = next(lines, [])
        return [{c: (v if v != "" else None) for c, v in zip(header, line)} for line in lines if line]

    @F.pandas_udf("array<map<string,string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(rows)

    return parse(text)


def read_run_maps(spark: SparkSession, directories: Sequence[str], name: str = "benchmark_metrics.csv") -> DataFrame | None:
    """(benchmark_dir, position, values) of all run tables: a map per row, whatever its columns; nothing is read until it is used."""
    files = _scan_directories(spark, directories, [name])
    if files is None:
        return None
    return files.select(F.col("origin").alias("benchmark_dir"), "position", "file", F.posexplode(_csv_rows(F.col("text"))).alias("row", "values"))


def read_run_histories(spark: SparkSession, directories: Sequence[str], name: str = "benchmark_metrics.csv",
                       fields: Sequence[tuple[str, str]] | None = None) -> DataFrame | None:
    """All run tables below one another with their ``benchmark_dir``; columns may differ.

    Any number of directories is one scan, plus one that finds the columns and their types (long, double, boolean, else text)
    unless ``fields`` (name, type) are given.  Directories without the file, or with an empty one, are skipped; None when nothing is left.
    """
    maps = read_run_maps(spark, directories, name)
    if maps is None:
        return None
    if fields is None:
        cells = maps.select("position", "file", F.posexplode("values").alias("place", "column", "value"))
        fits = lambda kind: F.bool_and(F.col("value").isNull() | F.col("value").try_cast(kind).isNotNull())
        seen = cells.groupBy("column").agg(F.min(F.struct("position", "file", "place")).alias("first"), fits("bigint").alias("bigint"), fits("double").alias("double"),
                                           fits("boolean").alias("boolean"), F.bool_or(F.col("value").isNotNull()).alias("any")).orderBy("first").collect()
        if not seen:
            return None
        fields = [(r["column"], next((k for k in ("bigint", "double", "boolean") if r["any"] and r[k]), "string")) for r in seen]
    return maps.select(*(F.col("values")[c].try_cast(kind).alias(c) for c, kind in fields), "benchmark_dir")


def read_run_records(spark: SparkSession, directories: Sequence[str]) -> DataFrame | None:
    """(origin, metrics, config) texts of run directories, from one scan: ``metrics.json`` beside ``run_config.yaml``; a missing file is null."""
    files = _scan_directories(spark, directories, ["metrics.json", "run_config.yaml"])
    if files is None:
        return None
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("text")))
    return files.groupBy("origin").agg(pick("metrics.json").alias("metrics"), pick("run_config.yaml").alias("config"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions with integer codes; rows marked as unlabelled are left out."""
    df = read_csv(spark, path) if not path.endswith((".parquet", ".pq")) else spark.read.parquet(path)
    require_columns(df, ["y_true", "y_pred"])
    df = df.withColumns({"y_true": F.col("y_true").cast("int"), "y_pred": F.col("y_pred").cast("int")})
    if "is_labeled" in df.columns:
        df = df.where(F.col("is_labeled").cast("boolean"))
    return df
