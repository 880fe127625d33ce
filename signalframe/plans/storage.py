"""Source and sink queries: tables go out to the shared folder and come back."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import evaluate as ev
from ..operators import waveform
from ..operators.rank import keep_features, ranked, top_features
from ..session import work_path
from ..operators import runs
from ..sources import npy, readers, sinks
from .frames import SQL_CELLS, SQL_FISHER, SQL_RUNS, SQL_SCALED, SQL_TASKS, run_table, scored_documents, table, task_predictions, vectors
from .evaluation import SQL_SUMMARY
from .ranking import scaled_vectors, vector_scores
from .registry import query
from .signals import _TIME_SQL

PART_COLS = "p_partkey, p_name, p_brand, p_size, p_retailprice"


@query("csv_scan", "SRC-1 SNK-3", f"SELECT {PART_COLS} FROM part")
def csv_scan(spark, d):
    path = sinks.write_csv(table(spark, d, "part").select(*PART_COLS.split(", ")), work_path(spark, "part"))
    return readers.read_csv(spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double", multiline=False)


@query("csv_scan_inferred", "SRC-1", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_scan_inferred(spark, d):
    path = sinks.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), work_path(spark, "orders"))
    return readers.read_csv(spark, path, multiline=False).groupBy("o_orderstatus").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("parquet_scan", "SRC-2", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL")
def parquet_scan(spark, d):
    li = readers.read_table(spark, f"{d}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("directory_scan", "SRC-3", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def directory_scan(spark, d):
    path = work_path(spark, "nation")
    table(spark, d, "nation").repartition(3, "n_nationkey").write.parquet(path)
    return readers.read_directory(spark, path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("npy_samples", "SRC-4 JON-3",
       f"""WITH {SQL_CELLS} SELECT label || '_wave_' || vec_id || '.npy' AS sample_id, CASE WHEN vec_id % 3 = 0 THEN 'listed' ELSE CAST(label AS VARCHAR) END AS label,
64 AS n, round(sum(v), 5) + 0.0 AS total FROM cells GROUP BY vec_id, cells.label""")
def npy_samples(spark, d):
    """Vectors as .npy bytes, read like files; a third of them is listed in the label table."""

    @F.pandas_udf("binary")
    def encode(arrays: pd.Series) -> pd.Series:
        def one(a):
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(a, dtype=float).reshape(8, -1))
            return buffer.getvalue()

        return arrays.map(one)

    name = F.concat("label", F.lit("_wave_"), "vec_id", F.lit(".npy"))
    v = vectors(spark, d).select(F.concat(F.lit("dir/"), name).alias("path"), encode("features").alias("content"))
    listed = vectors(spark, d).where("vec_id % 3 = 0").select(name.alias("file"), F.lit("listed").alias("label"))
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return readers.npy_samples(v, listed).select("sample_id", "label", F.size("features").alias("n"), rounded(total, 5).alias("total"))


SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL_LONG = f"""wide AS (SELECT *, row_number() OVER () - 1 AS t FROM lineitem),
long AS (SELECT signal_id, t, v FROM (SELECT t, {', '.join(f'{s}::DOUBLE AS {s}' for s in SIGNALS)} FROM wide) UNPIVOT (v FOR signal_id IN ({', '.join(SIGNALS)})))"""


def signal_metadata(spark, d):
    """One row per possible signal: four columns of the item table, one unknown, one without a target."""
    li = table(spark, d, "lineitem").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    cells = [F.struct(F.lit(s).alias("signal_id"), (F.col(c) > 1).cast("double").alias("target")) for s, c in zip(SIGNALS, "qpdt")]
    extra = [F.struct(F.lit("no_such_column").alias("signal_id"), F.lit(1.0).alias("target")),
             F.struct(F.lit("l_linenumber").alias("signal_id"), F.lit(None).cast("double").alias("target"))]
    return li.select(F.inline(F.array(*cells, *extra)))


@query("wide_signals", "SRC-5 SRC-6 JON-1 JON-2",
       f"""WITH {SQL_LONG}, p AS (SELECT *, lag(v) OVER (PARTITION BY signal_id ORDER BY t) AS p FROM long)
SELECT signal_id, CASE WHEN avg(v) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS target, count(*) AS n, {', '.join(f'round({_TIME_SQL[k]}, 4) + 0.0 AS stat_{k}' for k in waveform.TIME_STATS)},
round(avg(abs(v - p)), 4) AS variation FROM p GROUP BY signal_id""")
def wide_signals(spark, d):
    """Columns of the item file read as signals over row number: selected, sampled, unpivoted, joined."""
    path = f"{d}/lineitem.parquet"
    chosen = readers.select_signals(spark, path, signal_metadata(spark, d), "target")
    ids = sorted(r[0] for r in chosen.select("signal_id").collect())
    long = readers.read_signals_long(spark, path, ids)
    stats = waveform.time_statistics(long, "signal_id")
    steps = waveform.step_statistics(long, "signal_id", ["t"]).select("signal_id", rounded("variation", 4).alias("variation"))
    out = chosen.join(stats, "signal_id").join(steps, "signal_id")
    return out.withColumns({f"stat_{k}": rounded(f"stat_{k}", 4) for k in waveform.TIME_STATS})


@query("wide_signal_spectra", "SRC-5 WAV-4 WAV-5")
def wide_signal_spectra(spark, d):
    """All 20 features of the selected signals."""
    return readers.read_signal_table(spark, f"{d}/lineitem.parquet", signal_metadata(spark, d), "target")


@query("time_limit", "SRC-6",
       "WITH w AS (SELECT l_discount, row_number() OVER () - 1 AS t FROM lineitem) SELECT count(*) AS n, max(t) AS last_t, round(sum(l_discount * t), 4) AS weighted FROM w WHERE t < 5000")
def time_limit(spark, d):
    """The reader's row limit, checked with a sum that depends on the order of rows."""
    rows = readers.read_with_time(spark, f"{d}/lineitem.parquet", ["l_discount"], 5000)
    return rows.agg(F.count("*").alias("n"), F.max("t").alias("last_t"), rounded(F.sum(F.col("l_discount") * F.col("t")), 4).alias("weighted"))


@query("waveform_preview", "SRC-8 SRT-4",
       f"WITH {SQL_LONG} SELECT t, v AS value FROM long WHERE signal_id = 'l_discount' AND t < 1024")
def waveform_preview(spark, d):
    """The first 1024 points of the alphabetically first signal."""
    long = readers.read_signals_long(spark, f"{d}/lineitem.parquet", sorted(SIGNALS))
    return waveform.preview(long, "signal_id", "t", sorted(SIGNALS)[0]).select("t", "value")


@query("run_history_scan", "SRC-9 SET-1",
       f"""WITH {SQL_RUNS} SELECT run_dir, accuracy, NULL::DOUBLE AS f1, 'first' AS origin FROM runs WHERE seed = 42 UNION ALL SELECT run_dir, accuracy, f1, 'second' FROM runs WHERE seed = 52""")
def run_history_scan(spark, d):
    r, root = run_table(spark, d), work_path(spark, "histories")
    sinks.write_csv(r.where("seed = 42").select("run_dir", "accuracy"), f"{root}/first/benchmark_metrics.csv")
    sinks.write_csv(r.where("seed = 52").select("run_dir", "accuracy", "f1"), f"{root}/second/benchmark_metrics.csv")
    h = readers.read_run_histories(spark, [f"{root}/first", f"{root}/second", f"{root}/absent"])
    return h.select("run_dir", "accuracy", "f1", F.element_at(F.split("benchmark_dir", "/"), -1).alias("origin"))


@query("rescored_predictions", "SRC-11",
       f"""WITH {SQL_TASKS}, p AS (SELECT task AS g, y_true, y_pred FROM tasks WHERE y_true >= 0), {SQL_SUMMARY}
SELECT g AS task, round(accuracy, 6) AS accuracy, round(f1, 6) AS macro_f1, CAST(n_rows AS BIGINT) AS n FROM tot""")
def rescored_predictions(spark, d):
    path = sinks.write_csv(ev.masked_predictions(task_predictions(spark, d)), work_path(spark, "predictions"))
    s = ev.summary(readers.read_predictions(spark, path), ["task"])
    return s.select("task", rounded("accuracy").alias("accuracy"), rounded("macro_f1").alias("macro_f1"), F.col("rows").alias("n"))


@query("prepared_round_trip", "SNK-1",
       f"WITH {SQL_SCALED} SELECT vec_id, label, split, round(sum(z), 5) + 0.0 AS total FROM scaled GROUP BY ALL")
def prepared_round_trip(spark, d):
    path = sinks.write_prepared(scaled_vectors(spark, d), work_path(spark, "prepared"), metadata={"width": 64})
    rows, note = sinks.read_prepared(spark, path)
    assert note == {"width": 64}
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "label", "split", rounded(total, 5).alias("total"))


@query("feature_bundle_round_trip", "SNK-2",
       f"""WITH {SQL_FISHER}, b AS (SELECT i, score, row_number() OVER (ORDER BY score DESC, i) AS rk FROM fisher)
SELECT s.vec_id, s.split, CAST(b.rk AS INT) AS rank, 'e_' || i AS feature, round(score, 5) + 0.0 AS score, round(s.z, 5) + 0.0 AS value FROM scaled s JOIN b USING (i) WHERE rk <= 4""")
def feature_bundle_round_trip(spark, d):
    scores = ranked(vector_scores(spark, d)).withColumn("score", rounded("score", 9))
    best = top_features(scores, 4)
    path = sinks.write_feature_bundle(keep_features(scaled_vectors(spark, d), "features", best), scores, work_path(spark, "features"), {"k": 4})
    rows, importance, _ = sinks.read_feature_bundle(spark, path)
    cells = rows.select("vec_id", "split", F.posexplode("features").alias("p", "x")).withColumn("rank", F.col("p") + 1)
    return cells.join(importance.where("rank <= 4"), "rank").select(
        "vec_id", "split", "rank", "feature", rounded("score", 5).alias("score"), rounded("x", 5).alias("value"))


@query("json_sink", "SNK-4", f"SELECT {PART_COLS} FROM part")
def json_sink(spark, d):
    path = sinks.write_json(table(spark, d, "part").select(*PART_COLS.split(", ")), work_path(spark, "json"))
    return spark.read.schema("p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double").json(path)


@query("stage_cache", "SNK-5", f"WITH {SQL_RUNS} SELECT dataset, count(*) AS n FROM runs GROUP BY 1")
def stage_cache(spark, d):
    root, calls = work_path(spark, "cache"), []

    def compute():
        calls.append(1)
        return run_table(spark, d).groupBy("dataset").agg(F.count("*").alias("n"))

    for _ in range(2):
        out = sinks.cached(spark, root, {"table": "lineitem", "by": "dataset"}, compute, [f"{d}/lineitem.parquet"])
    assert len(calls) == 1
    return out


@query("run_outputs", "SNK-6",
       """SELECT 'run-a' AS run_id, y_true, count(*) AS n FROM (SELECT CAST(quality AS INT) AS y_true FROM labels JOIN documents USING (doc_id)) GROUP BY ALL
UNION ALL SELECT 'run-b', y_true, count(*) FROM (SELECT CAST(quality AS INT) AS y_true FROM labels JOIN documents USING (doc_id)) GROUP BY ALL""")
def run_outputs(spark, d):
    path, p = work_path(spark, "runs"), scored_documents(spark, d)
    for run in ("run-a", "run-b"):
        sinks.write_run({"predictions": p.select("doc_id", "y_true", "y_pred"), "per_class": ev.per_class(p)}, path, run)
    back = spark.read.parquet(f"{path}/predictions")
    return back.groupBy(F.col("run_id").cast("string").alias("run_id"), "y_true").agg(F.count("*").alias("n"))


@query("npy_ranges", "SRC-4 JON-3",
       f"""WITH {SQL_CELLS}, f AS (SELECT *, vec_id // 100 AS file, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id, i) - 1 AS pos FROM cells)
SELECT (file % 7) || '_block_' || file || '.npy' AS sample_id, CASE WHEN file % 3 = 0 THEN 'listed' ELSE CAST(file % 7 AS VARCHAR) END AS label,
count(*) AS size, count(*) AS n, round(sum(v), 5) + 0.0 AS total, round(sum(v * pos) / 1000, 4) + 0.0 AS weighted FROM f GROUP BY file""")
def npy_ranges(spark, d):
    """Matrices of a hundred vectors each as .npy files, read back by byte ranges, several tasks a file."""
    file = F.floor(F.col("vec_id") / 100)
    name = F.concat(file % 7, F.lit("_block_"), file, F.lit(".npy"))
    rows = vectors(spark, d).groupBy(name.alias("sample_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "features"))), lambda x: x["features"])).alias("features"))
    path = work_path(spark, "npy")
    listed = npy.write_npy(rows, path, width=64).select(F.col("name").alias("file"), F.lit("listed").alias("label"))
    listed = listed.where(F.regexp_extract("file", r"_(\d+)\.npy$", 1).cast("int") % 3 == 0)
    pieces = npy.with_labels(npy.read_npy(spark, path, range_bytes=10_000, chunk_values=500), listed)
    sums = pieces.select("sample_id", "label", "size", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("total"),
                         F.aggregate(F.transform("values", lambda x, i: x * (F.col("offset") + i)), F.lit(0.0), lambda s, x: s + x).alias("weighted"))
    out = sums.groupBy("sample_id", "label", "size").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("weighted") / 1000).alias("weighted"))
    return out.withColumns({"total": rounded("total", 5), "weighted": rounded("weighted", 4)})


SQL_WRITTEN = f"""{SQL_RUNS}, written AS (SELECT 'run-' || supp || '-' || line AS run, supp % 20 = 1 AS even, * FROM runs WHERE supp % 10 = 1 AND line <= 3)"""


def written_runs(spark, d) -> list[str]:
    """Run directories: metrics as JSON, the configuration as indented lines or as JSON, or none; and one directory without files."""
    r, root = run_table(spark, d).where("supp % 10 = 1 AND line <= 3"), work_path(spark, "records")
    even, line = F.col("supp") % 20 == 1, F.col("line")
    metrics = F.to_json(F.struct("accuracy", "f1", F.when(even, F.col("macro_f1")).alias("macro_f1"), F.when(even, F.col("model_name")).alias("model_name"),
                                 F.when(line == 2, F.lit("high")).alias("risk_note"), F.when(line == 3, F.lit("0.5")).alias("precision")))
    lines = F.concat(F.lit("# settings\ndataset:\n  name: "), F.col("dataset"), F.lit("\nmodel:\n  mode: "), F.col("mode"),
                     F.lit("\n  name: 'fallback'\n\ntrainer:\n  random_state: "), F.col("seed"), F.lit("\ntask:\n  metric_primary: macro-f1\n"))
    compact = F.to_json(F.struct(F.struct(F.col("dataset").alias("name")).alias("dataset"), F.struct(F.col("seed").alias("random_state")).alias("trainer")))
    run = F.concat(F.lit("run-"), F.col("supp"), F.lit("-"), line)
    files = r.select(run.alias("run"), F.inline(F.array(
        F.struct(F.lit("metrics.json").alias("file"), metrics.alias("text")),
        F.struct(F.lit("run_config.yaml").alias("file"), F.when(even, lines).when(line < 3, compact).alias("text"))))).where("text IS NOT NULL")
    made = npy.write_files(files.select(F.concat("run", F.lit("/"), "file").alias("name"), "text"), root, "name", "text")
    # names of directories
    found = made.select(F.split("name", "/")[0].alias("run")).distinct().orderBy("run").collect()
    return [f"{root}/{r['run']}" for r in found] + [f"{root}/absent"]


_MODEL = "CASE WHEN even THEN model_name ELSE 'model' END"


@query("run_directory_records", "EXP-7",
       f"""WITH {SQL_WRITTEN} SELECT run AS alias, run AS run_dir, '' AS prepared_dir, CASE WHEN even OR line < 3 THEN dataset ELSE 'dataset' END AS dataset, 'task' AS task_name, 'label' AS target_column,
{_MODEL} AS model_name, {_MODEL} AS selected_baseline, 'ml' AS model_family, CASE WHEN even OR line < 3 THEN seed ELSE 42 END AS seed, CASE WHEN even THEN 'macro-f1' ELSE 'accuracy' END AS primary_metric,
round(CASE WHEN even THEN macro_f1 ELSE accuracy END, 9) AS primary_score, 'f1' AS secondary_metric, round(f1, 9) AS secondary_score, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1,
CASE WHEN even THEN round(macro_f1, 9) ELSE 0.0 END AS macro_f1, 0.0::DOUBLE AS minority_f1, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, '' AS threshold, CASE WHEN line = 2 THEN 'high' ELSE '' END AS risk_note,
'' AS resolved_device, 0.0::DOUBLE AS overfit_gap FROM written""")
def run_directory_records(spark, d):
    """Records of all run directories from their metric and configuration files, by one scan."""
    rows = runs.run_rows(readers.read_run_records(spark, written_runs(spark, d)))
    rows = rows.withColumn("run_dir", F.element_at(F.split("run_dir", "/"), -1))
    return rows.withColumns({c: rounded(c, 9) for c in ("primary_score", "secondary_score", "accuracy", "f1", "macro_f1")})


@query("benchmark_directory_records", "EXP-8",
       f"""WITH {SQL_WRITTEN} SELECT run AS config, run AS run_dir, CASE WHEN even OR line < 3 THEN dataset ELSE 'dataset' END AS dataset, 'task' AS task_name, 'label' AS target_column, {_MODEL} AS model_name,
{_MODEL} AS selected_baseline, 'ml' AS model_family, CASE WHEN even OR line < 3 THEN seed ELSE 42 END AS seed, CASE WHEN even THEN mode ELSE 'single_task' END AS mode, '' AS transfer_strategy, '' AS pretrain_objective,
round(accuracy, 9) AS accuracy, round(f1, 9) AS f1, round(CASE WHEN even THEN macro_f1 ELSE f1 END, 9) AS macro_f1, 0.0::DOUBLE AS minority_f1, 0.0::DOUBLE AS minority_precision, 0.0::DOUBLE AS minority_recall,
0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, '' AS threshold, CASE WHEN line = 2 THEN 'high' ELSE '' END AS risk_note FROM written""")
def benchmark_directory_records(spark, d):
    rows = runs.benchmark_rows(readers.read_run_records(spark, written_runs(spark, d)))
    rows = rows.withColumn("run_dir", F.element_at(F.split("run_dir", "/"), -1))
    return rows.withColumns({c: rounded(c, 9) for c in ("accuracy", "f1", "macro_f1")})
