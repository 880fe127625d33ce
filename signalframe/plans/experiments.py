"""Run tables: best-of tables, rankings, pivots, histories and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import runs
from ..operators.profile import distinct_counts, distinct_values
from .frames import SQL_RUNS, run_table
from .registry import query

COLS = ["dataset", "task_name", "model_name", "run_dir", "accuracy", "f1"]


@query("best_run_per_dataset", "WIN-1 EXP-13",
       f"""WITH {SQL_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, f1 DESC, run_dir) AS rn FROM runs)
SELECT {', '.join(COLS)} FROM r WHERE rn = 1""")
def best_run_per_dataset(spark, d):
    return runs.best_per(run_table(spark, d), ["dataset"], ["accuracy", "f1"], COLS)


@query("best_run_per_task", "WIN-1 EXP-13",
       f"""WITH {SQL_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY accuracy DESC, f1 DESC, run_dir) AS rn FROM runs)
SELECT {', '.join(COLS)} FROM r WHERE rn = 1""")
def best_run_per_task(spark, d):
    return runs.best_per(run_table(spark, d), ["task_name"], ["accuracy", "f1"], COLS)


@query("benchmark_ranking", "WIN-2",
       f"""WITH {SQL_RUNS} SELECT CAST(row_number() OVER (ORDER BY accuracy DESC, run_dir) AS INT) AS rank, model_name, task_name, model_family, accuracy, macro_f1, run_dir
FROM runs ORDER BY accuracy DESC, run_dir LIMIT 5""")
def benchmark_ranking(spark, d):
    r = runs.benchmark_ranking(run_table(spark, d))
    return r.select("rank", "model_name", "task_name", "model_family", "accuracy", "macro_f1", "run_dir")


@query("ablation_deltas", "WIN-3 EXP-11",
       f"""WITH {SQL_RUNS}, b AS (SELECT *, round(accuracy - first_value(accuracy) OVER (PARTITION BY supp ORDER BY line), 9) + 0.0 AS delta FROM runs)
SELECT supp, task_name AS variant, accuracy AS score, delta, task_name || ': ' || printf('%.4f', accuracy) || ' (delta ' || printf('%+.4f', delta) || ' vs baseline)' AS note FROM b""")
def ablation_deltas(spark, d):
    """Every line number of a supplier is a variant; the first one is the baseline."""
    r = run_table(spark, d)
    a = r.select("supp", "line", F.col("task_name").alias("variant"), F.col("accuracy").alias("score"))
    out = runs.delta_to_first(a, "line", "score", ["supp"]).withColumn("delta", rounded("delta", 9))
    return out.select("supp", "variant", "score", "delta", runs.ablation_note(F.col("variant"), F.col("score"), F.col("delta")).alias("note"))


@query("ablation_summary", "EXP-11", f"WITH {SQL_RUNS} SELECT task_name AS variant, accuracy AS score FROM runs")
def ablation_summary(spark, d):
    return runs.ablation_summary(run_table(spark, d), "task_name", "no_such_metric")


@query("epoch_gaps", "WIN-4",
       f"WITH {SQL_RUNS} SELECT supp, round(max(train_accuracy - accuracy), 9) + 0.0 AS max_gap FROM runs GROUP BY supp")
def epoch_gaps(spark, d):
    g = runs.epoch_gaps(run_table(spark, d), "train_accuracy", "accuracy")
    return g.groupBy("supp").agg(rounded(F.max("overfitting_gap"), 9).alias("max_gap"))


@query("sorted_runs", "SRT-1", f"WITH {SQL_RUNS} SELECT {', '.join(COLS)} FROM runs ORDER BY dataset, task_name, accuracy DESC, f1 DESC")
def sorted_runs(spark, d):
    return runs.sort_runs(run_table(spark, d)).select(*COLS)


@query("best_overall_run", "SRT-2 EXP-13", f"WITH {SQL_RUNS} SELECT {', '.join(COLS)} FROM runs ORDER BY accuracy DESC, f1 DESC, run_dir LIMIT 1")
def best_overall_run(spark, d):
    return runs.best_overall(run_table(spark, d), ["accuracy", "f1"]).select(*COLS)


@query("benchmark_highlights", "SRT-3",
       f"""WITH {SQL_RUNS} SELECT * FROM (SELECT 'accuracy' AS metric, model_name, task_name, accuracy AS value FROM runs ORDER BY accuracy DESC, run_dir LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'macro_f1', model_name, task_name, macro_f1 FROM runs ORDER BY macro_f1 DESC, run_dir LIMIT 1)
UNION ALL SELECT 'runs', NULL, NULL, count(*)::DOUBLE FROM runs UNION ALL SELECT 'tasks', NULL, NULL, count(DISTINCT task_name)::DOUBLE FROM runs""")
def benchmark_highlights(spark, d):
    return runs.highlights(run_table(spark, d))


@query("first_epochs", "SRT-4", f"WITH {SQL_RUNS} SELECT supp, line, accuracy FROM runs WHERE line <= 3")
def first_epochs(spark, d):
    return run_table(spark, d).where("line <= 3").select("supp", "line", "accuracy")


@query("sweep_order", "SRT-5", f"WITH {SQL_RUNS} SELECT line AS level, round(avg(f1), 6) AS macro_f1 FROM runs GROUP BY line ORDER BY line")
def sweep_order(spark, d):
    return run_table(spark, d).groupBy(F.col("line").alias("level")).agg(rounded(F.avg("f1")).alias("macro_f1")).orderBy("level")


@query("merge_histories", "SET-1",
       f"""WITH {SQL_RUNS} SELECT run_dir, accuracy, NULL::DOUBLE AS minority_f1, 'a' AS origin FROM runs WHERE seed = 42
UNION ALL SELECT run_dir, accuracy, minority_f1, 'b' FROM runs WHERE mode = 'pretrain'""")
def merge_histories(spark, d):
    """Two histories with different columns, one under the other."""
    r = run_table(spark, d)
    a = r.where("seed = 42").select("run_dir", "accuracy").withColumn("origin", F.lit("a"))
    b = r.where("mode = 'pretrain'").select("run_dir", "accuracy", "minority_f1").withColumn("origin", F.lit("b"))
    return a.unionByName(b, allowMissingColumns=True)


@query("drop_duplicate_rows", "SET-2", f"WITH {SQL_RUNS} SELECT DISTINCT dataset, model_name, seed FROM runs")
def drop_duplicate_rows(spark, d):
    return run_table(spark, d).select("dataset", "model_name", "seed").dropDuplicates()


@query("family_means", "AGG-15", f"WITH {SQL_RUNS} SELECT model_family, round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1 FROM runs GROUP BY 1")
def family_means(spark, d):
    return runs.family_means(run_table(spark, d)).select("model_family", rounded("accuracy").alias("accuracy"), rounded("f1").alias("f1"))


@query("model_strategy_pivot", "AGG-16 EXP-12",
       f"""WITH {SQL_RUNS} SELECT model_name, round(coalesce(avg(accuracy) FILTER (coalesce(transfer_strategy, '') = ''), 0), 6) AS scratch,
round(coalesce(avg(accuracy) FILTER (transfer_strategy = 'freeze'), 0), 6) AS freeze FROM runs GROUP BY 1""")
def model_strategy_pivot(spark, d):
    p = runs.pivot_means(run_table(spark, d), "model_name", "transfer_strategy", "accuracy", ["scratch", "freeze"], "scratch")
    return p.select("model_name", rounded("scratch").alias("scratch"), rounded("freeze").alias("freeze"))


@query("task_mode_pivot", "AGG-17 EXP-12",
       f"""WITH {SQL_RUNS} SELECT coalesce(CASE WHEN line = 7 THEN NULL ELSE task_name END, 'task') AS task_name, round(coalesce(avg(accuracy) FILTER (mode = 'single_task'), 0), 6) AS single_task,
round(coalesce(avg(accuracy) FILTER (mode = 'pretrain'), 0), 6) AS pretrain, round(coalesce(avg(accuracy) FILTER (mode = 'multitask'), 0), 6) + 0.0 AS multitask FROM runs GROUP BY 1""")
def task_mode_pivot(spark, d):
    r = run_table(spark, d).withColumn("task_name", F.when(F.col("line") != 7, F.col("task_name")))
    modes = ["single_task", "pretrain", "multitask"]
    p = runs.pivot_means(r, "task_name", "mode", "accuracy", modes, "single_task", row_blank="task")
    return p.select("task_name", *[rounded(m).alias(m) for m in modes])


@query("strategy_rows", "EXP-12",
       f"WITH {SQL_RUNS} SELECT run_dir, coalesce(nullif(transfer_strategy, ''), 'scratch') AS strategy, accuracy FROM runs WHERE (SELECT count(DISTINCT coalesce(nullif(transfer_strategy, ''), 'scratch')) FROM runs) > 1")
def strategy_rows(spark, d):
    return runs.strategy_rows(run_table(spark, d)).select("run_dir", "strategy", "accuracy")


@query("cross_dataset_summary", "AGG-18",
       f"""WITH {SQL_RUNS} SELECT count(*) AS dataset_count, first(dataset ORDER BY accuracy DESC, run_dir) AS best_dataset, max(accuracy) AS best_accuracy,
round(avg(accuracy), 6) AS mean_accuracy, min(accuracy) AS worst_accuracy FROM runs""")
def cross_dataset_summary(spark, d):
    return runs.cross_dataset_summary(run_table(spark, d)).withColumn("mean_accuracy", rounded("mean_accuracy"))


def _folds(spark, d):
    r = run_table(spark, d)
    return r.select(F.when(F.col("line") == 7, "mean").otherwise(F.col("line").cast("string")).alias("fold"), "model_name", "accuracy", "f1")


SQL_FOLDS = f"{SQL_RUNS}, folds AS (SELECT CASE WHEN line = 7 THEN 'mean' ELSE CAST(line AS VARCHAR) END AS fold, model_name, accuracy, f1 FROM runs)"


@query("cv_summary", "AGG-19",
       f"WITH {SQL_FOLDS} SELECT model_name, round(avg(accuracy), 6) AS cv_mean, round(stddev_pop(accuracy), 6) AS cv_std FROM folds WHERE try_cast(fold AS DOUBLE) IS NOT NULL GROUP BY 1")
def cv_summary(spark, d):
    return runs.cv_summary(_folds(spark, d)).select("model_name", rounded("cv_mean").alias("cv_mean"), rounded("cv_std").alias("cv_std"))


@query("cv_aggregate", "AGG-19",
       f"""WITH {SQL_FOLDS}, c AS (SELECT avg(accuracy) AS m, stddev_pop(accuracy) AS s FROM folds WHERE try_cast(fold AS DOUBLE) IS NOT NULL GROUP BY model_name)
SELECT round(max(m), 6) AS best_cv_mean, round(avg(s), 6) AS mean_cv_std FROM c""")
def cv_aggregate(spark, d):
    a = runs.cv_aggregate(runs.cv_summary(_folds(spark, d)))
    return a.select(rounded("best_cv_mean").alias("best_cv_mean"), rounded("mean_cv_std").alias("mean_cv_std"))


@query("fold_summary_rows", "AGG-20",
       f"""WITH {SQL_RUNS}, m AS (SELECT model_name FROM runs GROUP BY 1 ORDER BY count(*) DESC, model_name LIMIT 1)
SELECT CAST(line AS VARCHAR) AS fold, model_name, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1 FROM runs
UNION ALL SELECT 'mean', (FROM m), round(avg(accuracy), 9), round(avg(f1), 9) FROM runs UNION ALL SELECT 'std', (FROM m), round(stddev_pop(accuracy), 9), round(stddev_pop(f1), 9) FROM runs""")
def fold_summary_rows(spark, d):
    r = run_table(spark, d).select(F.col("line").alias("fold"), "model_name", "accuracy", "f1")
    f = runs.with_fold_summary(r, ["accuracy", "f1"])
    return f.select("fold", "model_name", rounded("accuracy", 9).alias("accuracy"), rounded("f1", 9).alias("f1"))


@query("distinct_labels", "AGG-21", f"""WITH {SQL_RUNS} SELECT DISTINCT 'dataset' AS "column", dataset AS value FROM runs UNION ALL SELECT DISTINCT 'task_name', task_name FROM runs""")
def distinct_labels(spark, d):
    return distinct_values(run_table(spark, d), ["dataset", "task_name"])


@query("distinct_counts", "AGG-21", f"""WITH {SQL_RUNS} SELECT 'dataset' AS "column", count(DISTINCT dataset) AS n FROM runs UNION ALL SELECT 'task_name', count(DISTINCT task_name) FROM runs""")
def distinct_count_query(spark, d):
    return distinct_counts(run_table(spark, d), ["dataset", "task_name"])


@query("experiment_grid", "JON-5",
       f"""WITH {SQL_RUNS}, g AS (SELECT * FROM (SELECT DISTINCT task_name AS task FROM runs), (SELECT unnest(['random_forest', 'cnn_1d', 'cnn_lstm']) AS model), (SELECT unnest([42, 52]) AS seed),
(SELECT unnest(['single_task', 'pretrain', 'multitask']) AS mode), (SELECT unnest(['scratch', 'freeze']) AS transfer))
SELECT DISTINCT task, model, CAST(seed AS INT) AS seed, mode, transfer, task || ':' || model || ':seed=' || seed || ':mode=' || mode || ':transfer=' || transfer AS label FROM g
WHERE (mode = 'single_task' OR (mode = 'pretrain' AND model = 'cnn_1d')) AND (transfer = 'scratch' OR (mode <> 'pretrain' AND model <> 'random_forest'))""")
def experiment_grid(spark, d):
    return runs.experiment_grid(run_table(spark, d), "task_name", ["random_forest", "cnn_1d", "cnn_lstm"], [42, 52],
                                ["single_task", "pretrain", "multitask"], ["scratch", "freeze"], ["cnn_1d"], ["cnn_1d", "cnn_lstm"])


@query("run_directories", "SRC-10",
       f"""WITH {SQL_RUNS}, u AS (SELECT run_dir, 0 AS source, supp * 10 + line AS position FROM runs WHERE seed = 42 UNION ALL SELECT run_dir, 1, line * 100000 + supp FROM runs)
SELECT run_dir, CAST(source AS INT) AS source, position FROM (SELECT *, row_number() OVER (PARTITION BY run_dir ORDER BY source, position) AS rn FROM u) WHERE rn = 1""")
def run_directories(spark, d):
    r = run_table(spark, d)
    explicit = r.where("seed = 42").select("run_dir", (F.col("supp") * 10 + F.col("line")).alias("position"))
    return runs.distinct_run_dirs(explicit, r.select("run_dir", (F.col("line") * 100000 + F.col("supp")).alias("position")))


_LONG = "SELECT run_dir, metric, value FROM runs UNPIVOT (value FOR metric IN (accuracy, f1, minority_f1))"


@query("melt_metrics", "EXP-14", f"WITH {SQL_RUNS} {_LONG}")
def melt_metrics(spark, d):
    return runs.melt_metrics(run_table(spark, d), ["run_dir"], ["accuracy", "f1", "minority_f1"])


@query("spread_metrics", "EXP-14", f"WITH {SQL_RUNS} SELECT run_dir, accuracy, f1, minority_f1 FROM runs")
def spread_metrics(spark, d):
    names = ["accuracy", "f1", "minority_f1"]
    return runs.spread_metrics(runs.melt_metrics(run_table(spark, d), ["run_dir"], names), ["run_dir"], names)


@query("metric_rows", "EXP-15", f"WITH {SQL_RUNS} SELECT model_name, accuracy, f1, macro_f1 FROM runs")
def metric_rows(spark, d):
    return runs.metric_row(run_table(spark, d))


@query("run_records", "EXP-7",
       f"""WITH {SQL_RUNS} SELECT CAST(line AS VARCHAR) AS alias, run_dir, '' AS prepared_dir, dataset, task_name, 'label' AS target_column, model_name, model_name AS selected_baseline,
model_family, seed, 'accuracy' AS primary_metric, accuracy AS primary_score, 'f1' AS secondary_metric, f1 AS secondary_score, accuracy, f1, macro_f1, minority_f1, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall,
'' AS threshold, '' AS risk_note, '' AS resolved_device, 0.0::DOUBLE AS overfit_gap FROM runs""")
def run_records(spark, d):
    return runs.run_records(run_table(spark, d))


@query("benchmark_records", "EXP-8",
       f"""WITH {SQL_RUNS} SELECT '' AS config, run_dir, dataset, task_name, 'label' AS target_column, model_name, model_name AS selected_baseline, model_family, seed, mode,
coalesce(transfer_strategy, '') AS transfer_strategy, '' AS pretrain_objective, accuracy, f1, macro_f1, minority_f1, 0.0::DOUBLE AS minority_precision, 0.0::DOUBLE AS minority_recall, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall,
'' AS threshold, '' AS risk_note FROM runs""")
def benchmark_records(spark, d):
    return runs.benchmark_records(run_table(spark, d))


def _histories(spark, d):
    """One row per supplier with the series of its runs by line number (seven at most)."""
    g = run_table(spark, d).groupBy("supp").agg(F.array_sort(F.collect_list(F.struct("line", "f1", "accuracy", "train_accuracy"))).alias("h"))
    return g.select("supp", F.col("h.f1").alias("loss"), F.col("h.accuracy").alias("val_accuracy"), F.col("h.train_accuracy").alias("train_accuracy"))


@query("training_history", "EXP-10",
       f"""WITH {SQL_RUNS} SELECT supp, CAST(row_number() OVER (PARTITION BY supp ORDER BY line) AS INT) AS epoch, f1 AS train_loss, f1 AS val_loss, accuracy, accuracy AS f1,
train_accuracy AS train_score, accuracy AS val_score, 0.0::DOUBLE AS learning_rate FROM runs""")
def training_history(spark, d):
    return runs.history_rows(_histories(spark, d), ["supp"])


@query("single_epoch_history", "EXP-10",
       f"""WITH {SQL_RUNS} SELECT run_dir, 1 AS epoch, 1 - accuracy AS train_loss, 1 - f1 AS val_loss, accuracy, f1, accuracy AS train_score, accuracy AS val_score, 0.0::DOUBLE AS learning_rate FROM runs""")
def single_epoch_history(spark, d):
    return runs.single_history_row(run_table(spark, d), ["run_dir"])


def _epoch_sql(up: str) -> str:
    return f"""WITH {SQL_RUNS}, e AS (SELECT supp, line AS epoch, f1, accuracy, min(f1) OVER w AS best_loss, max(row(accuracy, -f1)) OVER w AS best FROM runs
  WINDOW w AS (PARTITION BY supp ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, {up} AS up FROM e), l AS (SELECT *, max(CASE WHEN up THEN epoch END) OVER (PARTITION BY supp ORDER BY epoch) AS last_up FROM u),
s AS (SELECT supp, min(CASE WHEN epoch - last_up >= 2 THEN epoch END) AS halt, max(epoch) AS fin FROM l GROUP BY supp)
SELECT supp, CAST(max(epoch) FILTER (up AND epoch <= coalesce(halt, fin)) AS INT) AS best_epoch, CAST(any_value(coalesce(halt, fin)) AS INT) AS stop_epoch, any_value(fin) IS NOT NULL AND bool_or(halt IS NOT NULL) AS stopped_early
FROM l JOIN s USING (supp) GROUP BY supp"""


@query("early_stopping", "EXP-16", _epoch_sql("best_loss IS NULL OR f1 < best_loss"))
def early_stopping(spark, d):
    return runs.best_and_stop_epoch(run_table(spark, d).withColumnRenamed("line", "epoch"), "supp", 2, "f1")


@query("early_stopping_by_score", "EXP-16", _epoch_sql("best IS NULL OR row(accuracy, -f1) > best"))
def early_stopping_by_score(spark, d):
    return runs.best_and_stop_epoch(run_table(spark, d).withColumnRenamed("line", "epoch"), "supp", 2, "f1", "accuracy")
