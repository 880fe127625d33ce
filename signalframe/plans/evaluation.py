"""Evaluation queries over labelled documents with a deterministic score and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import evaluate as ev
from .frames import SQL_RUNS, SQL_SCORED, SQL_TASKS, run_table, scored_documents, task_predictions
from .registry import query

GRID = (0.2, 0.35, 0.5, 0.65, 0.8)
METRICS = ("accuracy", "precision", "recall", "f1", "macro_f1")

# Per-class scores and summary of a CTE ``p(g, y_true, y_pred)``; every division by 0 is 0.
SQL_SUMMARY = """cnt AS (SELECT g, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
side AS (
  SELECT g, y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cnt
  UNION ALL SELECT g, y_pred, 0, 0, n FROM cnt
), cls0 AS (
  SELECT g, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM side GROUP BY g, label
), cls1 AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall FROM cls0
), cls AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM cls1
), tot AS (
  SELECT g, sum(support) AS n_rows, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(precision) AS precision, avg(recall) AS recall,
         avg(f1) AS f1, count(*) AS k FROM cls GROUP BY g
)"""


def _report(df, by=()):
    return df.select(*by, *[rounded(m).alias(m) for m in METRICS])


@query("confusion_matrix", "EVAL-1 SET-3",
       f"""WITH {SQL_SCORED}, lab AS (SELECT y_true AS l FROM scored UNION SELECT y_pred FROM scored),
cnt AS (SELECT y_true, y_pred, count(*) AS n FROM scored GROUP BY ALL)
SELECT a.l AS y_true, b.l AS y_pred, coalesce(n, 0) AS n FROM lab a, lab b
LEFT JOIN cnt ON cnt.y_true = a.l AND cnt.y_pred = b.l""")
def confusion_matrix(spark, d):
    return ev.confusion_matrix(scored_documents(spark, d))


@query("label_union", "SET-3",
       f"WITH {SQL_TASKS} SELECT task, y_true AS label FROM tasks UNION SELECT task, y_pred FROM tasks")
def label_union(spark, d):
    return ev.label_union(task_predictions(spark, d), ["task"])


@query("per_class_metrics", "EVAL-2",
       f"""WITH {SQL_SCORED}, p AS (SELECT 0 AS g, y_true, y_pred FROM scored), {SQL_SUMMARY}
SELECT label, CASE label WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE CAST(label AS VARCHAR) END AS label_name,
       round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1,
       CAST(support AS BIGINT) AS support FROM cls""")
def per_class_metrics(spark, d):
    per = ev.named_classes(ev.per_class(scored_documents(spark, d)), ["low", "high"])
    return per.select("label", "label_name", *[rounded(m).alias(m) for m in ("precision", "recall", "f1")], "support")


@query("macro_summary", "EVAL-3",
       f"""WITH {SQL_SCORED}, p AS (SELECT 0 AS g, y_true, y_pred FROM scored), {SQL_SUMMARY}
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(f1, 6) AS macro_f1 FROM tot""")
def macro_summary(spark, d):
    return _report(ev.summary(scored_documents(spark, d)))


@query("minority_class", "EVAL-4",
       f"""WITH {SQL_TASKS}, p AS (SELECT task AS g, y_true, y_pred FROM tasks WHERE y_true >= 0), {SQL_SUMMARY},
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY support, label) AS rn FROM cls)
SELECT g AS task, label AS minority_label, CAST(support AS BIGINT) AS minority_support,
       round(precision, 6) AS minority_precision, round(recall, 6) AS minority_recall, round(f1, 6) AS minority_f1
FROM r WHERE rn = 1""")
def minority_class(spark, d):
    s = ev.summary(task_predictions(spark, d).where("y_true >= 0"), ["task"])
    return s.select("task", "minority_label", "minority_support",
                    *[rounded(f"minority_{m}").alias(f"minority_{m}") for m in ("precision", "recall", "f1")])


@query("positive_class", "EVAL-5",
       f"""WITH {SQL_SCORED}, p AS (SELECT split AS g, y_true, y_pred FROM scored), {SQL_SUMMARY}
SELECT g AS split, round(c.precision, 6) AS positive_precision, round(c.recall, 6) AS positive_recall, round(c.f1, 6) AS positive_f1
FROM tot LEFT JOIN (SELECT * FROM cls WHERE label = 1) c USING (g) WHERE tot.k = 2""")
def positive_class(spark, d):
    s = ev.summary(scored_documents(spark, d), ["split"]).where(F.col("positive_f1").isNotNull())
    return s.select("split", *[rounded(f"positive_{m}").alias(f"positive_{m}") for m in ("precision", "recall", "f1")])


SQL_CURVE = """pts0 AS (
  SELECT score AS t, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scored GROUP BY score
  UNION ALL SELECT 0.0, 0, 0 UNION ALL SELECT 1.0, 0, 0
), pts AS (SELECT t, sum(pos) AS pos, sum(neg) AS neg FROM pts0 GROUP BY t),
cum AS (
  SELECT t, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM pts
  WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)
), rate AS (
  SELECT t, tp, fp, tp::DOUBLE / pa AS tpr, fp::DOUBLE / na AS fpr,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS prec FROM cum
)"""


@query("roc_pr_points", "EVAL-6 WIN-7",
       f"""WITH {SQL_SCORED}, {SQL_CURVE}
SELECT round(t, 9) AS threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(prec, 6) AS precision, round(tpr, 6) AS recall FROM rate""")
def roc_pr_points(spark, d):
    p = ev.curve_points(scored_documents(spark, d))
    return p.select(rounded("threshold", 9).alias("threshold"), "tp", "fp",
                    *[rounded(c).alias(c) for c in ("tpr", "fpr", "precision", "recall")])


@query("roc_pr_areas", "EVAL-7",
       f"""WITH {SQL_SCORED}, {SQL_CURVE}, seg AS (
  SELECT (fpr - lag(fpr) OVER o) * (tpr + lag(tpr) OVER o) / 2 AS roc, (tpr - lag(tpr) OVER o) * (prec + lag(prec) OVER o) / 2 AS pr
  FROM rate WINDOW o AS (ORDER BY t DESC))
SELECT round(sum(roc), 6) AS roc_auc, round(sum(pr), 6) AS pr_auc FROM seg""")
def roc_pr_areas(spark, d):
    return ev.curve_areas(scored_documents(spark, d)).select(rounded("roc_auc").alias("roc_auc"), rounded("pr_auc").alias("pr_auc"))


@query("metric_lookup", "EVAL-8",
       f"""WITH {SQL_RUNS} SELECT run_dir, coalesce(minority_f1, 0.0) AS by_alias, coalesce(macro_f1, 0.0) AS by_macro, 0.0::DOUBLE AS absent FROM runs""")
def metric_lookup(spark, d):
    r = run_table(spark, d)
    return r.select("run_dir", ev.metric_column(r, "minority-f1").alias("by_alias"),
                    ev.metric_column(r, "macro-f1").alias("by_macro"), ev.metric_column(r, "no_such_metric").alias("absent"))


@query("never_predicted", "EVAL-9",
       f"""WITH p AS (SELECT l_linestatus AS g, CAST(l_linenumber AS INT) AS y_true, CAST(l_linenumber % 4 AS INT) AS y_pred FROM lineitem)
SELECT DISTINCT g AS status, y_true AS label FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.g = a.g AND b.y_pred = a.y_true)""")
def never_predicted(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    p = li.select(F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("int").alias("y_true"),
                  (F.col("l_linenumber") % 4).cast("int").alias("y_pred"))
    return ev.never_predicted(p, ["status"])


@query("multitask_metrics", "EVAL-10 SRC-11",
       f"""WITH {SQL_TASKS}, p AS (SELECT task AS g, y_true, y_pred FROM tasks WHERE y_true >= 0), {SQL_SUMMARY}
SELECT g AS task, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(f1, 6) AS macro_f1, CAST(n_rows AS BIGINT) AS valid_count FROM tot
UNION ALL SELECT 'unlabelled', 0.0, 0.0, 0.0, 0""")
def multitask_metrics(spark, d):
    m = ev.multitask_summary(task_predictions(spark, d), ["quality", "toxic", "unlabelled"])
    return m.select("task", *[rounded(c).alias(c) for c in ("accuracy", "f1", "macro_f1")], "valid_count")


@query("multitask_means", "EVAL-10",
       f"""WITH {SQL_TASKS}, p AS (SELECT task AS g, y_true, y_pred FROM tasks WHERE y_true >= 0), {SQL_SUMMARY}
SELECT round(avg(accuracy), 6) AS mean_task_accuracy, round(avg(f1), 6) AS mean_task_f1 FROM tot""")
def multitask_means(spark, d):
    m = ev.multitask_means(ev.multitask_summary(task_predictions(spark, d), ["quality", "toxic"]))
    return m.select(*[rounded(c).alias(c) for c in m.columns])


@query("masked_predictions", "PRJ-20",
       f"""WITH {SQL_TASKS} SELECT doc_id, task, y_true, CASE WHEN y_true >= 0 THEN y_pred ELSE -1 END AS y_pred, y_true >= 0 AS is_labeled FROM tasks""")
def masked_predictions(spark, d):
    return ev.masked_predictions(task_predictions(spark, d))


@query("split_metrics", "EVAL-11",
       f"""WITH {SQL_SCORED}, p AS (SELECT split AS g, y_true, y_pred FROM scored), {SQL_SUMMARY}
SELECT g AS split, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f1, 6) AS macro_f1 FROM tot""")
def split_metrics(spark, d):
    return _report(ev.summary(scored_documents(spark, d), ["split"]), ["split"])


@query("overfit_gap", "EVAL-11",
       f"""WITH {SQL_SCORED}, a AS (SELECT split, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM scored GROUP BY split)
SELECT round(max(acc) FILTER (split = 'train'), 6) AS accuracy_train, round(max(acc) FILTER (split = 'val'), 6) AS accuracy_val,
       round(max(acc) FILTER (split = 'train') - max(acc) FILTER (split = 'val'), 6) + 0.0 AS overfit_gap FROM a""")
def overfit_gap(spark, d):
    g = ev.overfit_gap(scored_documents(spark, d))
    return g.select(*[rounded(c).alias(c) for c in g.columns])


@query("risk_notes", "EVAL-12",
       f"""WITH {SQL_RUNS}, r AS (SELECT *, train_accuracy - accuracy AS gap, min(accuracy) OVER (PARTITION BY supp) AS low FROM runs)
SELECT run_dir, CASE WHEN gap > 0.1 THEN 'possible_overfit_gap=' || printf('%.3f', round(gap, 9)) ELSE 'train_val_gap_stable=' || printf('%.3f', round(gap, 9)) END
  || CASE WHEN train_accuracy >= 0.95 THEN CASE WHEN low >= 0.95 THEN '; high_score_persists_across_ablations' ELSE '; high_score_sensitive_to_feature_subset' END ELSE '' END AS note,
  CASE WHEN gap >= 0.05 THEN 'High overfitting risk detected' ELSE 'Overfitting risk acceptable' END AS verdict
FROM r""")
def risk_notes(spark, d):
    r = run_table(spark, d)
    low = r.groupBy("supp").agg(F.min("accuracy").alias("low"))
    gap = F.round(F.col("train_accuracy") - F.col("accuracy"), 9)
    return r.join(low, "supp").select(
        "run_dir", ev.risk_note(gap, F.col("train_accuracy"), F.col("low")).alias("note"),
        F.split(ev.gap_warning(gap), ":")[0].alias("verdict"),
    )


SQL_GRID = "grid AS (SELECT unnest([0.2, 0.35, 0.5, 0.65, 0.8]::DOUBLE[]) AS t, generate_subscripts([0.2, 0.35, 0.5, 0.65, 0.8], 1) AS pos)"


@query("threshold_grid", "MDL-9 PRJ-19",
       f"""WITH {SQL_SCORED}, {SQL_GRID}, p AS (SELECT t AS g, y_true, CASE WHEN score >= t THEN 1 ELSE 0 END AS y_pred FROM scored, grid), {SQL_SUMMARY}
SELECT g AS threshold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f1, 6) AS macro_f1 FROM tot""")
def threshold_grid(spark, d):
    return _report(ev.threshold_table(scored_documents(spark, d), GRID), ["threshold"])


@query("threshold_best", "MDL-9 WIN-8",
       f"""WITH {SQL_SCORED}, {SQL_GRID}, p AS (SELECT t AS g, y_true, CASE WHEN score >= t THEN 1 ELSE 0 END AS y_pred FROM scored, grid), {SQL_SUMMARY}
SELECT g AS threshold, round(f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM tot JOIN grid ON t = g
ORDER BY tot.f1 DESC, tot.recall DESC, tot.accuracy DESC, pos LIMIT 1""")
def threshold_best(spark, d):
    t = ev.best_threshold(ev.threshold_table(scored_documents(spark, d), GRID), ["macro_f1", "recall", "accuracy"])
    return t.select("threshold", rounded("macro_f1").alias("macro_f1"), rounded("accuracy").alias("accuracy"))


@query("threshold_or_native", "MDL-9",
       f"""WITH {SQL_SCORED}, {SQL_GRID}, p AS (
  SELECT t AS g, y_true, CASE WHEN score >= t THEN 1 ELSE 0 END AS y_pred FROM scored, grid
  UNION ALL SELECT -1.0, y_true, y_pred FROM scored), {SQL_SUMMARY}
SELECT CASE WHEN g < 0 THEN NULL ELSE g END AS threshold, round(accuracy, 6) AS accuracy, round(f1, 6) AS macro_f1
FROM tot ORDER BY tot.f1 DESC, tot.accuracy DESC, g LIMIT 1""")
def threshold_or_native(spark, d):
    t = ev.tuned_or_native(scored_documents(spark, d), GRID, ["macro_f1", "accuracy"])
    return t.select("threshold", rounded("accuracy").alias("accuracy"), rounded("macro_f1").alias("macro_f1"))


@query("threshold_predicate", "PRJ-19", f"WITH {SQL_SCORED} SELECT doc_id, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS y_pred FROM scored")
def threshold_predicate(spark, d):
    return scored_documents(spark, d).select("doc_id", (F.col("score") >= 0.35).cast("int").alias("y_pred"))


@query("decision_scores", "MDL-10",
       """SELECT event_id, round((value - lo) / (hi - lo), 6) AS score FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def decision_scores(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    return ev.minmax_scores(e, "value").select("event_id", rounded("score").alias("score"))


@query("argmax_class", "MDL-12",
       """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS predicted FROM embeddings""")
def argmax_class(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", ev.argmax_class(F.col("embedding")).alias("predicted"))
