"""Evaluation of class predictions and scores.

Every operator first reduces the predictions to (y_true, y_pred) or score counts with map-side
combining; the metrics are then expressions over that small table.  ``by`` adds grouping keys
(task, split, noise level, ...) so many evaluations share one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import safe_div
from ..functions.text import fixed
from ..session import cut_lineage
from .ordering import attach, bounded_side, running_sums

# Accepted spellings of metric names (fixed values).
METRIC_ALIASES = {
    "macro-f1": "macro_f1",
    "minority-f1": "minority_f1", "minority-precision": "minority_precision", "minority-recall": "minority_recall",
    "positive-f1": "positive_f1", "positive-precision": "positive_precision", "positive-recall": "positive_recall",
}


def metric_column(df: DataFrame, name: str) -> Column:
    """A metric by any accepted spelling; 0.0 where it is absent or null."""
    key = METRIC_ALIASES.get(name, name)
    if key not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(key).try_cast("double"), F.lit(0.0))


def pair_counts(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(by..., y_true, y_pred, n)."""
    return df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def label_union(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label): every label that occurs as truth or as prediction."""
    return pair_counts(df, by).select(*by, F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y_true, y_pred, n) over all label pairs, zeros included."""
    by = list(by)
    counts = pair_counts(df, by)
    labels = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("y_true", "y_pred"))))).alias("labels")
    grid = counts.groupBy(*by).agg(labels).select(*by, "labels", F.explode("labels").alias("y_true"))
    grid = grid.select(*by, "y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classes_of_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``per_class`` for already counted (y_true, y_pred, n)."""
    by = list(by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = pairs.select(*by, F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), none.alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted")),
    )))
    sums = sides.groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    scored = sums.withColumns({
        "precision": safe_div(F.col("tp"), F.col("predicted")),
        "recall": safe_div(F.col("tp"), F.col("support")),
    })
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", safe_div(2.0 * p * r, p + r))


def per_class(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, tp, support, predicted, precision, recall, f1) over true and predicted labels."""
    return classes_of_counts(pair_counts(df, by), by)


def named_classes(per: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``label_name``: the name at that index, else the number as text."""
    if not names:
        return per.withColumn("label_name", F.col("label").cast("string"))
    lookup = F.array(*[F.lit(n) for n in names])
    name = F.when(F.col("label") >= 0, F.get(lookup, F.col("label").cast("int")))
    return per.withColumn("label_name", F.coalesce(name, F.col("label").cast("string")))


def summary_of_classes(per: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``summary`` for an already computed per-class table."""
    by = list(by)
    cls = F.struct("support", "label", "precision", "recall", "f1")
    positive = F.max(F.when(F.col("label") == 1, F.struct("precision", "recall", "f1")))
    agg = per.groupBy(*by).agg(
        F.sum("tp").alias("_sf_tp"), F.sum("support").alias("rows"), F.count("*").alias("_sf_k"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.min(cls).alias("_sf_min"), positive.alias("_sf_pos"),
    )
    two = F.col("_sf_k") == 2
    low = F.col("_sf_min")
    return agg.select(
        *by, "rows",
        safe_div(F.col("_sf_tp"), F.col("rows")).alias("accuracy"),
        "precision", "recall", "f1", F.col("f1").alias("macro_f1"),
        low["label"].alias("minority_label"), low["support"].alias("minority_support"),
        low["precision"].alias("minority_precision"), low["recall"].alias("minority_recall"), low["f1"].alias("minority_f1"),
        *[F.when(two, F.col("_sf_pos")[m]).alias(f"positive_{m}") for m in ("precision", "recall", "f1")],
    )


def summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by``: accuracy, macro averages, minority-class and positive-class scores."""
    return summary_of_classes(per_class(df, by), by)


def never_predicted(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label): labels that occur as truth but are never predicted."""
    return per_class(df, by).where(F.col("predicted") == 0).select(*by, "label")


def multitask_summary(df: DataFrame, tasks: Sequence[str], task: str = "task") -> DataFrame:
    """(task, accuracy, f1, macro_f1, valid_count) on labelled rows (y_true >= 0).

    A task without any labelled row is kept, with zeros.
    """
    done = summary(df.where(F.col("y_true") >= 0), [task])
    all_tasks = df.sparkSession.createDataFrame([(t,) for t in tasks], f"{task} string")
    zero = F.lit(0.0)
    return all_tasks.join(done, task, "left").select(
        task, *[F.coalesce(m, zero).alias(m) for m in ("accuracy", "f1", "macro_f1")],
        F.coalesce("rows", F.lit(0)).alias("valid_count"),
    )


def multitask_means(per_task: DataFrame) -> DataFrame:
    return per_task.agg(F.avg("accuracy").alias("mean_task_accuracy"), F.avg("f1").alias("mean_task_f1"))


def masked_predictions(df: DataFrame) -> DataFrame:
    """Add ``is_labeled`` and blank the prediction (-1) of rows without a label."""
    ok = F.col("y_true") >= 0
    return df.withColumns({"is_labeled": ok, "y_pred": F.when(ok, F.col("y_pred")).otherwise(F.lit(-1))})


def _curve(df: DataFrame, by: Sequence[str], y_true: str, score: str, buckets: int) -> DataFrame:
    """Running counts at every threshold.

    The counts per distinct score are written once; end points, bucket bounds and running sums all
    read that table, so the scored rows are scanned a single time.
    """
    by = list(by)
    y = F.col(y_true)
    counts = cut_lineage(df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum((y == 1).cast("bigint")).alias("pos"), F.sum((y == 0).cast("bigint")).alias("neg")
    ))
    ends = bounded_side(counts.groupBy(*by).agg(
        F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"),
        F.greatest(F.max("threshold"), F.lit(1.0)).alias("top"),
    ))
    none = F.lit(0).cast("bigint")
    rims = ends.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("threshold"), none.alias("pos"), none.alias("neg"))
    points = counts.unionByName(rims).groupBy(*by, "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = running_sums(points, "threshold", ["pos", "neg"], by, descending=True, buckets=buckets)
    return attach(run, ends, by)


def _rates(tp: Column, fp: Column) -> dict[str, Column]:
    recall = safe_div(tp, F.col("pos_all"))
    return {"tpr": recall, "fpr": safe_div(fp, F.col("neg_all")), "precision": safe_div(tp, tp + fp), "recall": recall}


def curve_points(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "score",
                 buckets: int = 256) -> DataFrame:
    """ROC and PR points at every distinct threshold among {0}, the scores and {1}.

    Columns: by..., threshold, tp, fp, tpr, fpr, precision, recall.  Scores are collapsed to counts
    per distinct value, then summed from the top by ``running_sums``.
    """
    run = _curve(df, by, y_true, score, buckets)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    rates = _rates(tp, fp)
    return run.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"), *[c.alias(n) for n, c in rates.items()])


def curve_areas(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "score",
                buckets: int = 256) -> DataFrame:
    """(by..., roc_auc, pr_auc) by trapezoids between neighbouring thresholds.

    The point above a threshold is its running total less its own counts, so the areas need no
    neighbour lookup; only the topmost threshold has no point above it.
    """
    run = _curve(df, by, y_true, score, buckets)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    here, above = _rates(tp, fp), _rates(tp - F.col("pos"), fp - F.col("neg"))

    def trapezoid(x: str, y: str) -> Column:
        area = (here[x] - above[x]) * (here[y] + above[y]) / 2.0
        return F.sum(F.when(F.col("threshold") < F.col("top"), area).otherwise(F.lit(0.0)))

    return run.groupBy(*by).agg(trapezoid("fpr", "tpr").alias("roc_auc"), trapezoid("recall", "precision").alias("pr_auc"))


def threshold_table(df: DataFrame, grid: Sequence[float], by: Sequence[str] = (), y_true: str = "y_true",
                    score: str = "score") -> DataFrame:
    """Summary metrics of ``score >= t`` for every grid value, from one pass over the rows.

    A row is counted once, under the number of grid values its score reaches; the confusion of each
    threshold sums those few counts.  ``position`` is the place of the value in the grid.
    """
    by = list(by)
    given = [float(g) for g in grid]
    steps = sorted(set(given))
    reached = F.size(F.filter(F.lit(steps), lambda g: g <= F.col(score).cast("double")))
    counts = df.groupBy(*by, F.col(y_true).alias("y_true"), reached.alias("_sf_r")).agg(F.count("*").alias("_sf_n"))
    ladder = F.array(*[
        F.struct(F.lit(g).alias("threshold"), F.lit(given.index(g)).alias("position"), F.lit(i).alias("_sf_i"))
        for i, g in enumerate(steps)
    ])
    wide = counts.select(*by, "y_true", "_sf_r", "_sf_n", F.inline(ladder))
    keys = [*by, "threshold", "position"]
    pred = (F.col("_sf_r") > F.col("_sf_i")).cast("int")
    pairs = wide.groupBy(*keys, "y_true", pred.alias("y_pred")).agg(F.sum("_sf_n").alias("n"))
    return summary_of_classes(classes_of_counts(pairs, keys), keys)


def best_threshold(table: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The grid row with the best metrics in the given priority, earliest in the grid on ties."""
    order = F.struct(*[metric_column(table, m).alias(f"m{i}") for i, m in enumerate(metrics)], (-F.col("position")).alias("p"))
    keep = [c for c in table.columns if c not in by]
    best = table.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("_sf_best"))
    return best.select(*by, "_sf_best.*")


def tuned_or_native(df: DataFrame, grid: Sequence[float], metrics: Sequence[str]) -> DataFrame:
    """One row: the chosen threshold with its metrics, or a null threshold with the native ones.

    Native predictions (``y_pred``) stay when they are at least as good.
    """
    pick = best_threshold(threshold_table(df, grid), metrics).drop("position")
    native = summary(df).withColumn("threshold", F.lit(None).cast("double"))
    both = native.withColumn("_sf_native", F.lit(1)).unionByName(pick.withColumn("_sf_native", F.lit(0)))
    ranks = [*metrics, "accuracy"]
    order = F.struct(*[metric_column(both, m).alias(f"m{i}") for i, m in enumerate(ranks)], "_sf_native")
    keep = [c for c in both.columns if c != "_sf_native"]
    return both.agg(F.max_by(F.struct(*keep), order).alias("b")).select("b.*")


def minmax_scores(df: DataFrame, raw: str, out: str = "score") -> DataFrame:
    """Decision values scaled to [0, 1] over the whole frame; 0.5 for all when they do not vary."""
    ends = df.agg(F.min(raw).cast("double").alias("lo"), F.max(raw).cast("double").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None or hi - lo <= 1e-12:
        return df.withColumn(out, F.lit(0.5))
    return df.withColumn(out, (F.col(raw).cast("double") - F.lit(lo)) / F.lit(hi - lo))


def argmax_class(probabilities: Column) -> Column:
    """Index of the largest probability, the first on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def overfit_gap(df: DataFrame) -> DataFrame:
    """(accuracy_train, accuracy_val, overfit_gap) of a frame with a ``split`` column."""
    acc = summary(df, ["split"]).select("split", "accuracy")
    pick = {s: F.max(F.when(F.col("split") == s, F.col("accuracy"))) for s in ("train", "val")}
    return acc.agg(pick["train"].alias("accuracy_train"), pick["val"].alias("accuracy_val")).withColumn(
        "overfit_gap", F.col("accuracy_train") - F.col("accuracy_val")
    )


def overfit_note(gap: Column) -> Column:
    """Text for the gap between the last training and validation accuracy."""
    text = fixed(gap, 3)
    return F.when(gap > 0.1, F.concat(F.lit("possible_overfit_gap="), text)).otherwise(
        F.concat(F.lit("train_val_gap_stable="), text)
    )


def gap_warning(gap: Column, limit: float = 0.05) -> Column:
    """Report sentence for the largest train/validation gap."""
    head = F.when(gap >= limit, F.lit("High overfitting risk detected")).otherwise(F.lit("Overfitting risk acceptable"))
    return F.concat(head, F.lit(": max gap="), fixed(gap, 4), F.lit(f" (threshold={limit:.4f})."))


def high_score_note(accuracy: Column, ablation_min: Column) -> Column:
    """Note for suspiciously high accuracy, given the lowest accuracy over ablations (null: none ran)."""
    return F.when(
        accuracy >= 0.95,
        F.when(ablation_min.isNull(), "high_score_requires_additional_risk_check")
        .when(ablation_min >= 0.95, "high_score_persists_across_ablations")
        .otherwise("high_score_sensitive_to_feature_subset"),
    )


def risk_note(gap: Column | None, accuracy: Column, ablation_min: Column) -> Column:
    """Both notes joined by "; ", or a neutral text when neither applies."""
    parts = [high_score_note(accuracy, ablation_min)]
    if gap is not None:
        parts.insert(0, F.when(gap.isNotNull(), overfit_note(gap)))
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "no_major_overfit_signal_detected").otherwise(text)
