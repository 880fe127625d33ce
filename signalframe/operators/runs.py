"""Tables of experiment runs: best-of tables, rankings, means, histories, grids.

Best rows are picked by ``min_by``/``max_by`` aggregates instead of windows, so a dataset or task
with a third of all runs is still combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import fixed, signed_fixed
from .evaluate import metric_column
from .ordering import join_groups

# Fields of a run record and of a benchmark record, in order: (name, default) (fixed values).
RUN_FIELDS = (
    ("alias", ""), ("run_dir", ""), ("prepared_dir", ""), ("dataset", "dataset"), ("task_name", "task"), ("target_column", "label"),
    ("model_name", "model"), ("selected_baseline", None), ("model_family", "ml"), ("seed", 42),
    ("primary_metric", "accuracy"), ("primary_score", 0.0), ("secondary_metric", "f1"), ("secondary_score", 0.0),
    ("accuracy", 0.0), ("f1", 0.0), ("macro_f1", 0.0), ("minority_f1", 0.0), ("precision", 0.0), ("recall", 0.0),
    ("threshold", ""), ("risk_note", ""), ("resolved_device", ""), ("overfit_gap", 0.0),
)
BENCHMARK_FIELDS = (
    ("config", ""), ("run_dir", ""), ("dataset", "dataset"), ("task_name", "task"), ("target_column", "label"),
    ("model_name", "model"), ("selected_baseline", None), ("model_family", "ml"), ("seed", 42), ("mode", "single_task"),
    ("transfer_strategy", ""), ("pretrain_objective", ""), ("accuracy", 0.0), ("f1", 0.0), ("macro_f1", None),
    ("minority_f1", 0.0), ("minority_precision", 0.0), ("minority_recall", 0.0), ("precision", 0.0), ("recall", 0.0),
    ("threshold", ""), ("risk_note", ""),
)


def _with_default(df: DataFrame, name: str, default) -> Column:
    have = F.col(name) if name in df.columns else F.lit(None)
    if isinstance(default, float):
        return F.coalesce(have.try_cast("double"), F.lit(default))
    if isinstance(default, int):
        return F.coalesce(have.try_cast("int"), F.lit(default))
    return F.coalesce(have.cast("string"), F.lit(default))


def run_records(df: DataFrame) -> DataFrame:
    """Run rows with all 24 fields.

    Defaults fill gaps, the baseline falls back to the model, and the primary and secondary scores
    are looked up under the metric each run names.
    """
    out = {n: _with_default(df, n, v) for n, v in RUN_FIELDS}
    if "alias" not in df.columns:
        out["alias"] = F.element_at(F.split(out["run_dir"], "/"), -1)
    out["selected_baseline"] = F.coalesce(out["selected_baseline"], out["model_name"])
    for which in ("primary", "secondary"):
        named = out[f"{which}_metric"]
        score = F.lit(0.0)
        for m in ("accuracy", "f1", "macro_f1", "minority_f1", "precision", "recall"):
            score = F.when(named.isin(m, m.replace("_", "-")), metric_column(df, m)).otherwise(score)
        out[f"{which}_score"] = score
    return df.select(*[out[n].alias(n) for n, _ in RUN_FIELDS])


def benchmark_records(df: DataFrame) -> DataFrame:
    """Benchmark rows with all 22 fields."""
    out = {n: _with_default(df, n, v) for n, v in BENCHMARK_FIELDS}
    out["selected_baseline"] = F.coalesce(out["selected_baseline"], out["model_name"])
    out["macro_f1"] = F.coalesce(F.col("macro_f1").try_cast("double") if "macro_f1" in df.columns else F.lit(None), out["f1"])
    return df.select(*[out[n].alias(n) for n, _ in BENCHMARK_FIELDS])


def config_value(config: str, section: str, key: str) -> Column:
    """A value of a two-level configuration text: JSON, or a block of ``section:`` with indented ``key: value`` lines; null if missing."""
    text = F.col(config)
    # A section's lines are indented; the key is looked for among them only.
    block = F.regexp_extract(text, rf"(?m)^{section}:[ \t]*$((?:\r?\n(?:[ \t].*)?)*)", 1)
    plain = F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^[ \t]+{key}:[ \t]*(.*?)[ \t\r]*$", 1)), F.lit(""))
    plain = F.regexp_replace(plain, r"""^(["'])(.*)\1$""", "$2")
    plain = F.when(~F.lower(plain).isin("null", "~"), plain)
    return F.when(text.startswith("{"), F.try_variant_get(F.try_parse_json(text), f"$.{section}.{key}", "string")).otherwise(plain)


def metric_value(metrics: str, name: str, kind: str = "string") -> Column:
    """A top-level value of a JSON text; null if missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(F.col(metrics)), f"$.{name}", kind)


def _number(metrics: str, name: str) -> Column:
    """A metric as a number: 0.0 where it is missing or text."""
    text = metric_value(metrics, name)
    quoted = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(metrics)), f"$.{name}", "variant")) == "STRING"
    return F.coalesce(F.when(~quoted, F.coalesce(text.try_cast("double"), F.when(text == "true", 1.0))), F.lit(0.0))


def _by_name(metrics: str, metric: Column) -> Column:
    names = ("accuracy", "f1", "macro_f1", "minority_f1", "minority_precision", "minority_recall", "positive_f1", "positive_precision", "positive_recall", "precision", "recall")
    score = F.lit(0.0)
    for n in names:
        # only the combined names have a spelling with a hyphen
        score = F.when(metric.isin(n, n.replace("_", "-")), _number(metrics, n)).otherwise(score)
    return score


def run_rows(files: DataFrame) -> DataFrame:
    """The 24 fields of run records from (origin, metrics, config) texts."""
    m = lambda n, default: F.coalesce(metric_value("metrics", n), default)
    c = lambda s, k, default: F.coalesce(config_value("config", s, k), F.lit(default))
    model = m("model_name", c("model", "name", "model"))
    primary, secondary = c("task", "metric_primary", "accuracy"), c("task", "metric_secondary", "f1")
    out = {
        "alias": F.element_at(F.split("origin", "/"), -1), "run_dir": F.col("origin"), "prepared_dir": c("runtime", "prepared_dir", ""),
        "dataset": c("dataset", "name", "dataset"), "task_name": m("task_name", c("task", "task_name", "task")),
        "target_column": m("target_column", c("task", "target_column", "label")), "model_name": model, "selected_baseline": m("selected_baseline", model),
        "model_family": m("model_family", F.lit("ml")), "seed": F.coalesce(config_value("config", "trainer", "random_state").try_cast("int"), F.lit(42)),
        "primary_metric": primary, "primary_score": _by_name("metrics", primary), "secondary_metric": secondary, "secondary_score": _by_name("metrics", secondary),
        **{n: _number("metrics", n) for n in ("accuracy", "f1", "macro_f1", "minority_f1", "precision", "recall", "overfit_gap")},
        **{n: m(n, F.lit("")) for n in ("threshold", "risk_note", "resolved_device")},
    }
    return files.select(*(out[n].alias(n) for n, _ in RUN_FIELDS))


def benchmark_rows(files: DataFrame) -> DataFrame:
    """The 22 fields of benchmark records from (origin, metrics, config) texts; ``config`` is the name of the run directory."""
    m = lambda n, default: F.coalesce(metric_value("metrics", n), F.lit(default) if isinstance(default, str) else default)
    c = lambda s, k, default: F.coalesce(config_value("config", s, k), F.lit(default))
    model = m("model_name", "model")
    out = {
        "config": F.element_at(F.split("origin", "/"), -1), "run_dir": F.col("origin"), "dataset": c("dataset", "name", "dataset"), "task_name": m("task_name", "task"),
        "target_column": m("target_column", "label"), "model_name": model, "selected_baseline": m("selected_baseline", model), "model_family": m("model_family", "ml"),
        "seed": F.coalesce(config_value("config", "trainer", "random_state").try_cast("int"), F.lit(42)), "mode": m("run_mode", c("model", "mode", "single_task")),
        "macro_f1": F.when(metric_value("metrics", "macro_f1").isNotNull(), _number("metrics", "macro_f1")).otherwise(_number("metrics", "f1")),
        **{n: m(n, "") for n in ("transfer_strategy", "pretrain_objective", "threshold", "risk_note")},
        **{n: _number("metrics", n) for n in ("accuracy", "f1", "minority_f1", "minority_precision", "minority_recall", "precision", "recall")},
    }
    return files.select(*(out[n].alias(n) for n, _ in BENCHMARK_FIELDS))


def sort_runs(df: DataFrame, primary: str = "accuracy", secondary: str = "f1") -> DataFrame:
    return df.orderBy("dataset", "task_name", F.desc(primary), F.desc(secondary))


def best_per(df: DataFrame, keys: Sequence[str], scores: Sequence[str], columns: Sequence[str], tie: str = "run_dir") -> DataFrame:
    """The best run per key by the scores in order, smallest ``tie`` last."""
    order = F.struct(*[(-F.col(s)).alias(f"s{i}") for i, s in enumerate(scores)], F.col(tie).alias("t"))
    keep = [c for c in columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), order).alias("_sf_b")).select(*keys, "_sf_b.*").select(*columns)


def best_overall(df: DataFrame, scores: Sequence[str], tie: str = "run_dir") -> DataFrame:
    return df.orderBy(*[F.desc(s) for s in scores], tie).limit(1)


def benchmark_ranking(df: DataFrame, rows: int = 5, score: str = "accuracy", tie: str = "run_dir") -> DataFrame:
    """The ``rows`` best runs with their rank.  A top-k first; the window numbers only what is left."""
    top = df.orderBy(F.desc(score), tie).limit(rows)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), tie)))


def highlights(df: DataFrame, tie: str = "run_dir") -> DataFrame:
    """(metric, model_name, task_name, value): the leaders by accuracy and macro-F1, task and run counts."""
    def leader(m: str) -> Column:
        order = F.struct((-F.col(m)).alias("s"), F.col(tie).alias("t"))
        return F.min_by(F.struct(F.lit(m).alias("metric"), "model_name", "task_name", F.col(m).cast("double").alias("value")), order)

    counts = df.select("task_name").where("task_name IS NOT NULL AND task_name <> ''").distinct().agg(F.count("*").cast("double").alias("v"))
    lead = df.agg(leader("accuracy").alias("a"), leader("macro_f1").alias("m"), F.count("*").cast("double").alias("n"))
    none = F.lit(None).cast("string")
    runs = F.struct(F.lit("runs").alias("metric"), none.alias("model_name"), none.alias("task_name"), F.col("n").alias("value"))
    tasks = counts.select(F.lit("tasks").alias("metric"), none.alias("model_name"), none.alias("task_name"), F.col("v").alias("value"))
    return lead.select(F.inline(F.array("a", "m", runs))).unionByName(tasks)


def family_means(df: DataFrame, metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    return df.groupBy("model_family").agg(*[F.avg(m).alias(m) for m in metrics])


def pivot_means(df: DataFrame, rows: str, column: str, metric: str, values: Sequence[str], blank: str, row_blank: str | None = None) -> DataFrame:
    """Mean of ``metric`` per (rows, column value), one output column per value, 0.0 where empty.

    A missing or empty column value counts as ``blank``.
    """
    cell = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    key = F.col(rows) if row_blank is None else F.coalesce(rows, F.lit(row_blank))
    return df.groupBy(key.alias(rows)).agg(*[
        F.coalesce(F.avg(F.when(cell == v, F.col(metric))), F.lit(0.0)).alias(v) for v in values
    ])


def strategy_rows(df: DataFrame, column: str = "transfer_strategy", blank: str = "scratch") -> DataFrame:
    """Runs with a ``strategy`` column; no rows at all unless there are two strategies to compare."""
    named = df.withColumn("strategy", F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank)))
    several = named.agg(F.min("strategy").alias("a"), F.max("strategy").alias("b")).select((F.col("a") < F.col("b")).alias("s")).scalar()
    return named.where(several)


def cross_dataset_summary(df: DataFrame, tie: str = "run_dir") -> DataFrame:
    """(dataset_count, best_dataset, best_accuracy, mean_accuracy, worst_accuracy); zeros when empty.

    ``dataset_count`` counts records.
    """
    valid = df.where(F.col("dataset").isNotNull() & F.col("accuracy").isNotNull())
    order = F.struct((-F.col("accuracy")).alias("s"), F.col(tie).alias("t"))
    zero = F.lit(0.0)
    return valid.agg(
        F.count("*").alias("dataset_count"), F.coalesce(F.min_by("dataset", order), F.lit("N/A")).alias("best_dataset"),
        F.coalesce(F.max("accuracy"), zero).alias("best_accuracy"), F.coalesce(F.avg("accuracy"), zero).alias("mean_accuracy"),
        F.coalesce(F.min("accuracy"), zero).alias("worst_accuracy"),
    )


def cv_summary(df: DataFrame, metric: str = "accuracy", by: Sequence[str] = ("model_name",)) -> DataFrame:
    """(by..., cv_mean, cv_std) over numbered folds; population std."""
    numbered = df.where(F.col("fold").cast("string").try_cast("double").isNotNull())
    m = F.col(metric).try_cast("double")
    return numbered.groupBy(*by).agg(F.avg(m).alias("cv_mean"), F.stddev_pop(m).alias("cv_std"))


def cv_aggregate(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.coalesce(F.max("cv_mean"), F.lit(0.0)).alias("best_cv_mean"), F.coalesce(F.avg("cv_std"), F.lit(0.0)).alias("mean_cv_std")
    )


def with_fold_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Fold rows followed by one ``mean`` and one ``std`` row under the most frequent model name."""
    names = df.groupBy("model_name").agg(F.count("*").alias("n"))
    top = names.agg(F.min_by("model_name", F.struct((-F.col("n")).alias("n"), "model_name")).alias("m")).scalar()
    rows = [
        df.agg(*[f(m).alias(m) for m in metrics]).select(F.lit(tag).alias("fold"), top.alias("model_name"), *metrics)
        for tag, f in (("mean", F.avg), ("std", F.stddev_pop))
    ]
    folds = df.select(F.col("fold").cast("string").alias("fold"), "model_name", *metrics)
    return folds.unionByName(rows[0]).unionByName(rows[1])


def delta_to_first(df: DataFrame, position: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``delta`` to the first record's score, and its report text."""
    by = list(by)
    if by:
        base = df.groupBy(*by).agg(F.min_by(score, position).alias("_sf_base"))
        joined = join_groups(df, base, by)
        first = F.col("_sf_base")
    else:
        joined, first = df, df.agg(F.min_by(score, position).alias("b")).scalar()
    out = joined.withColumn("delta", F.col(score) - first)
    return out.drop("_sf_base") if by else out


def ablation_note(variant: Column, score: Column, delta: Column) -> Column:
    return F.concat(variant, F.lit(": "), fixed(score, 4), F.lit(" (delta "), signed_fixed(delta, 4), F.lit(" vs baseline)"))


def ablation_summary(df: DataFrame, variant: str = "layout", metric: str = "accuracy") -> DataFrame:
    """(variant, score): the metric, else accuracy, else f1; unreadable values count 0."""
    source = next(m for m in (metric, "accuracy", "f1") if m in df.columns)
    return df.select(F.col(variant).cast("string").alias("variant"), F.coalesce(F.col(source).try_cast("double"), F.lit(0.0)).alias("score"))


def history_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per epoch from array columns of a training history.

    Columns used when present: train_loss (or loss), val_loss (or loss), val_accuracy, val_f1,
    train_accuracy, learning_rate; missing series fall back as accuracy -> f1 and to 0.
    """
    have = set(df.columns)

    def series(*names: str) -> Column:
        cols = [F.col(n) for n in names if n in have]
        return F.coalesce(*cols) if cols else F.lit(None).cast("array<double>")

    parts = {
        "train_loss": series("train_loss", "loss"), "val_loss": series("val_loss", "loss"), "accuracy": series("val_accuracy"),
        "f1": series("val_f1", "val_accuracy"), "train_score": series("train_accuracy"), "val_score": series("val_accuracy"),
        "learning_rate": series("learning_rate"),
    }
    packed = df.select(*keys, *[c.alias(f"_sf_{n}") for n, c in parts.items()])
    rows = packed.select("*", F.posexplode("_sf_train_loss").alias("_sf_pos", "_sf_loss"))
    return rows.select(
        *keys, (F.col("_sf_pos") + 1).alias("epoch"),
        *[F.coalesce(F.get(F.col(f"_sf_{n}"), F.col("_sf_pos")), F.lit(0.0)).alias(n) for n in parts],
    )


def single_history_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one-epoch history of a run that recorded none, derived from its final metrics."""
    m = lambda n: metric_column(df, n)
    first = lambda *names: F.coalesce(*[F.col(n).try_cast("double") for n in names if n in df.columns], F.lit(0.0))
    return df.select(
        *keys, F.lit(1).alias("epoch"), (1.0 - first("train_accuracy_score", "accuracy")).alias("train_loss"),
        (1.0 - first("val_f1_score", "f1")).alias("val_loss"), m("accuracy").alias("accuracy"), m("f1").alias("f1"),
        first("train_accuracy_score", "accuracy").alias("train_score"), first("val_accuracy_score", "accuracy").alias("val_score"),
        m("learning_rate").alias("learning_rate"),
    )


def epoch_gaps(df: DataFrame, train: str = "train_score", val: str = "val_score") -> DataFrame:
    return df.withColumn("overfitting_gap", F.col(train) - F.col(val))


def best_and_stop_epoch(df: DataFrame, run: str, patience: int | None, loss: str = "val_loss", score: str | None = None) -> DataFrame:
    """(run, best_epoch, stop_epoch, stopped_early) from epoch rows.

    An epoch improves when its loss is below all before it; with a ``score``, when the score is
    above the best so far, or equal to it with a lower loss than at that best.  Training stops at
    the first epoch that is ``patience`` epochs past the latest improvement.  A run has as many rows
    as epochs, so its history is a small window.
    """
    w = W.partitionBy(run).orderBy("epoch")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    if score is None:
        best = F.min(loss).over(before)
        rows = df.withColumn("_sf_up", best.isNull() | (F.col(loss) < best))
    else:
        key = F.struct(F.col(score).alias("s"), (-F.col(loss)).alias("l"))
        best = F.max(key).over(before)
        rows = df.withColumn("_sf_up", best.isNull() | (key > best))
    rows = rows.withColumn("_sf_last", F.last(F.when(F.col("_sf_up"), F.col("epoch")), ignorenulls=True).over(w))
    limit = F.lit(False) if not patience or patience <= 0 else (F.col("epoch") - F.col("_sf_last") >= patience)
    rows = rows.withColumn("_sf_stop", limit)
    stop = rows.groupBy(run).agg(
        F.min(F.when(F.col("_sf_stop"), F.col("epoch"))).alias("_sf_at"), F.max("epoch").alias("_sf_end"),
        F.collect_set(F.when(F.col("_sf_up"), F.col("epoch"))).alias("_sf_ups"),
    )
    at = F.coalesce("_sf_at", "_sf_end")
    return stop.select(
        run, F.array_max(F.filter("_sf_ups", lambda e: e <= F.coalesce(F.col("_sf_at"), F.col("_sf_end")))).alias("best_epoch"),
        at.alias("stop_epoch"), F.col("_sf_at").isNotNull().alias("stopped_early"),
    )


def experiment_grid(df: DataFrame, task: str, models: Sequence[str], seeds: Sequence[int], modes: Sequence[str],
                    transfers: Sequence[str], pretrainable: Sequence[str], transferable: Sequence[str]) -> DataFrame:
    """(task, model, seed, mode, transfer, label): every valid combination, once.

    Models that cannot be pre-trained keep only the single-task mode; pre-training and models
    without transfer run from scratch.  Each distinct task is expanded by explodes of short lists.
    """
    grid = df.select(F.col(task).alias("task")).distinct()
    grid = grid.withColumn("model", F.explode(F.lit(list(models))))
    can_pretrain = F.col("model").isin(list(pretrainable)) if pretrainable else F.lit(False)
    mode_list = F.filter(F.lit(list(modes)), lambda m: (m == "single_task") | (can_pretrain & (m == "pretrain")))
    fallback = F.when(F.size(mode_list) > 0, mode_list).otherwise(F.array(F.lit("single_task")))
    grid = grid.withColumn("seed", F.explode(F.lit(list(seeds)))).withColumn("mode", F.explode(F.array_distinct(fallback)))
    can_transfer = F.col("model").isin(list(transferable)) if transferable else F.lit(False)
    from_list = F.when((F.col("mode") == "pretrain") | ~can_transfer, F.array(F.lit("scratch"))).otherwise(F.lit(list(transfers)))
    grid = grid.withColumn("transfer", F.explode(F.array_distinct(from_list)))
    label = F.concat_ws(":", "task", "model", F.concat(F.lit("seed="), "seed"), F.concat(F.lit("mode="), "mode"),
                        F.concat(F.lit("transfer="), "transfer"))
    return grid.withColumn("label", label)


def distinct_run_dirs(explicit: DataFrame, referenced: DataFrame, run_dir: str = "run_dir", position: str = "position") -> DataFrame:
    """(run_dir, source): explicit directories first, then referenced ones, every directory once."""
    both = explicit.select(run_dir, F.lit(0).alias("source"), position).unionByName(
        referenced.where(F.col(run_dir).isNotNull()).select(run_dir, F.lit(1).alias("source"), position)
    )
    return both.groupBy(run_dir).agg(F.min(F.struct("source", position)).alias("_sf_f")).select(
        run_dir, F.col("_sf_f.source").alias("source"), F.col(f"_sf_f.{position}").alias(position)
    )


def melt_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def spread_metrics(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def metric_row(df: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "macro_f1", "precision", "recall")) -> DataFrame:
    """Model name and the scores that are present."""
    return df.select("model_name", *[m for m in metrics if m in df.columns])
