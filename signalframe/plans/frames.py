"""Input frames of the driver queries, and the same frames as SQL common table expressions.

Every frame is a projection, join or aggregation of the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WIDTH = 64
NAMES = [f"e_{i}" for i in range(WIDTH)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, features: the embedding table as labelled waveforms."""
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("features")
    )


# One row per vector element.
SQL_CELLS = """cells AS (
  SELECT vec_id, label, CAST(v AS DOUBLE) AS v, i
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
)"""

# Stratified 70/15/15 split of the vectors, seed 7: the same quota rules and the same md5 order.
SQL_SPLIT = """ranked AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || vec_id)) AS rn,
         count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total
  FROM embeddings
), sized AS (
  SELECT *, greatest(1, least(round_even(total * 0.7, 0), total - 2)) AS n_train FROM ranked
), sized2 AS (
  SELECT *, greatest(1, least(round_even(total * 0.15, 0), total - n_train - 1)) AS n_val FROM sized
), quota AS (
  SELECT *, greatest(1, round_even(n * n_val / total, 0)) AS q_val,
         greatest(1, round_even(n * n_train / total, 0)) AS q_train0 FROM sized2
), quota2 AS (
  SELECT *, CASE WHEN n - q_train0 - q_val <= 0 THEN n - q_val - 1 ELSE q_train0 END AS q_train FROM quota
), split AS (
  SELECT vec_id, label, CASE WHEN rn <= q_train THEN 'train' WHEN rn <= q_train + q_val THEN 'val' ELSE 'test' END AS split
  FROM quota2
)"""

# z-scored elements with their split; the scaler is fitted on train rows.
SQL_SCALED = (
    SQL_CELLS + ", " + SQL_SPLIT + """, scaler AS (
  SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM cells JOIN split USING (vec_id) WHERE split = 'train' GROUP BY i
), scaled AS (
  SELECT c.vec_id, c.label, s.split, c.i, (c.v - k.mu) / CASE WHEN k.sd < 1e-12 THEN 1.0 ELSE k.sd END AS z
  FROM cells c JOIN split s USING (vec_id) JOIN scaler k USING (i)
)"""
)

# Class separation score of every element on scaled train rows.
SQL_FISHER = (
    SQL_SCALED + """, per AS (
  SELECT i, label, count(*) AS n, avg(z) AS mean, var_pop(z) AS var FROM scaled WHERE split = 'train' GROUP BY i, label
), mu AS (
  SELECT i, sum(n * mean) / sum(n) AS mu FROM per GROUP BY i
), fisher AS (
  SELECT i, sum(n * (mean - mu) * (mean - mu)) / greatest(sum(n * var), 1e-8) AS score FROM per JOIN mu USING (i) GROUP BY i
)"""
)


def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a deterministic score and prediction: doc_id, y_true, y_pred, score, split."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels")
    n = F.col("n_chars").cast("double")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("y_true"),
        (n / (n + 2000.0)).alias("score"),
        (F.col("n_chars") % 7 > 1).cast("int").alias("y_pred"),
        F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"),
    )


SQL_SCORED = """scored AS (
  SELECT d.doc_id, CAST(l.quality AS INT) AS y_true, d.n_chars / (d.n_chars + 2000.0::DOUBLE) AS score,
         CASE WHEN d.n_chars % 7 > 1 THEN 1 ELSE 0 END AS y_pred,
         CASE d.doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
  FROM documents d JOIN labels l USING (doc_id)
)"""


def task_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks in long form; a document without labels has y_true -1: doc_id, task, y_true, y_pred."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels")
    both = docs.join(labels, "doc_id", "left")
    return both.select(
        "doc_id",
        F.inline(F.array(
            F.struct(F.lit("quality").alias("task"), F.coalesce("quality", F.lit(-1)).cast("int").alias("y_true"),
                     (F.col("n_chars") % 7 > 1).cast("int").alias("y_pred")),
            F.struct(F.lit("toxic").alias("task"), F.coalesce("toxic", F.lit(-1)).cast("int").alias("y_true"),
                     (F.col("n_chars") % 11 == 0).cast("int").alias("y_pred")),
        )),
    )


SQL_TASKS = """tasks AS (
  SELECT d.doc_id, 'quality' AS task, CAST(coalesce(l.quality, -1) AS INT) AS y_true, CASE WHEN d.n_chars % 7 > 1 THEN 1 ELSE 0 END AS y_pred
  FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL
  SELECT d.doc_id, 'toxic', CAST(coalesce(l.toxic, -1) AS INT), CASE WHEN d.n_chars % 11 = 0 THEN 1 ELSE 0 END
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

# Model names by supplier remainder, with their family (fixed values).
MODELS = ("random_forest", "logistic_regression", "bagged_logistic_regression", "cnn_1d", "cnn_lstm")


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """A run history: one run per (supplier, line number) with scores aggregated from the line items."""
    def hundredths(c: str):
        return F.round(F.col(c) * 100).cast("bigint")

    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey", "l_linenumber").agg(
        # Whole hundredths are summed, so the scores do not depend on the order of summation.
        (F.sum(hundredths("l_discount")) / (F.lit(10.0) * F.count("*"))).alias("accuracy"),
        (F.sum(hundredths("l_tax")) * 12.0 / (F.lit(100.0) * F.count("*"))).alias("f1"),
        F.round(F.max("l_discount") * 10, 6).alias("train_accuracy"),
        F.round(F.min("l_tax") * 12, 6).alias("minority_f1"),
        F.max("l_returnflag").alias("flag"),
    )
    s = F.col("l_suppkey")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (s % 5 + 1).cast("int"))
    return g.select(
        F.concat(F.lit("runs/"), s, F.lit("/"), F.col("l_linenumber")).alias("run_dir"),
        F.concat(F.lit("ds_"), s % 7).alias("dataset"),
        F.concat(F.lit("task_"), F.col("l_linenumber")).alias("task_name"),
        model.alias("model_name"),
        F.when(s % 5 < 3, "ml").otherwise("dl").alias("model_family"),
        (F.lit(42) + F.lit(10) * (s % 2)).cast("int").alias("seed"),
        F.when(s % 3 == 0, "pretrain").otherwise("single_task").alias("mode"),
        F.when(s % 4 == 0, "freeze").when(s % 4 == 1, "").otherwise(F.lit(None)).alias("transfer_strategy"),
        "accuracy", "f1", F.col("f1").alias("macro_f1"), "minority_f1", "train_accuracy",
        F.col("l_linenumber").cast("int").alias("line"), s.alias("supp"),
    )


SQL_RUNS = """runs AS (
  SELECT 'runs/' || l_suppkey || '/' || l_linenumber AS run_dir, 'ds_' || (l_suppkey % 7) AS dataset,
         'task_' || l_linenumber AS task_name,
         CASE l_suppkey % 5 WHEN 0 THEN 'random_forest' WHEN 1 THEN 'logistic_regression'
              WHEN 2 THEN 'bagged_logistic_regression' WHEN 3 THEN 'cnn_1d' ELSE 'cnn_lstm' END AS model_name,
         CASE WHEN l_suppkey % 5 < 3 THEN 'ml' ELSE 'dl' END AS model_family,
         CAST(42 + 10 * (l_suppkey % 2) AS INT) AS seed,
         CASE WHEN l_suppkey % 3 = 0 THEN 'pretrain' ELSE 'single_task' END AS mode,
         CASE WHEN l_suppkey % 4 = 0 THEN 'freeze' WHEN l_suppkey % 4 = 1 THEN '' END AS transfer_strategy,
         sum(round(l_discount * 100)::BIGINT)::DOUBLE / (10.0::DOUBLE * count(*)) AS accuracy,
         sum(round(l_tax * 100)::BIGINT)::DOUBLE * 12.0::DOUBLE / (100.0::DOUBLE * count(*)) AS f1,
         sum(round(l_tax * 100)::BIGINT)::DOUBLE * 12.0::DOUBLE / (100.0::DOUBLE * count(*)) AS macro_f1,
         round(min(l_tax) * 12, 6) AS minority_f1, round(max(l_discount) * 10, 6) AS train_accuracy,
         CAST(l_linenumber AS INT) AS line, l_suppkey AS supp
  FROM lineitem GROUP BY l_suppkey, l_linenumber
)"""
