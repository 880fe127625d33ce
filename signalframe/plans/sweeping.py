"""Sweep queries with real numbers: models of one feature, whose Newton steps SQL can take too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, newton, sweeps
from ..operators.split import fold_rows
from ..session import cut_lineage
from .frames import SQL_SPLIT, vectors
from .modeling import IDS, SQL_HEAVIER, heavier
from .ranking import split_vectors
from .registry import query

FEW = 4
LAYOUT_NAMES = ["bandwidth", "SU1_cov_flat_0", "SU1_temporal_cov_0"]
LAYOUTS = ("basic_only", "cov_flat_only", "temporal_cov_only")
FRACTIONS = (0.02, 0.1, 0.5, 1.0)
STEPS = 25

SQL_FOLDS = f"""ranked AS (
  SELECT vec_id, embedding, {SQL_HEAVIER} AS y FROM embeddings
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || vec_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM ranked
), folds AS (
  SELECT vec_id, embedding, y, (SELECT count(*) FROM range(1, 5) r(j) WHERE rn > (n // 5) * j + least(n % 5, j)) AS fold FROM placed
)"""
SQL_PARTS = f"""{SQL_SPLIT}, parts AS (
  SELECT vec_id, embedding, split, {SQL_HEAVIER} AS y FROM split JOIN embeddings USING (vec_id)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY split = 'train' ORDER BY md5('42|' || vec_id)) AS rn, count(*) OVER (PARTITION BY split = 'train') AS n FROM parts
)"""


def newton_sql(fits: str, scored: str, steps: int = STEPS) -> str:
    """Tables ``model(fit, coefficient, intercept)`` and ``judged(fit, tag, n, hits)``; ``fits`` and ``scored`` are selects of (fit, x, y) and (fit, tag, x, y)."""
    def step(r: int) -> str:
        return f"""s{r + 1} AS MATERIALIZED (
  SELECT fit, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
    SELECT fit, a, b, sum(w * (p - y) * z) / sum(w) + any_value(pen) * a AS ga, sum(w * (p - y)) / sum(w) AS gb,
      sum(w * p * (1 - p) * z * z) / sum(w) + any_value(pen) AS haa, sum(w * p * (1 - p) * z) / sum(w) AS hab, sum(w * p * (1 - p)) / sum(w) AS hbb
    FROM (SELECT z.*, a, b, 1 / (1 + exp(-(a * z + b))) AS p FROM z JOIN s{r} USING (fit)) GROUP BY fit, a, b))"""

    return f"""fits AS MATERIALIZED ({fits}), scored AS ({scored}),
weighted AS (SELECT *, n / (count(DISTINCT y) OVER (PARTITION BY fit) * count(*) OVER (PARTITION BY fit, y)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY fit) AS n FROM fits)),
mean AS (SELECT fit, any_value(n) AS n, sum(w * x) / sum(w) AS mu, sum(w) - sum(w * w) / sum(w) AS free FROM weighted GROUP BY fit),
deviation AS (SELECT m.fit, any_value(mu) AS mu, 1.0::DOUBLE / any_value(m.n) AS pen, sqrt(sum(w * (x - mu) * (x - mu)) / any_value(free)) AS sd FROM weighted JOIN mean m USING (fit) GROUP BY m.fit),
z AS MATERIALIZED (SELECT fit, y, w, pen, (x - mu) / sd AS z FROM weighted JOIN deviation USING (fit)),
s0 AS (SELECT fit, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM deviation),
{", ".join(step(r) for r in range(steps))},
model AS (SELECT fit, a / sd AS coefficient, b - a / sd * mu AS intercept FROM s{steps} JOIN deviation USING (fit)),
judged AS (SELECT fit, tag, count(*) AS n, sum((coefficient * x + intercept > 0)::INT = y)::BIGINT AS hits FROM scored JOIN model USING (fit) GROUP BY fit, tag)"""


_X = "embedding[{}]::DOUBLE"


def labelled(spark, d):
    """The first few elements and whether two of them outweigh two others."""
    return vectors(spark, d).select("vec_id", F.slice("features", 1, FEW).alias("features"), heavier().alias("y"))


def trained(spark, d):
    v = split_vectors(spark, d).select("vec_id", "split", F.slice("features", 1, FEW).alias("features"), heavier().alias("y"))
    v = cut_lineage(v)
    return [v.where(F.col("split") == s) for s in ("train", "val", "test")]


def one(df, i: int = 0):
    return df.withColumn("features", F.slice("features", i + 1, 1))


def rounded(c, digits: int = 9):
    return F.round(c, digits).alias(c)


@query("fold_coefficients", "EXP-1 MDL-3",
       f"""WITH {SQL_FOLDS}, {newton_sql(f"SELECT e * 5 + j AS fit, CASE e WHEN 0 THEN {_X.format(1)} ELSE {_X.format(3)} END AS x, y FROM folds, range(2) r(e), range(5) f(j) WHERE fold <> j",
                                         "SELECT 0 AS fit, '' AS tag, 0.0::DOUBLE AS x, 0 AS y")}
SELECT CAST(fit AS INT) AS fit, round(coefficient, 6) AS coefficient, round(intercept, 6) + 0.0 AS intercept FROM model""")
def fold_coefficients(spark, d):
    """Coefficients of ten models, five folds of two recipes, advanced together."""
    folds = cut_lineage(fold_rows(labelled(spark, d), IDS, "y", 5, 42).withColumn("masks", F.array(*(F.col("fold") != j for j in range(5)))))
    found = newton.fit_all(folds, [newton.Fit(j, (c,)) for c in (0, 2) for j in range(5)], 5, 2, FEW)
    rows = [(i, float(m.coefficients[0, 0]), float(m.intercepts[0])) for i, m in enumerate(found)]
    out = spark.createDataFrame(rows, "fit int, coefficient double, intercept double")
    return out.select("fit", rounded("coefficient", 6), (F.round("intercept", 6) + 0.0).alias("intercept"))


@query("cross_validation_scores", "EXP-1",
       f"""WITH {SQL_FOLDS}, {newton_sql(f"SELECT j AS fit, {_X.format(1)} AS x, y FROM folds, range(5) f(j) WHERE fold <> j",
                                         f"SELECT fold AS fit, 'test' AS tag, {_X.format(1)} AS x, y FROM folds")}
SELECT CAST(fit AS INT) AS fold, 'logistic_regression' AS model_name, round(hits::DOUBLE / n, 9) AS accuracy FROM judged""")
def cross_validation_scores(spark, d):
    table = models.cross_validate(one(labelled(spark, d)), "logistic_regression", 2, 1, 5, 42, None, IDS)
    return table.select("fold", "model_name", rounded("accuracy"))


@query("learning_curve_scores", "EXP-2",
       f"""WITH {SQL_PARTS}, f AS (SELECT unnest([{", ".join(map(str, FRACTIONS))}]::DOUBLE[]) AS fit),
cut AS (SELECT ordered.*, fit, split <> 'train' OR rn <= greatest(2, round_even(n * fit, 0)) AS inside FROM ordered, f),
{newton_sql(f"SELECT fit, {_X.format(1)} AS x, y FROM cut WHERE split = 'train' AND inside", f"SELECT fit, split AS tag, {_X.format(1)} AS x, y FROM cut WHERE inside")}
SELECT fit AS fraction, tag AS split, round(hits::DOUBLE / n, 9) AS accuracy FROM judged""")
def learning_curve_scores(spark, d):
    table = models.learning_curve(*map(one, trained(spark, d)), "logistic_regression", 2, 1, FRACTIONS, 42, None, IDS)
    return table.select("fraction", "split", rounded("accuracy"))


@query("train_ratio_scores", "EXP-5",
       f"""WITH {SQL_PARTS}, f AS (SELECT unnest([0.1, 0.4, 1.0]::DOUBLE[]) AS fit),
cut AS (SELECT ordered.*, fit, split <> 'train' OR rn <= greatest(2, round_even(n * fit, 0)) AS inside FROM ordered, f),
{newton_sql(f"SELECT fit, {_X.format(2)} AS x, y FROM cut WHERE split = 'train' AND inside", f"SELECT fit, split AS tag, {_X.format(2)} AS x, y FROM cut WHERE split = 'test'")}
SELECT fit AS train_ratio, round(hits::DOUBLE / n, 9) AS accuracy FROM judged""")
def train_ratio_scores(spark, d):
    train, _, test = (one(p, 1) for p in trained(spark, d))
    table = sweeps.train_ratios(train, test, "logistic_regression", 2, 1, (1.0, 0.1, 0.4, 1.7, -1.0), 42, IDS)
    return table.select("train_ratio", rounded("accuracy"))


@query("layout_ablation_scores", "EXP-3",
       f"""WITH {SQL_PARTS}, {newton_sql(f"SELECT e AS fit, embedding[e + 1]::DOUBLE AS x, y FROM parts, range(3) r(e) WHERE split = 'train'",
                                         f"SELECT e AS fit, split AS tag, embedding[e + 1]::DOUBLE AS x, y FROM parts, range(3) r(e) WHERE split = 'test'")}
SELECT (['basic_only', 'cov_flat_only', 'temporal_cov_only'])[fit + 1] AS layout, CAST(fit AS INT) AS position, round(hits::DOUBLE / n, 9) AS accuracy FROM judged""")
def layout_ablation_scores(spark, d):
    train, _, test = (p.withColumn("features", F.slice("features", 1, 3)) for p in trained(spark, d))
    table = models.layout_ablation(train, test, LAYOUT_NAMES, LAYOUTS, "logistic_regression", 2, 42, None, IDS)
    return table.select("layout", "position", rounded("accuracy"))


@query("recipe_scores", "EXP-6",
       f"""WITH {SQL_FOLDS}, {newton_sql(f"SELECT e * 5 + j AS fit, CASE e WHEN 0 THEN {_X.format(1)} ELSE {_X.format(3)} END AS x, y FROM folds, range(2) r(e), range(5) f(j) WHERE fold <> j",
                                         f"SELECT e * 5 + fold AS fit, 'test' AS tag, CASE e WHEN 0 THEN {_X.format(1)} ELSE {_X.format(3)} END AS x, y FROM folds, range(2) r(e)")},
common AS (SELECT j, CASE WHEN sum(y) > count(*) - sum(y) THEN 1 ELSE 0 END AS top FROM folds, range(5) f(j) WHERE fold <> j GROUP BY j),
every AS (
  SELECT fit // 5 AS e, 'logistic_regression' AS model_name, hits::DOUBLE / n AS accuracy FROM judged
  UNION ALL SELECT e, 'majority', avg((y = top)::INT::DOUBLE) FROM folds JOIN common ON j = fold, range(2) r(e) GROUP BY e, fold)
SELECT CASE e WHEN 0 THEN 'first' ELSE 'third' END AS recipe, model_name, round(avg(accuracy), 9) AS cv_mean, round(stddev_pop(accuracy), 9) AS cv_std FROM every GROUP BY ALL""")
def recipe_scores(spark, d):
    table = models.recipe_comparison(labelled(spark, d), {"first": [0], "third": [2]}, ["majority", "logistic_regression"], 2, 5, 42, None, IDS)
    return table.select("recipe", "model_name", rounded("cv_mean"), rounded("cv_std"))
