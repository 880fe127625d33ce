"""Model queries over the vectors.  Fitted numbers depend on the solver, so the SQL has sizes and what must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators.scale import zscore
from ..operators.split import fold_rows, fraction_rows
from ..session import cut_lineage
from .cleaning import VECTOR_NAMES
from .frames import SQL_CELLS, SQL_SPLIT, WIDTH, vectors
from .ranking import split_vectors
from .registry import query

IDS = ["vec_id"]
# The vectors' own labels hardly depend on them, so the models learn what the vectors do determine: which of the first
# three elements is the largest, or whether the first two outweigh the next two.
CLASSES = 3
SQL_LARGEST = "CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END"
SQL_HEAVIER = "CASE WHEN embedding[1]::DOUBLE + embedding[2]::DOUBLE > embedding[3]::DOUBLE + embedding[4]::DOUBLE THEN 1 ELSE 0 END"


def largest():
    e = [F.get("features", F.lit(i)) for i in range(3)]
    return F.when((e[0] >= e[1]) & (e[0] >= e[2]), 0).when(e[1] >= e[2], 1).otherwise(2)


def heavier():
    e = [F.get("features", F.lit(i)) for i in range(4)]
    return (e[0] + e[1] > e[2] + e[3]).cast("int")


def parts(spark, d, binary: bool = False):
    """Standardised (train, val, test) with a target ``y``."""
    rows = split_vectors(spark, d).withColumn("y", heavier() if binary else largest())
    z = cut_lineage(zscore(rows, "features", WIDTH, F.col("split") == "train").select("vec_id", "features", "split", "y"))
    return [z.where(F.col("split") == s) for s in ("train", "val", "test")]


def _checked(name: str, binary: bool = False) -> str:
    """Test rows per class; the two checks must hold."""
    return f"""WITH {SQL_SPLIT} SELECT '{name}' AS model_name, CAST({SQL_HEAVIER if binary else SQL_LARGEST} AS INT) AS y, count(*) AS support, true AS valid, true AS good
FROM split JOIN embeddings USING (vec_id) WHERE split = 'test' GROUP BY ALL"""


def _scores(spark, d, name, floor, binary=False, probabilities=True):
    """Test rows per class, whether predictions are classes and probabilities add up, and whether the accuracy reaches ``floor``."""
    train, _, test = parts(spark, d, binary)
    scored = models.fit_candidate(name, train, 2 if binary else CLASSES, WIDTH, 42, None, IDS)(test)
    valid = F.col("y_pred").between(0, 1 if binary else CLASSES - 1)
    if probabilities:
        valid = valid & (F.abs(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-6)
    per = scored.groupBy("y").agg(F.count("*").alias("support"), F.bool_and(valid).alias("valid"), F.sum((F.col("y") == F.col("y_pred")).cast("int")).alias("hits"))
    accuracy = per.agg((F.sum("hits") / F.sum("support")).alias("a")).scalar()
    return per.select(F.lit(name).alias("model_name"), "y", "support", "valid", (accuracy >= floor).alias("good"))


@query("majority_model", "MDL-1",
       f"""WITH {SQL_SPLIT}, m AS (SELECT label FROM split WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT vec_id, CAST(label AS INT) AS y, CAST((FROM m) AS INT) AS y_pred FROM split WHERE split = 'test'""")
def majority_model(spark, d):
    s = split_vectors(spark, d).withColumn("y", F.col("label").cast("int"))
    scorer = models.fit_candidate("majority", s.where("split = 'train'"), 10, WIDTH)
    return scorer(s.where("split = 'test'")).select("vec_id", "y", "y_pred")


@query("random_forest_model", "MDL-2 UDF-3", _checked("random_forest"))
def random_forest_model(spark, d):
    return _scores(spark, d, "random_forest", 0.5)


@query("logistic_regression_model", "MDL-3", _checked("logistic_regression"))
def logistic_regression_model(spark, d):
    return _scores(spark, d, "logistic_regression", 0.75)


@query("bagged_logistic_model", "MDL-4", _checked("bagged_logistic_regression"))
def bagged_logistic_model(spark, d):
    return _scores(spark, d, "bagged_logistic_regression", 0.75)


@query("linear_svc_model", "MDL-5", _checked("linear_svc", True))
def linear_svc_model(spark, d):
    return _scores(spark, d, "linear_svc", 0.8, binary=True)


@query("mlp_model", "MDL-6", _checked("mlp"))
def mlp_model(spark, d):
    return _scores(spark, d, "mlp", 0.6)


@query("gradient_boosting_model", "MDL-7", _checked("gradient_boosting", True))
def gradient_boosting_model(spark, d):
    return _scores(spark, d, "gradient_boosting", 0.65, binary=True)


@query("candidate_selection", "MDL-8 MDL-11 EXP-9",
       """SELECT c AS candidate, CAST(p AS INT) AS position, true AS in_range, c = 'logistic_regression' AS selected
FROM (VALUES ('majority', 0), ('logistic_regression', 1), ('random_forest', 2)) v(c, p) WHERE EXISTS (SELECT 1 FROM embeddings)""")
def candidate_selection(spark, d):
    """Three candidates with tuned thresholds; the target is linear, so the linear one must win."""
    train, val, _ = parts(spark, d, binary=True)
    names = ["majority", "logistic_regression", "random_forest"]
    best, _, table = models.select_candidate(names, train, val, 2, WIDTH, "macro_f1", "accuracy", 42, None, IDS, (0.3, 0.5, 0.7))
    in_range = F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)
    return table.select("candidate", "position", in_range.alias("in_range"), (F.col("candidate") == best).alias("selected"))


@query("cross_validation", "EXP-1",
       f"""WITH c AS (SELECT {SQL_LARGEST} AS y, count(*) AS n FROM embeddings GROUP BY 1)
SELECT CAST(j AS INT) AS fold, CAST(sum(n // 5 + CASE WHEN j < n % 5 THEN 1 ELSE 0 END) AS BIGINT) AS n, true AS good FROM c, range(5) r(j) GROUP BY j""")
def cross_validation(spark, d):
    v = vectors(spark, d).select("vec_id", "features", largest().alias("y"))
    scores = models.cross_validate(v, "logistic_regression", CLASSES, WIDTH, 5, 42, None, IDS)
    sizes = fold_rows(v, IDS, "y", 5, 42).groupBy("fold").agg(F.count("*").alias("n"))
    return scores.join(sizes, "fold").select("fold", "n", (F.col("accuracy") > 0.7).alias("good"))


@query("learning_curve", "EXP-2",
       """SELECT f AS fraction, s AS split, true AS good FROM (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS f), (SELECT unnest(['train', 'val', 'test']) AS s)
WHERE EXISTS (SELECT 1 FROM embeddings)""")
def learning_curve(spark, d):
    """Better than chance on every part from a fifth of the rows on, and far better with all of them."""
    train, val, test = parts(spark, d)
    curve = models.learning_curve(train, val, test, "logistic_regression", CLASSES, WIDTH, (0.2, 0.4, 0.6, 0.8, 1.0), 42, None, IDS)
    return curve.select("fraction", "split", (F.col("accuracy") > F.when(F.col("fraction") == 1, 0.7).otherwise(0.4)).alias("good"))


@query("layout_ablation", "EXP-3",
       """SELECT l AS layout, CAST(p AS INT) AS position, true AS in_range
FROM (VALUES ('all', 0), ('basic_only', 1), ('cov_flat_only', 2), ('temporal_cov_only', 3)) v(l, p) WHERE EXISTS (SELECT 1 FROM embeddings)""")
def layout_ablation(spark, d):
    train, _, test = parts(spark, d)
    table = models.layout_ablation(train, test, VECTOR_NAMES, ("all", "basic_only", "cov_flat_only", "temporal_cov_only"),
                                   "logistic_regression", CLASSES, 42, None, IDS)
    return table.select("layout", "position", (F.col("accuracy").between(0.15, 1) & F.col("macro_f1").between(0, 1)).alias("in_range"))


@query("noise_robustness", "EXP-4",
       "SELECT s AS noise_sigma, true AS good FROM (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS s) WHERE EXISTS (SELECT 1 FROM embeddings)")
def noise_robustness(spark, d):
    """No noise gives the clean score; noise does not make it better by much."""
    train, _, test = parts(spark, d)
    scorer = models.fit_candidate("logistic_regression", train, CLASSES, WIDTH, 42, None, IDS)
    clean = models.evaluation(scorer(test)).first()["macro_f1"]
    table = models.noise_sweep(test, scorer, (1.0, 0.0, 0.5, -1.0), "macro_f1", 42, IDS)
    good = F.when(F.col("noise_sigma") == 0, F.abs(F.col("macro_f1") - clean) < 1e-12).otherwise(F.col("macro_f1") < clean + 0.05)
    return table.select("noise_sigma", good.alias("good"))


@query("train_ratio_robustness", "EXP-5 UDF-2",
       "SELECT r AS train_ratio, true AS good FROM (SELECT unnest([0.4, 1.0]::DOUBLE[]) AS r) WHERE EXISTS (SELECT 1 FROM embeddings)")
def train_ratio_robustness(spark, d):
    train, _, test = parts(spark, d)

    def fit_and_evaluate(ratio):
        part = cut_lineage(fraction_rows(train, IDS, ratio, 42))
        return models.evaluation(models.fit_candidate("logistic_regression", part, CLASSES, WIDTH, 42, None, IDS)(test))

    table = models.ratio_sweep(fit_and_evaluate, (1.0, 0.4, 1.7))
    return table.select("train_ratio", (F.col("macro_f1") > 0.5).alias("good"))


@query("recipe_comparison", "EXP-6",
       """SELECT r AS recipe, m AS model_name, true AS in_range, r = 'front' AND m = 'logistic_regression' AS good
FROM (SELECT unnest(['front', 'back']) AS r), (SELECT unnest(['majority', 'logistic_regression']) AS m) WHERE EXISTS (SELECT 1 FROM embeddings)""")
def recipe_comparison(spark, d):
    """Only the recipe that holds the deciding elements, with a model that looks at them, does well."""
    v = cut_lineage(vectors(spark, d).select("vec_id", "features", largest().alias("y")))
    recipes = {"front": list(range(16)), "back": list(range(48, 64))}
    table = models.recipe_comparison(v, recipes, ["majority", "logistic_regression"], CLASSES, 5, 42, None, IDS)
    return table.select("recipe", "model_name", (F.col("cv_mean").between(0, 1) & F.col("cv_std").between(0, 1)).alias("in_range"), (F.col("cv_mean") > 0.7).alias("good"))


@query("foreign_model", "UDF-1",
       f"WITH {SQL_CELLS} SELECT vec_id, CAST(CASE WHEN sum(v) > 0 THEN 1 ELSE 0 END AS INT) AS y_pred FROM cells GROUP BY vec_id")
def foreign_model(spark, d):
    """Any function from a matrix to class codes scores rows in batches."""
    return models.score_with(vectors(spark, d), lambda x: (x.sum(axis=1) > 0).astype(int)).select("vec_id", "y_pred")
