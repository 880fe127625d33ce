"""Split, standardise, rank: the path from a feature table to its best features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators.rank import fisher_of, fit_scaled_scores, keep_features, ranked, top_features
from ..operators.scale import apply_scaler, feature_moments, fit_scaler, zscore
from ..operators.split import split_rows
from .frames import NAMES, SQL_CELLS, SQL_FISHER, SQL_SCALED, SQL_SPLIT, WIDTH, vectors
from .registry import query


def split_vectors(spark, d):
    return split_rows(vectors(spark, d), ["vec_id"], "label", 0.7, 0.15, seed=7)


def scaled_vectors(spark, d):
    return zscore(split_vectors(spark, d), "features", WIDTH, F.col("split") == "train")


def vector_scores(spark, d):
    """Scores of the standardised training rows; the vectors are read once."""
    train = split_vectors(spark, d).where(F.col("split") == "train")
    return fisher_of(feature_moments(train, "features", WIDTH, ["label"]), NAMES, standardized=True)


@query("fisher_top_features", "FS-1 FS-3 FS-4 SRC-2 PRJ-15",
       f"""WITH {SQL_FISHER}
SELECT 'e_' || i AS feature, round(score, 6) + 0.0 AS score,
       CAST(row_number() OVER (ORDER BY score DESC, i) AS INT) AS rank
FROM fisher ORDER BY score DESC, i LIMIT 12""")
def fisher_top_features(spark, d):
    """The 12 features that separate the classes best on standardised training rows."""
    return top_features(vector_scores(spark, d), 12).select("feature", rounded("score").alias("score"), "rank")


@query("feature_importance_table", "FS-2",
       f"""WITH {SQL_FISHER}
SELECT CAST(i AS INT) AS idx, 'e_' || i AS feature, round(score, 6) + 0.0 AS score,
       CAST(row_number() OVER (ORDER BY score DESC, i) AS INT) AS rank FROM fisher""")
def feature_importance_table(spark, d):
    return ranked(vector_scores(spark, d)).select("idx", "feature", rounded("score").alias("score"), "rank")


@query("select_top_features", "PRJ-15",
       f"""WITH {SQL_FISHER}, best AS (SELECT i, row_number() OVER (ORDER BY score DESC, i) AS rk FROM fisher)
SELECT s.vec_id, s.label, s.split, CAST(b.rk AS INT) AS rank, round(s.z, 6) + 0.0 AS value
FROM scaled s JOIN best b USING (i) WHERE b.rk <= 5""")
def select_top_features(spark, d):
    """Rows reduced to their five best features, shown one value per row."""
    rows = split_vectors(spark, d)
    fitted = fit_scaled_scores(rows, "features", "label", NAMES, F.col("split") == "train")
    reduced = keep_features(apply_scaler(rows, "features", fitted.scaler), "features", top_features(fitted.scores, 5))
    return reduced.select("vec_id", "label", "split", F.posexplode("features").alias("p", "x")).select(
        "vec_id", "label", "split", (F.col("p") + 1).alias("rank"), rounded("x").alias("value")
    )


@query("stratified_split", "SMP-1 WIN-6", f"WITH {SQL_SPLIT} SELECT vec_id, label, split FROM split")
def stratified_split(spark, d):
    return split_vectors(spark, d).select("vec_id", "label", "split")


@query("scaler_fit", "AGG-6",
       f"""WITH {SQL_CELLS}, {SQL_SPLIT}
SELECT CAST(i AS INT) AS idx, round(avg(v), 6) + 0.0 AS mean,
       round(CASE WHEN stddev_pop(v) < 1e-12 THEN 1.0 ELSE stddev_pop(v) END, 6) + 0.0 AS std
FROM cells JOIN split USING (vec_id) WHERE split = 'train' GROUP BY i""")
def scaler_fit(spark, d):
    s = fit_scaler(split_vectors(spark, d), "features", WIDTH, F.col("split") == "train")
    return s.select("idx", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("scaler_apply", "AGG-7",
       f"WITH {SQL_SCALED} SELECT vec_id, split, CAST(i AS INT) AS idx, round(z, 6) + 0.0 AS z FROM scaled")
def scaler_apply(spark, d):
    z = scaled_vectors(spark, d)
    return z.select("vec_id", "split", F.posexplode("features").alias("idx", "z")).withColumn("z", rounded("z"))


@query("feature_head_moments", "AGG-5",
       f"""WITH {SQL_CELLS} SELECT CAST(i AS INT) AS idx, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std
FROM cells WHERE i < 5 GROUP BY i""")
def feature_head_moments(spark, d):
    head = vectors(spark, d).select(F.slice("features", 1, 5).alias("features"))
    return feature_moments(head, "features", 5).select(
        "idx", rounded("mean").alias("mean"), rounded(F.sqrt("var")).alias("std")
    )
