"""Dataset profiles and class-conditional statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.text import parse_array
from ..operators import profile
from ..operators.split import class_weights, with_class_weights
from .cleaning import SQL_ARRAYS, SQL_DIRTY, array_texts, dirty_items
from .frames import SQL_CELLS, SQL_SPLIT, table, vectors
from .ranking import split_vectors
from .registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("class_counts", "AGG-1", "SELECT coalesce(l_returnflag, 'missing') AS label, count(*) AS n FROM lineitem GROUP BY 1")
def class_counts(spark, d):
    return profile.value_counts(table(spark, d, "lineitem").select(F.coalesce("l_returnflag", F.lit("missing")).alias("label")), "label")


@query("split_class_counts", "AGG-2", f"WITH {SQL_SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY ALL")
def split_class_counts(spark, d):
    return profile.value_counts(split_vectors(spark, d), "split", "label").orderBy("split", "label")


SQL_GAPS = f"""{SQL_DIRTY}, gaps AS (SELECT count(*) AS n, sum((quantity IS NULL)::INT + (tax IS NULL OR isnan(tax))::INT + (flag IS NULL)::INT) AS miss FROM dirty)"""


@query("dataset_statistics", "AGG-3",
       f"""WITH {SQL_GAPS} SELECT 'samples' AS metric, n::DOUBLE AS value FROM gaps UNION ALL SELECT 'features', 3.0 FROM gaps
UNION ALL SELECT 'missing_values', miss::DOUBLE FROM gaps UNION ALL SELECT 'missing_ratio', round(miss::DOUBLE / (3 * n), 6) FROM gaps
UNION ALL SELECT 'class_count[' || coalesce(CAST(target AS VARCHAR), 'missing') || ']', count(*)::DOUBLE FROM dirty GROUP BY target""")
def dataset_statistics(spark, d):
    s = profile.dataset_statistics(dirty_items(spark, d), ["quantity", "tax", "flag"], "target")
    return s.withColumn("value", rounded("value"))


@query("missing_cells", "AGG-4", f"WITH {SQL_GAPS} SELECT CAST(miss AS BIGINT) AS missing_values, round(miss::DOUBLE / (3 * n), 6) AS missing_ratio FROM gaps")
def missing_cells(spark, d):
    m = profile.missing_cells(dirty_items(spark, d), ["quantity", "tax", "flag"])
    return m.select("missing_values", rounded("missing_ratio").alias("missing_ratio"))


@query("label_value_counts", "AGG-8", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def label_value_counts(spark, d):
    return profile.value_counts(table(spark, d, "events"), "event_type").orderBy(F.desc("n"), "event_type")


@query("category_crosstab", "AGG-9",
       """SELECT coalesce(d.source, 'missing') AS category, count(*) FILTER (quality = 0) AS class_0, count(*) FILTER (quality = 1) AS class_1,
least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) = 0 AS exclusive FROM documents d JOIN labels USING (doc_id) GROUP BY 1""")
def category_crosstab(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return profile.category_crosstab(docs, "source", "quality", [0, 1])


_UNPIVOT = "li AS (SELECT l_returnflag, feature, x FROM (SELECT l_returnflag, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) UNPIVOT (x FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"


@query("class_describe", "AGG-10",
       f"""WITH {_UNPIVOT} SELECT l_returnflag, feature, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, max(x) AS max,
round(median(x), 6) AS median, min(x) = max(x) AS constant, min(x) = 0 AND max(x) = 0 AS all_zero FROM li GROUP BY ALL""")
def class_describe(spark, d):
    c = profile.class_describe(table(spark, d, "lineitem"), "l_returnflag", NUMBERS)
    return c.withColumns({"mean": rounded("mean", 4), "std": rounded("std", 4), "median": rounded("median")})


@query("correlation_ranking", "AGG-11",
       """SELECT feature, round(r, 6) + 0.0 AS r, n FROM (
SELECT 'l_quantity' AS feature, corr(l_quantity, y) AS r, count(*) AS n FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM lineitem)
UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, y), count(*) FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM lineitem)
UNION ALL SELECT 'l_discount', corr(l_discount, y), count(*) FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM lineitem)
UNION ALL SELECT 'l_tax', corr(l_tax, y), count(*) FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM lineitem))""")
def correlation_ranking(spark, d):
    li = table(spark, d, "lineitem").withColumns({"y": (F.col("l_returnflag") == "R").cast("int"), "one": F.lit(1.0)})
    c = profile.correlation_ranking(li, [*NUMBERS, "one"], "y")
    return c.select("feature", rounded("r").alias("r"), "n")


SQL_ELEMENT_R = f"WITH {SQL_CELLS}, r AS (SELECT i, corr(v, (label < 5)::INT) AS r FROM cells GROUP BY i)"


@query("element_correlations", "AGG-12 SRT-6",
       f"{SQL_ELEMENT_R} SELECT CAST(i AS INT) AS pos, round(r, 6) + 0.0 AS r FROM r ORDER BY abs(r) DESC, i LIMIT 20")
def element_correlations(spark, d):
    v = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    return profile.element_correlations(v, "features", "y").select("pos", rounded("r").alias("r"))


@query("top_correlations", "SRT-6",
       f"""{SQL_ELEMENT_R}, n AS (SELECT corr(s, (label < 5)::INT) AS r FROM (SELECT vec_id, label, sqrt(sum(v * v)) AS s FROM cells GROUP BY ALL))
SELECT * FROM (SELECT 'e_' || i AS feature, round(r, 6) + 0.0 AS r FROM r UNION ALL SELECT 'l2norm', round(r, 6) + 0.0 FROM n) ORDER BY abs(r) DESC, feature LIMIT 30""")
def top_correlations(spark, d):
    """Correlations of all feature families together, the 30 strongest."""
    from ..functions.arrays import l2_norm

    v = vectors(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    per = profile.element_correlations(v, "features", "y", top=None).select(F.concat(F.lit("e_"), "pos").alias("feature"), "r")
    norm = profile.correlation_ranking(v.select("y", l2_norm(F.col("features")).alias("l2norm")), ["l2norm"], "y").select("feature", "r")
    both = per.unionByName(norm).select("feature", rounded("r").alias("r"))
    return both.orderBy(F.desc(F.abs("r")), "feature").limit(30)


@query("cohens_d", "AGG-13",
       """SELECT feature, round(abs(m1 - m0) / sqrt((v1 + v0) / 2), 6) AS d FROM (
SELECT 'l_quantity' AS feature, avg(l_quantity) FILTER (l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (l_returnflag = 'A') AS m0,
 var_pop(l_quantity) FILTER (l_returnflag = 'R') AS v1, var_pop(l_quantity) FILTER (l_returnflag = 'A') AS v0 FROM lineitem
UNION ALL SELECT 'l_tax', avg(l_tax) FILTER (l_returnflag = 'R'), avg(l_tax) FILTER (l_returnflag = 'A'),
 var_pop(l_tax) FILTER (l_returnflag = 'R'), var_pop(l_tax) FILTER (l_returnflag = 'A') FROM lineitem)""")
def cohens_d(spark, d):
    c = profile.cohens_d(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag", "R", "A")
    return c.select("feature", rounded("d").alias("d"))


@query("array_length_profile", "AGG-14",
       f"""WITH {SQL_ARRAYS}, s AS (SELECT len(a) AS s, count(*) AS n FROM arr WHERE a IS NOT NULL GROUP BY 1)
SELECT CAST(min(s) AS INT) AS min_len, CAST(max(s) AS INT) AS max_len, round(sum(s * n)::DOUBLE / sum(n), 6) AS mean_len, count(*) AS distinct_len,
CAST(first(s ORDER BY n DESC, s) AS INT) AS mode_len, power(round(sqrt(first(s ORDER BY n DESC, s))), 2) = first(s ORDER BY n DESC, s) AS is_square FROM s""")
def array_length_profile(spark, d):
    p = profile.length_profile(array_texts(spark, d), parse_array(F.col("payload")))
    return p.withColumn("mean_len", rounded("mean_len"))


@query("majority_rate", "AGG-22", "SELECT round(max(n)::DOUBLE / sum(n), 6) AS rate FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def majority_rate(spark, d):
    return profile.majority_rate(table(spark, d, "events"), "event_type").select(rounded("rate").alias("rate"))


@query("balanced_weights", "AGG-23",
       """SELECT quality, count(*) AS n, round((SELECT count(*)::DOUBLE / count(DISTINCT quality) FROM labels) / count(*), 6) AS weight FROM labels GROUP BY quality""")
def balanced_weights(spark, d):
    w = class_weights(table(spark, d, "labels"), "quality")
    return w.withColumn("weight", rounded("weight"))


@query("resampling_weights", "SMP-9",
       "SELECT doc_id, quality, round(1.0::DOUBLE / count(*) OVER (PARTITION BY quality), 9) AS weight FROM labels")
def resampling_weights(spark, d):
    w = with_class_weights(table(spark, d, "labels").select("doc_id", "quality"), "quality", "inverse")
    return w.withColumn("weight", rounded("weight", 9))
