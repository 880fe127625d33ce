"""Splits, folds, quota samples, resampling and corruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.hashing import POISSON1_CDF
from ..operators import augment, split
from .frames import SQL_CELLS, table, vectors
from .registry import query


@query("random_split", "SMP-2",
       """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= round_even(n * 0.6, 0) THEN 'train' WHEN rn <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def random_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return split.split_rows(o, ["o_orderkey"], None, 0.6, 0.2, seed=5)


@query("stratified_split_documents", "SMP-1",
       """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('11|' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS t FROM documents),
s AS (SELECT *, round_even(t * 0.8, 0) AS nt, round_even(t * 0.1, 0) AS nv FROM r),
q AS (SELECT *, greatest(1, round_even(n * nv / t, 0)) AS qv, greatest(1, round_even(n * nt / t, 0)) AS qt FROM s)
SELECT doc_id, lang, CASE WHEN rn <= qt THEN 'train' WHEN rn <= qt + qv THEN 'val' ELSE 'test' END AS split FROM q""")
def stratified_split_documents(spark, d):
    return split.split_rows(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], "lang", 0.8, 0.1, seed=11)


@query("missing_aware_split", "SMP-3",
       """WITH b AS (SELECT d.doc_id, l.quality IS NULL AS miss, md5('3|' || d.doc_id) AS k, count(*) OVER () AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT doc_id, row_number() OVER (ORDER BY k) AS fr FROM b WHERE miss QUALIFY fr <= 3),
r AS (SELECT b.*, row_number() OVER (ORDER BY k) AS rn FROM b WHERE doc_id NOT IN (SELECT doc_id FROM f)),
c AS (SELECT *, round_even(n * 0.7, 0) AS nt, round_even(n * 0.15, 0) AS nv FROM r)
SELECT doc_id, CASE WHEN rn <= nt - 1 THEN 'train' WHEN rn <= nt + nv - 2 THEN 'val' ELSE 'test' END AS split FROM c
UNION ALL SELECT doc_id, CASE fr WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END FROM f""")
def missing_aware_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    s = split.split_missing_aware(docs, ["doc_id"], F.col("quality").isNull(), None, 0.7, 0.15, seed=3)
    return s.select("doc_id", "split")


@query("stratified_sample", "SMP-4",
       """WITH c AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1),
q AS (SELECT event_type, n, greatest(1, round_even(500 * n::DOUBLE / t, 0)) AS q0 FROM c),
e AS (SELECT *, 500 - sum(q0) OVER () AS gap, row_number() OVER (ORDER BY q0 DESC, event_type) AS shrink, row_number() OVER (ORDER BY n - q0 DESC, event_type) AS grow FROM q),
z AS (SELECT event_type, q0 + CASE WHEN gap < 0 AND shrink <= -gap THEN -1 WHEN gap > 0 AND grow <= gap THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id)) AS rn FROM events)
SELECT event_id, event_type FROM r JOIN z USING (event_type) WHERE rn <= quota""")
def stratified_sample(spark, d):
    """500 events in the proportion of their types."""
    return split.sample_stratified(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], "event_type", 500, seed=42)


@query("stratified_folds", "SMP-5",
       "SELECT vec_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) - 1 AS INT) AS fold FROM embeddings")
def stratified_folds(spark, d):
    return split.fold_rows(vectors(spark, d).select("vec_id", "label"), ["vec_id"], "label", 5, seed=42)


@query("inner_holdout", "SMP-6",
       """WITH o AS (SELECT vec_id, label FROM (SELECT vec_id, label, ntile(5) OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) AS f FROM embeddings) WHERE f <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('43|' || vec_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM o)
SELECT vec_id, label, CASE WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS part FROM r""")
def inner_holdout(spark, d):
    """The training rows of the first fold, with a stratified part held out."""
    folds = split.fold_rows(vectors(spark, d).select("vec_id", "label"), ["vec_id"], "label", 5, seed=42)
    return split.holdout_rows(folds.where("fold <> 0").drop("fold"), ["vec_id"], "label", 0.15, seed=43)


# Orders with a class that is null for some: null is a class of its own and its rows stay.
SQL_NULL_CLASS = "o AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 <> 0 THEN o_orderpriority END AS cls FROM orders)"


def null_classes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderpriority")).alias("cls"))


@query("null_class_split", "SMP-1",
       f"""WITH {SQL_NULL_CLASS}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('13|' || o_orderkey)) AS rn, count(*) OVER (PARTITION BY cls) AS n, count(*) OVER () AS t FROM o),
s AS (SELECT *, round_even(t * 0.8, 0) AS nt, round_even(t * 0.1, 0) AS nv FROM r),
q AS (SELECT *, greatest(1, round_even(n * nv / t, 0)) AS qv, greatest(1, round_even(n * nt / t, 0)) AS qt FROM s)
SELECT o_orderkey, cls, CASE WHEN rn <= qt THEN 'train' WHEN rn <= qt + qv THEN 'val' ELSE 'test' END AS split FROM q""")
def null_class_split(spark, d):
    return split.split_rows(null_classes(spark, d), ["o_orderkey"], "cls", 0.8, 0.1, seed=13)


@query("null_class_folds", "SMP-5 SMP-6",
       f"""WITH {SQL_NULL_CLASS}, f AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY cls ORDER BY md5('42|' || o_orderkey)) - 1 AS INT) AS fold FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('43|' || o_orderkey)) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM f)
SELECT o_orderkey, cls, fold, CASE WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS part FROM r""")
def null_class_folds(spark, d):
    folds = split.fold_rows(null_classes(spark, d), ["o_orderkey"], "cls", 5, seed=42)
    return split.holdout_rows(folds, ["o_orderkey"], "cls", 0.15, seed=43)


@query("null_class_weights", "SMP-9 AGG-23",
       f"""WITH {SQL_NULL_CLASS}, n AS (SELECT cls, count(*)::DOUBLE AS n FROM o GROUP BY cls)
SELECT o_orderkey, o.cls, round((SELECT sum(n) / count(*) FROM n) / n.n, 9) AS weight FROM o JOIN n ON o.cls IS NOT DISTINCT FROM n.cls""")
def null_class_weights(spark, d):
    w = split.with_class_weights(null_classes(spark, d), "cls")
    return w.withColumn("weight", rounded("weight", 9))


@query("learning_curve_subset", "SMP-7",
       """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('9|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE rn <= greatest(2, round_even(n * 0.35, 0))""")
def learning_curve_subset(spark, d):
    return split.fraction_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.35, seed=9)


_WORD = "('0x' || substr({k}, {p}, 8))::UBIGINT / 4294967296.0::DOUBLE"


@query("bootstrap_draws", "SMP-8",
       f"""WITH u AS (SELECT o_orderkey, ('0x' || substr(md5('17|' || o_orderkey), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, CAST({' + '.join(f'(u >= {p!r}::DOUBLE)::INT' for p in POISSON1_CDF)} AS INT) AS draws FROM u""")
def bootstrap_draws(spark, d):
    return split.bootstrap_counts(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 17)


_FINE = "('0x' || substr(md5({k}), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE"


@query("exact_bootstrap_draws", "SMP-8",
       f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('19|' || o_orderkey)) - 1 AS rank, count(*) OVER () AS n FROM orders),
hits AS (SELECT least(floor({_FINE.format(k="'19|' || t")} * n), n - 1) AS rank, count(*) AS draws FROM (SELECT count(*) AS n, unnest(range(count(*))) AS t FROM orders) GROUP BY ALL)
SELECT o_orderkey, CAST(coalesce(draws, 0) AS INT) AS draws FROM r LEFT JOIN hits USING (rank)""")
def exact_bootstrap_draws(spark, d):
    """As many draws as there are orders, to the last one."""
    return split.resampled_counts(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 19)


def _resample_sql(even: bool) -> str:
    u = _FINE.format(k="'29|' || t")
    return f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('29|' || doc_id)) - 1 AS rank FROM labels),
c AS (SELECT row_number() OVER (ORDER BY quality) - 1 AS cls, quality, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS classes FROM labels GROUP BY quality),
t AS (SELECT t, {f"(t + {u}) / total::DOUBLE" if even else u} * classes AS place FROM (SELECT any_value(total) AS total, any_value(classes) AS classes, unnest(range(any_value(total)::BIGINT)) AS t FROM c)),
located AS (SELECT t, cls, quality, least(floor((place - cls) * n), n - 1) AS rank FROM t JOIN c ON c.cls = least(floor(place), classes - 1))
SELECT doc_id, quality, t AS draw FROM located JOIN r USING (quality, rank)"""


@query("balanced_resample", "SMP-9", _resample_sql(False))
def balanced_resample(spark, d):
    """Labelled documents drawn with replacement, both classes equally likely."""
    return split.balanced_resample(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 29)


@query("even_resample", "SMP-9", _resample_sql(True))
def even_resample(spark, d):
    """The same with evenly spread draws: each class has its share to within one."""
    return split.balanced_resample(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 29, even=True)


_CELL = "md5('23|' || vec_id || '|' || i)"


@query("random_mask", "SMP-11",
       f"WITH {SQL_CELLS} SELECT vec_id, CAST(i AS INT) AS pos, round(v, 6) + 0.0 AS clean, CASE WHEN {_WORD.format(k=_CELL, p=1)} < 0.25 THEN 0.0 ELSE round(v, 6) + 0.0 END AS corrupted FROM cells")
def random_mask(spark, d):
    m = augment.random_mask(vectors(spark, d), "features", ["vec_id"], 0.25, 23)
    rows = m.select("vec_id", F.posexplode(F.arrays_zip("features", "corrupted")).alias("pos", "c"))
    return rows.select("vec_id", "pos", rounded("c.features").alias("clean"), rounded("c.corrupted").alias("corrupted"))


SQL_NOISE = f"""z AS (SELECT vec_id, label, i, v, sqrt(-2 * ln(greatest({_WORD.format(k=_CELL, p=1)}, 1 / 4294967296.0::DOUBLE))) * cos(6.283185307179586 * {_WORD.format(k=_CELL, p=9)}) AS z FROM cells)"""


@query("gaussian_noise", "SMP-10",
       f"WITH {SQL_CELLS}, {SQL_NOISE} SELECT vec_id, s AS noise_sigma, CAST(i AS INT) AS pos, round(v + s * z, 6) + 0.0 AS value FROM z, (SELECT unnest([0.0, 0.1, 0.5]::DOUBLE[]) AS s)")
def gaussian_noise(spark, d):
    """Three noise levels at once; the negative one is skipped."""
    levels = augment.noise_levels(vectors(spark, d), [0.5, 0.0, 0.1, -1.0])
    noisy = augment.gaussian_noise(levels, "features", ["vec_id"], F.col("noise_sigma"), 23)
    rows = noisy.select("vec_id", "noise_sigma", F.posexplode("features").alias("pos", "value"))
    return rows.withColumn("value", rounded("value"))


@query("noisy_pairs", "SMP-11",
       f"WITH {SQL_CELLS}, {SQL_NOISE} SELECT vec_id, round(sqrt(sum(power(0.3 * z, 2))), 5) AS distance FROM z GROUP BY vec_id")
def noisy_pairs(spark, d):
    p = augment.noisy_pairs(vectors(spark, d), "features", ["vec_id"], 0.3, 23)
    gap = F.zip_with("features", "corrupted", lambda a, b: (a - b) * (a - b))
    return p.select("vec_id", rounded(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)), 5).alias("distance"))
