"""Cleaning, encoding and label queries over line items with deterministic gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.text import domain_group, fixed, in_layout, index_of, parse_array, prefix_of, prompt_text, six_digits, slug, timestamp_tag
from ..operators import clean, labels, prepare, spec
from .frames import SQL_CELLS, SQL_RUNS, SQL_SPLIT, run_table, table, vectors
from .registry import query


def dirty_items(spark, d):
    """Line items with nulls, NaN, an all-null column and index leftovers."""
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(k % 7 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
        F.when(k % 13 != 0, F.col("l_returnflag")).alias("flag"),
        F.lit(None).cast("double").alias("empty"),
        F.col("l_linenumber").alias("Unnamed: 7"),
        F.lit(None).cast("double").alias("Unnamed: 8"),
        F.when(k % 5 != 0, F.col("l_linenumber") % 3).cast("double").alias("target"),
    )


SQL_DIRTY = """dirty AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity,
         CASE WHEN l_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS tax,
         CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS flag,
         CASE WHEN l_orderkey % 5 <> 0 THEN (l_linenumber % 3)::DOUBLE END AS target
  FROM lineitem
)"""


@query("sanitize_columns", "PRJ-1",
       f"""WITH {SQL_DIRTY} SELECT flag, count(*) AS n, round(sum(quantity), 6) AS q FROM dirty GROUP BY flag""")
def sanitize_columns(spark, d):
    """All-null and index-leftover columns are gone; the rest is summed."""
    kept = clean.sanitize(dirty_items(spark, d), "target")
    assert "empty" not in kept.columns and "Unnamed: 7" not in kept.columns
    return kept.groupBy("flag").agg(F.count("*").alias("n"), rounded(F.sum("quantity")).alias("q"))


_STRICT = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "quantity": "quantity", "tax": "tax", "flag": "flag", "empty": "NULL",
           "Unnamed: 7": "l_linenumber", "target": "target"}


@query("sanitize_columns_strict", "PRJ-2",
       f"WITH {SQL_DIRTY} {' UNION ALL '.join(f"SELECT '{c}' AS column_name, count({e}) AS n FROM dirty" for c, e in _STRICT.items())}")
def sanitize_columns_strict(spark, d):
    """Values per column that the strict rule keeps."""
    kept = clean.sanitize(dirty_items(spark, d), "target", strict=True)
    counts = kept.agg(*[F.count(f"`{c}`").alias(c) for c in kept.columns])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n")) for c in kept.columns]
    return counts.select(F.inline(F.array(*cells)))


@query("drop_leakage", "PRJ-3 SET-5",
       f"WITH {SQL_DIRTY} SELECT l_orderkey, l_linenumber, round(target, 6) AS target, flag FROM dirty")
def drop_leakage(spark, d):
    df = clean.sanitize(dirty_items(spark, d), "target")
    kept, gone = clean.drop_leakage(df, [["quantity", "tax"], ["tax", "target"]], ["target"])
    assert gone == ["quantity", "tax"]
    return kept


@query("drop_missing_target", "PRJ-4 PRJ-5",
       f"WITH {SQL_DIRTY} SELECT l_orderkey, l_linenumber, target FROM dirty WHERE target IS NOT NULL")
def drop_missing_target(spark, d):
    return clean.drop_missing_target(dirty_items(spark, d), "target").select("l_orderkey", "l_linenumber", "target")


@query("drop_missing_text_target", "PRJ-4", f"WITH {SQL_DIRTY} SELECT l_orderkey, l_linenumber, flag FROM dirty WHERE flag IS NOT NULL")
def drop_missing_text_target(spark, d):
    """A text target whose nulls are missing, not a class."""
    return clean.drop_missing_target(dirty_items(spark, d), "flag", text_nulls="drop").select("l_orderkey", "l_linenumber", "flag")


@query("missing_target_count", "PRJ-4", f"WITH {SQL_DIRTY} SELECT count(*) FILTER (target IS NULL) AS dropped FROM dirty")
def missing_target_count(spark, d):
    return clean.missing_target_count(dirty_items(spark, d), "target")


@query("mean_impute", "PRJ-6",
       f"""WITH {SQL_DIRTY}, m AS (SELECT avg(quantity) AS mq, avg(tax) FILTER (NOT isnan(tax)) AS mt FROM dirty)
SELECT l_orderkey, l_linenumber, round(coalesce(quantity, mq), 6) AS quantity,
       round(CASE WHEN isnan(tax) THEN mt ELSE tax END, 6) AS tax, 0.0::DOUBLE AS empty FROM dirty, m""")
def mean_impute(spark, d):
    df = dirty_items(spark, d)
    s = spec.infer_spec(df, ["quantity", "tax", "empty"])
    return s.expand(df, ["l_orderkey", "l_linenumber"]).withColumns({c: rounded(c) for c in ("quantity", "tax", "empty")})


@query("one_hot", "PRJ-7",
       f"""WITH {SQL_DIRTY} SELECT l_orderkey, l_linenumber, (coalesce(flag, 'missing') = 'A')::INT::DOUBLE AS "flag__A",
(coalesce(flag, 'missing') = 'N')::INT::DOUBLE AS "flag__N", (coalesce(flag, 'missing') = 'R')::INT::DOUBLE AS "flag__R",
(flag IS NULL)::INT::DOUBLE AS flag__missing FROM dirty""")
def one_hot(spark, d):
    df = dirty_items(spark, d)
    return spec.infer_spec(df, ["flag"]).expand(df, ["l_orderkey", "l_linenumber"])


def _array_text():
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    nums = F.slice(F.array(k % 97, p % 89, n, (k + p) % 83), 1, n % 4 + 1)
    body = F.concat(F.lit("["), F.array_join(F.transform(nums, lambda v: v.cast("string")), ", "), F.lit("]"))
    return (
        F.when(k % 20 == 0, "n/a").when(k % 20 == 1, F.lit(None)).when(k % 3 == 0, F.concat(F.lit("array("), body, F.lit(")")))
        .when(k % 3 == 1, F.concat(F.lit("[array("), body, F.lit("), array("), body, F.lit(")]"))).otherwise(body)
    )


def array_texts(spark, d):
    """Line items as array text of changing length and style, with some rows that are no array."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _array_text().alias("payload"))


SQL_ARRAYS = """arr0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         list_slice([l_orderkey % 97, l_partkey % 89, l_linenumber, (l_orderkey + l_partkey) % 83], 1, l_linenumber % 4 + 1) AS nums FROM lineitem
), arr AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 20 IN (0, 1) THEN NULL
    WHEN l_orderkey % 3 = 1 THEN list_concat(nums, nums) ELSE nums END AS a, l_orderkey % 20 = 1 AS is_null FROM arr0
)"""


@query("detect_array_column", "PRJ-8",
       f"""WITH {SQL_ARRAYS} SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE 1.0 END) FILTER (NOT is_null), 6) AS share,
CAST(max(len(a)) AS INT) AS width FROM arr""")
def detect_array_column(spark, d):
    return spec.array_shares(array_texts(spark, d), ["payload"]).select(rounded("share").alias("share"), "width")


@query("parse_array_text", "PRJ-9",
       f"""WITH {SQL_ARRAYS} SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(len(a), -1) AS INT) AS n, CAST(coalesce(list_sum(a), 0) AS DOUBLE) AS total FROM arr""")
def parse_array_text(spark, d):
    df = array_texts(spark, d).withColumn("a", parse_array(F.col("payload")))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.size("a"), F.lit(-1)).alias("n"),
                     F.coalesce(total, F.lit(0.0)).alias("total"))


@query("expand_array_column", "PRJ-10",
       f"""WITH {SQL_ARRAYS} SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"CAST(coalesce(a[{i + 1}], 0) AS DOUBLE) AS payload_{i}" for i in range(8))} FROM arr""")
def expand_array_column(spark, d):
    df = array_texts(spark, d)
    return spec.infer_spec(df, ["payload"]).expand(df, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("auto_expand", "PRJ-11",
       f"""WITH {SQL_ARRAYS}, src AS (
  SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l.l_orderkey % 7 <> 0 THEN l.l_quantity END AS quantity,
         l.l_orderkey % 13 = 0 AS no_flag,
         CASE WHEN l.l_orderkey % 20 IN (0, 1) THEN NULL ELSE l.l_orderkey % 97 END AS first,
         CASE WHEN l.l_orderkey % 20 IN (0, 1) OR l.l_orderkey % 3 <> 1 OR l.l_linenumber % 4 <> 3 THEN NULL ELSE (l.l_orderkey + l.l_partkey) % 83 END AS eighth
  FROM lineitem l), m AS (SELECT avg(quantity) AS mq FROM src)
SELECT l_orderkey, l_linenumber, round(coalesce(quantity, mq) + coalesce(first, 0) + coalesce(eighth, 0) + no_flag::INT, 6) AS checksum FROM src, m""")
def auto_expand(spark, d):
    """Numbers, array text and categories in one projection; the checksum touches one of each."""
    k = F.col("l_orderkey")
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k % 7 != 0, F.col("l_quantity")).alias("quantity"),
        _array_text().alias("payload"), F.when(k % 13 != 0, F.col("l_returnflag")).alias("flag"),
    )
    wide = spec.infer_spec(raw, ["quantity", "payload", "flag"]).expand(raw, ["l_orderkey", "l_linenumber"])
    total = F.col("quantity") + F.col("payload_0") + F.col("payload_7") + F.col("flag__missing")
    return wide.select("l_orderkey", "l_linenumber", rounded(total).alias("checksum"))


SQL_NAMES = """names AS (
  SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'SU' || (l_suppkey % 3) || '_cov_flat_' || (l_suppkey % 8)
    WHEN 2 THEN 'SU' || (l_suppkey % 3) || '_temporal_cov_' || (l_suppkey % 32) WHEN 3 THEN 'Spectral_Entropy_' || l_suppkey
    WHEN 4 THEN 'fft_' || l_suppkey WHEN 5 THEN 'mySpectrum' || l_suppkey ELSE 'power_dB' || l_linenumber END AS name
  FROM lineitem
)"""


def name_rows(spark, d):
    """Feature names spelled from supplier and line numbers."""
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    name = (
        F.when(n == 1, F.concat(F.lit("SU"), s % 3, F.lit("_cov_flat_"), s % 8))
        .when(n == 2, F.concat(F.lit("SU"), s % 3, F.lit("_temporal_cov_"), s % 32))
        .when(n == 3, F.concat(F.lit("Spectral_Entropy_"), s)).when(n == 4, F.concat(F.lit("fft_"), s))
        .when(n == 5, F.concat(F.lit("mySpectrum"), s)).otherwise(F.concat(F.lit("power_dB"), n))
    )
    return table(spark, d, "lineitem").select(name.alias("name")).distinct()


@query("domain_groups", "PRJ-12",
       f"""WITH {SQL_NAMES} SELECT name, CASE WHEN lower(name) LIKE '%\\_cov\\_flat\\_%' ESCAPE '\\' THEN 'covariance_based'
WHEN lower(name) LIKE '%\\_temporal\\_cov\\_%' ESCAPE '\\' THEN 'temporal_covariance' WHEN lower(name) LIKE '%entropy%' THEN 'entropy_related'
WHEN lower(name) LIKE 'fft\\_%' ESCAPE '\\' OR lower(name) LIKE '%spectrum%' THEN 'spectral_energy' ELSE 'basic_statistical' END AS domain_group FROM names""")
def domain_groups(spark, d):
    return name_rows(spark, d).select("name", domain_group(F.col("name")).alias("domain_group"))


@query("layout_filter", "PRJ-14",
       f"""WITH {SQL_NAMES} SELECT name, contains(name, '_cov_flat_') AS cov, contains(name, '_temporal_cov_') AS temporal,
NOT (contains(name, '_cov_flat_') OR contains(name, '_temporal_cov_')) AS basic FROM names""")
def layout_filter(spark, d):
    n = F.col("name")
    return name_rows(spark, d).select("name", in_layout(n, "cov_flat_only").alias("cov"),
                                      in_layout(n, "temporal_cov_only").alias("temporal"), in_layout(n, "basic_only").alias("basic"))


@query("prefix_split", "STR-5",
       f"""WITH {SQL_NAMES} SELECT name, nullif(regexp_extract(name, '^(.+)_([0-9]+)$', 1), '') AS prefix,
try_cast(nullif(regexp_extract(name, '^(.+)_([0-9]+)$', 2), '') AS INT) AS member FROM names""")
def prefix_split(spark, d):
    return name_rows(spark, d).select("name", prefix_of(F.col("name")).alias("prefix"), index_of(F.col("name")).alias("member"))


VECTOR_NAMES = [f"SU1_cov_flat_{i}" for i in range(8)] + [f"SU1_temporal_cov_{i}" for i in range(32)] + [f"fft_{i}" for i in range(20)] + ["power_dB", "spectral_entropy", "freq_bin", "bandwidth"]


@query("group_view", "PRJ-13",
       f"""WITH {SQL_CELLS} SELECT vec_id, CAST(CASE WHEN i < 60 THEN i - 40 ELSE 20 END AS INT) AS pos, round(v, 6) + 0.0 AS value
FROM cells WHERE i BETWEEN 40 AND 59 OR i = 61""")
def group_view(spark, d):
    """Elements of two domain groups, groups in order of first appearance."""
    idx = spec.group_indices(spark, VECTOR_NAMES, ["entropy_related", "spectral_energy"])
    v = vectors(spark, d).select("vec_id", F.posexplode(spec.pick("features", idx)).alias("pos", "value"))
    return v.withColumn("value", rounded("value"))


@query("layout_view", "PRJ-14",
       f"WITH {SQL_CELLS} SELECT vec_id, CAST(i - 8 AS INT) AS pos, round(v, 6) + 0.0 AS value FROM cells WHERE i BETWEEN 8 AND 39")
def layout_view(spark, d):
    idx = spec.layout_indices(spark, VECTOR_NAMES, "temporal_cov_only")
    v = vectors(spark, d).select("vec_id", F.posexplode(spec.pick("features", idx)).alias("pos", "value"))
    return v.withColumn("value", rounded("value"))


@query("fault_code", "PRJ-16",
       """SELECT p_partkey, 'fault_' || CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size % 2 END || (p_size // 2) % 2 || (p_size // 4) % 2 || (p_size // 8) % 2 AS fault_code FROM part""")
def fault_code(spark, d):
    s = F.col("p_size")
    bits = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 9 != 0, s % 2).cast("double").alias("G"), F.floor(s / 2).cast("int").alias("_c"),
        F.floor(s / 4).cast("int").alias("_b"), F.floor(s / 8).cast("int").alias("_a"),
    ).select("p_partkey", "G", (F.col("_c") % 2).alias("C"), (F.col("_b") % 2).alias("B"), (F.col("_a") % 2).alias("A"))
    return clean.fault_code(bits).select("p_partkey", "fault_code")


@query("encode_target", "LBL-1 JON-4",
       """WITH t AS (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS r FROM customer)
SELECT c_custkey, c_mktsegment, CAST(r AS INT) AS y FROM t""")
def encode_target(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return labels.encode_labels(c, "c_mktsegment")


@query("encode_numeric_target", "LBL-1",
       f"""WITH {SQL_DIRTY} SELECT l_orderkey, l_linenumber, target, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INT) AS y FROM dirty WHERE target IS NOT NULL""")
def encode_numeric_target(spark, d):
    return labels.encode_labels(dirty_items(spark, d).select("l_orderkey", "l_linenumber", "target"), "target")


def task_frame(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    lab = table(spark, d, "labels")
    return labels.encode_tasks(docs.join(lab, "doc_id", "left"), {"quality": "quality", "language": "lang"})


SQL_TASKFRAME = """tf AS (
  SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS INT) AS y_quality, l.quality IS NULL AS missing_quality,
         CAST(dense_rank() OVER (ORDER BY coalesce(d.lang, 'missing')) - 1 AS INT) AS y_language, false AS missing_language
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


@query("encode_tasks", "LBL-2", f"WITH {SQL_TASKFRAME} SELECT * FROM tf")
def encode_tasks(spark, d):
    return task_frame(spark, d).select("doc_id", "y_quality", "missing_quality", "y_language", "missing_language")


@query("tasks_long", "LBL-3",
       f"""WITH {SQL_TASKFRAME} SELECT doc_id, 'quality' AS task, y_quality AS y, missing_quality AS missing FROM tf
UNION ALL SELECT doc_id, 'language', y_language, missing_language FROM tf""")
def tasks_long(spark, d):
    return labels.tasks_long(task_frame(spark, d), ["doc_id"], ["quality", "language"])


@query("any_task_missing", "SET-4", f"WITH {SQL_TASKFRAME} SELECT doc_id, missing_quality OR missing_language AS any_missing FROM tf")
def any_task_missing(spark, d):
    return task_frame(spark, d).select("doc_id", labels.any_task_missing(["quality", "language"]).alias("any_missing"))


@query("normalize_codes", "LBL-4",
       f"""WITH {SQL_DIRTY} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN x IS NULL OR isnan(x) OR x < 0 THEN -1 ELSE trunc(x) END AS INT) AS code
FROM (SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN tax ELSE target - CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END END AS x FROM dirty)""")
def normalize_codes(spark, d):
    k = F.col("l_orderkey")
    x = F.when(k % 11 == 0, F.col("tax")).otherwise(F.col("target") - F.when(k % 2 == 0, 2).otherwise(0))
    df = dirty_items(spark, d).withColumn("x", x)
    return df.select("l_orderkey", "l_linenumber", labels.normalize_code(F.col("x"), floating=True).alias("code"))


@query("task_class_counts", "LBL-5",
       f"""WITH {SQL_TASKFRAME}, l AS (SELECT doc_id, 'quality' AS task, y_quality AS y FROM tf UNION ALL SELECT doc_id, 'language', y_language FROM tf)
SELECT task, CAST(max(y) + 1 AS INT) AS classes FROM l WHERE doc_id % 3 <> 2 AND y >= 0 GROUP BY task""")
def task_class_counts(spark, d):
    names = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    long = labels.tasks_long(task_frame(spark, d), ["doc_id"], ["quality", "language"]).withColumn("split", names)
    return labels.class_counts_per_task(long)


@query("decode_labels", "PRJ-17 JON-4",
       """WITH t AS (SELECT DISTINCT c_mktsegment AS v FROM customer), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM t)
SELECT o_orderkey, CAST(o_custkey % 8 AS INT) AS code, coalesce(v, CAST(o_custkey % 8 AS VARCHAR)) AS label
FROM orders LEFT JOIN k ON k.code = o_custkey % 8""")
def decode_labels(spark, d):
    names = labels.label_table(table(spark, d, "customer"), "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 8).cast("int").alias("code"))
    return labels.decode_labels(o, "code", names, "label")


@query("rename_tasks", "PRJ-18", f"WITH {SQL_TASKFRAME} SELECT doc_id, y_quality AS y_good, missing_quality AS missing_good, y_language, missing_language FROM tf")
def rename_tasks(spark, d):
    return labels.rename_tasks(task_frame(spark, d), {"quality": "good"}).select(
        "doc_id", "y_good", "missing_good", "y_language", "missing_language")


@query("slugs", "STR-1",
       """SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'run') AS slug,
coalesce(nullif(trim(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), ''), 'item') AS text_slug FROM documents""")
def slugs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", slug(F.col("source")).alias("slug"), slug(F.col("text"), "item", True).alias("text_slug"))


@query("metric_text", "STR-3", f"WITH {SQL_RUNS} SELECT run_dir, printf('%.4f', accuracy) AS accuracy_text FROM runs")
def metric_text(spark, d):
    return run_table(spark, d).select("run_dir", fixed(F.col("accuracy"), 4).alias("accuracy_text"))


@query("six_digit_text", "STR-2", """SELECT event_id, format('{:.6g}', value * 1234.5678) AS text, format('{:.6g}', value / 98765432.1) AS small FROM events""")
def six_digit_text(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", six_digits(F.col("value") * 1234.5678).alias("text"), six_digits(F.col("value") / 98765432.1).alias("small"))


@query("timestamp_tags", "STR-7", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS tag FROM events")
def timestamp_tags(spark, d):
    return table(spark, d, "events").select("event_id", timestamp_tag(F.col("ts")).alias("tag"))


@query("prompt_texts", "STR-4 STR-6",
       f"""WITH {SQL_CELLS} SELECT vec_id, 'EMC signal classification sample.' || chr(10) || 'Task: Name the class.' || chr(10)
|| 'Label meanings: 0=quiet; 1=busy.' || chr(10) || 'Observed features (spectrum-sensing style statistics where applicable): '
|| string_agg(CASE i WHEN 0 THEN 'phase_a_current' WHEN 1 THEN 'phase_b_current' WHEN 2 THEN 'SU1_cov_flat_mean' WHEN 3 THEN 'SU1_cov_flat_max_eigenvalue' WHEN 4 THEN 'SU1_cov_flat_versus_SU2_cov_flat_cosine' ELSE 'x' || (i - 5) END || '=' || format('{{:.6g}}', v), '; ' ORDER BY i) AS prompt
FROM cells GROUP BY vec_id""")
def prompt_texts(spark, d):
    names = ["Ia", "Ib", "SU1_cov_flat__mean", "SU1_cov_flat_phys_eig_max", "SU1_cov_flat_vs_SU2_cov_flat_cosine"] + [f"x{i}" for i in range(59)]
    text = prompt_text(F.col("features"), names, "Name the class.", {"1": "busy", "0": "quiet"})
    return vectors(spark, d).select("vec_id", text.alias("prompt"))


# Orders with gaps: their ids are unique, as a split needs them.
SQL_GAPS = """gaps AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
         CASE WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE (o_custkey % 50)::DOUBLE END AS rest,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS flag, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 3)::DOUBLE END AS target
  FROM orders)"""


def orders_with_gaps(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k, F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 11 == 0, F.lit(float("nan"))).otherwise((F.col("o_custkey") % 50).cast("double")).alias("rest"),
        F.when(k % 13 != 0, F.col("o_orderstatus")).alias("flag"), F.when(k % 5 != 0, F.col("o_custkey") % 3).cast("double").alias("target"),
        F.col("o_custkey").alias("later"), F.lit(None).cast("double").alias("Unnamed: 8"))


_SPLIT_ITEMS = SQL_SPLIT[SQL_SPLIT.index("), sized AS"):].replace("SELECT vec_id, label, CASE", "SELECT *, CASE")


def _prepared_sql(source: str, columns: dict[str, str], y: str, shown: str, seed: int) -> str:
    """Split and standardise the numbers in ``columns``, named as the features, by class ``y``."""
    z = ", ".join(f"(x.{c} - avg(x.{c}) FILTER (split = 'train') OVER ()) / CASE WHEN stddev_pop(x.{c}) FILTER (split = 'train') OVER () < 1e-12 "
                  f"THEN 1.0 ELSE stddev_pop(x.{c}) FILTER (split = 'train') OVER () END AS z_{c}" for c in columns)
    return f"""WITH {SQL_GAPS}, {source}, x AS (SELECT o_orderkey, {shown}, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {y} ORDER BY md5('{seed}|' || o_orderkey)) AS rn,
  count(*) OVER (PARTITION BY {y}) AS n, count(*) OVER () AS total FROM x
{_SPLIT_ITEMS}, scaled AS (SELECT *, {z} FROM split x)
SELECT o_orderkey, {y}, split, {', '.join(f'round(z_{c}, 5) + 0.0 AS {c}' for c in columns)} FROM scaled"""


_FLAGS = {f"flag__{v}": f"(coalesce(flag, 'missing') = '{v}')::INT::DOUBLE" for v in ("F", "O", "P", "missing")}


@query("prepared_table", "PRJ-5 PRJ-7 SMP-1", _prepared_sql(
    """rows AS (SELECT *, dense_rank() OVER (ORDER BY target) - 1 AS y, avg(price) OVER () AS mq, avg(rest) FILTER (NOT isnan(rest)) OVER () AS mt
  FROM gaps WHERE target IS NOT NULL)""",
    {"price": "coalesce(price, mq)", "rest": "CASE WHEN isnan(rest) THEN mt ELSE rest END", **_FLAGS}, "y", "CAST(y AS INT) AS y", 42))
def prepared_table(spark, d):
    """A whole preparation run for one target: all features of all rows."""
    p = prepare.prepare(orders_with_gaps(spark, d), ["o_orderkey"], "target", ["later", "not_there"])
    assert p.dropped == ["later"]
    return p.rows.select("o_orderkey", "y", "split", *[rounded(F.get("features", F.lit(i)), 5).alias(n) for i, n in enumerate(p.names)])
