"""From raw documents to packed training rows: five stages, each a Spark job over all that the one before kept.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

An empty ``documents`` gives no rows, an empty ``benchmark`` removes nothing.  A null text is too short for the rules and goes; a
null id is kept like any other, but of a group of copies a row with an id stays; null sources share bins.  Further columns pass
through all stages but the last, also those that share a name with a column inside an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm import contamination, near_dups, packing, repetition, secret_scan
from signalframe.session import cut_lineage


#: Rows of an Arrow batch in every stage; bounds what the Python workers of an executor hold side by side.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are long enough and do not repeat themselves."""
    _bounded(spark)
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of at least 0.8."""
    _bounded(spark)
    return near_dups.keep_one(docs, shingle=5, up=4, down=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of the benchmark."""
    _bounded(spark)
    name = "contamination report"
    judged = contamination.with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return judged.where(~contamination.is_contaminated(F.col(f"`{name}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the text."""
    _bounded(spark)
    masked = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in bins of 2048 words."""
    return packing.pack(docs, packing.word_count(F.col("text")), cluster=F.col("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("packing", best_fit_packing),
]

#: Near copies, redaction and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
