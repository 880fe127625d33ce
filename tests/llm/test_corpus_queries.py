"""The registered corpus queries against their SQL, and the pipeline against a plain version of its stages."""

import importlib.util
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline  # noqa: E402
from oracle import compare  # noqa: E402
from signalframe.llm import queries  # noqa: E402
from signalframe.llm.secret_scan import scan, ALLOWED, LIMITS  # noqa: E402

_spec = importlib.util.spec_from_file_location("corpus_operators_tests", Path(__file__).with_name("test_corpus_operators.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)
SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    problem, rows = compare(spark, SimpleNamespace(run=queries.QUERIES[name], sql=queries.SQL.get(name)), SMALLEST)
    assert problem is None
    assert rows > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality rules"](spark, docs, SMALLEST)
    texts = {i: t for i, t in texts.items() if brute.brute_quality(t)[-1]}
    assert {r["doc_id"]: r["text"] for r in good.collect()} == texts

    single = stages["near-dedup"](spark, good, SMALLEST)
    ids = sorted(texts)
    groups = brute.brute_groups([texts[i] for i in ids], 5, 4, 5)
    texts = {i: texts[i] for k, i in enumerate(ids) if groups[k][2]}
    assert {r["doc_id"]: r["text"] for r in single.collect()} == texts

    clean = stages["decontamination"](spark, single, SMALLEST)
    ids = sorted(texts)
    hits = brute.brute_contamination([texts[i] for i in ids], items)
    texts = {i: texts[i] for k, i in enumerate(ids) if not (hits[k][1] and 20 * hits[k][1] >= hits[k][0])}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == texts

    masked = stages["secret scans"](spark, clean, SMALLEST)
    assert masked.columns == docs.columns
    import re
    allowed = re.compile("|".join(f"(?:{a})" for a in ALLOWED))
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] != texts[r["doc_id"]]) == bool(scan(texts[r["doc_id"]], LIMITS, allowed))

    packed = stages["packing"](spark, masked, SMALLEST).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    final = corpus_pipeline.run(spark, SMALLEST)
    assert final.count() == len(packed)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, texts and sources, copies, columns with clashing names, an empty benchmark and an empty table."""
    import random

    rng = random.Random(3)
    bodies = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    rows = [(1, bodies[0], "a"), (None, bodies[0], None), (2, bodies[1], None), (None, bodies[2], "b"), (None, bodies[3], "b"), (3, None, "a"), (4, "", "a"),
            (5, bodies[4] + " one more", "a"), (6, bodies[4], "b"), (6, bodies[4], "b"), (7, " ".join([bodies[5]] * 1), "c")]
    columns = "doc_id long, text string, source string, n_chars int, `row` string, c int, node long, spans string"
    docs = spark.createDataFrame([(i, t, s, len(t or ""), "x", 1, 2, "y") for i, t, s in rows], columns)
    no_items = spark.createDataFrame([], "item_id string, text string")
    for name, table in (("some", docs), ("none", docs.where("false"))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        no_items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    some, none = str(tmp_path / "some"), str(tmp_path / "none")
    kept = spark.read.parquet(f"{some}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, some)
        assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 7), (True, 0), (True, 0)]
    assert corpus_pipeline.run(spark, none).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, some).collect()} == {1, 2, 5, 7, None}
