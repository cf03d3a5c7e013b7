"""Every stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skywell.llm import languages
from skywell.llm.common import stored
from tests.llm.helpers import SCHEMA
from tests.llm.test_texts import plain_components, plain_removal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_return_document_columns(tables):
    for t in tables[:-1]:
        assert t.columns == tables[0].columns


def test_language_stage_keeps_clean_documents(tables):
    before, after = rows(tables[0]), rows(tables[1])
    assert set(after) <= set(before) and all(before[k]["text"] == after[k]["text"] for k in after)
    gone = [before[k] for k in set(before) - set(after)]
    assert all(not languages.has_letter(r["text"]) for r in gone) or len(gone) < 0.02 * len(before)


def test_quality_stage_follows_labels(spark, tables):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(tables[1]), rows(tables[2])
    known = [k for k in before if k in labels]
    assert sum((k in after) == bool(labels[k]) for k in known) > 0.95 * len(known)


def test_near_duplicates_leave_one_each(tables):
    before = rows(tables[2])
    want = plain_components([(k, r["text"]) for k, r in before.items()])
    assert set(rows(tables[3])) == {k for k, (_, c) in want.items() if k == c}


def test_repeats_are_removed(tables):
    before, after = rows(tables[3]), rows(tables[4])
    want = plain_removal([(k, r["text"]) for k, r in before.items()], 200)
    assert set(before) == set(after)
    for k, r in after.items():
        assert r["n_chars"] == len(r["text"])
        assert 0 <= want[k][0] - want[k][1] - len(r["text"].encode()) < 4 * (want[k][2] + 1)


def test_packing_covers_the_last_documents(tables):
    assert {r["doc_id"] for r in tables[5].select("doc_id").distinct().collect()} == set(rows(tables[4]))


def test_stages_handle_nulls_clashes_and_empty_tables(spark, tables):
    docs = tables[0].limit(60).withColumns({c: F.lit(1) for c in ("score", "predicted", "_doc", "n", "c", "kept", "th")})
    odd = docs.limit(2).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "n_chars": F.lit(None).cast("long")})
    for docs in (docs.unionByName(odd).unionByName(docs.limit(1)), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stored(stage(spark, docs, SF), name)
            assert name == "best_fit_packing" or docs.columns == before


def test_single_tells_documents_by_id_and_text(spark):
    a, b, c, d = ("".join(f"{w}{i} " for i in range(40)) for w in "abcd")
    given = [(1, a), (1, b), (2, a + "tail"), (None, c), (None, c), (None, d), (3, None), (3, None), (None, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.single(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (None, d), (3, None), (None, None), (4, ""), (5, "")], key=str)


def test_choice_does_not_repeat_the_statistics(spark, tables):
    plan = corpus_pipeline.good(spark, tables[0], SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 0 and len(plan) < 5000


def test_stages_send_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    try:
        spark.conf.set(name, str(64 << 20))
        corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame([], SCHEMA), SF)
        assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) <= 8 << 20
    finally:
        spark.conf.set(name, before)
