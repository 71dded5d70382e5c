"""The pipeline's stages, each beside what its input asks for, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, rows_of, rows_of_sql
from tests.llm.test_nearcopies import brute_force
from trustlake.llm import queries, secrets, toxicity
from trustlake.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], data), name))
    return out


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:4])


def test_toxic_documents_go_and_others_stay(spark, data, stages):
    scored = toxicity.score(stages[0], toxicity.fit(stages[0], spark.read.parquet(f"{data}/labels.parquet")))
    assert {r.doc_id for r in scored.filter(F.col("score") < 0.7).collect()} == {r.doc_id for r in stages[1].collect()}


def test_one_of_each_group_stays(stages):
    want = brute_force([(r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect()])
    assert sorted(set(want.values())) == sorted(r.doc_id for r in stages[2].collect())


def test_live_secrets_are_gone(spark, data, stages):
    assert stages[3].count() == stages[2].count()
    left = secrets.find_secrets(stages[3], corpus=spark.read.parquet(f"{data}/documents.parquet")).select(F.explode("secrets").alias("s")).filter("s.live")
    assert left.count() == 0
    assert stages[3].filter("n_chars != length(text)").count() == 0


def test_packing_holds_every_document(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_the_whole_table(spark, data, name):
    found = queries.QUERIES[name](spark, data)
    if name in queries.ORACLES:
        assert rows_of(found) == rows_of_sql(connect(data), queries.ORACLES[name])
    elif name.startswith(("op1_", "op4_", "op6_", "op9_", "op10_")):
        assert found.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    elif name.startswith(("op2_", "op3_")):
        assert found.count() == spark.read.parquet(f"{data}/pages.parquet").count()
    else:
        assert found.count() > 0
