"""Tables of narrow rows are dealt out before wide rows are made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlake.operators import contracts, graph, metadata
from trustlake.plans import q_ingest, q_metadata
from trustlake.plans.catalog import QUERIES
from trustlake.plans.fixtures import VIEWS, load, spread


def test_a_file_of_narrow_rows_is_dealt_out_by_its_rows(spark, tmp_path):
    spark.range(120_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    part = spark.read.parquet(f"{tmp_path}/part.parquet")
    assert part.rdd.getNumPartitions() < 3
    made = q_ingest._manifests(spark, str(tmp_path))
    sizes = [r.n for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 3 and sum(sizes) == 120_000 and max(sizes) < 60_000
    assert spread(part.limit(0), "p_partkey").count() == 0


def test_manifests_are_joined_by_sizes_that_are_known(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    edges, skipped = q_ingest.ingest.manifest_edges(q_ingest._manifests(spark, str(tmp_path)))
    # Nothing is parsed again for either side of a join.
    assert "from_json" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 120_000 and [r[:] for r in skipped.collect()] == [("model.p.gone", 60_000)]


def test_assets_are_not_sent_to_all_tasks_by_an_estimate(spark, data):
    plan = q_ingest._metrics(spark, data)[1]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin [name") >= 3


def test_properties_that_are_there_are_not_sent_to_all_tasks(spark, data):
    plan = QUERIES["f11_validate_aspects"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [urn" in plan


def test_edges_are_told_apart_by_numbers_and_equal_their_view(spark, data):
    made, view = load(spark, data, "lineage_edge"), spark.sql(VIEWS["lineage_edge"])
    assert made.schema.simpleString() == view.schema.simpleString()
    assert made.exceptAll(view).isEmpty() and view.exceptAll(made).isEmpty()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_suppkey" in plan and "Aggregate [l_partkey" in plan


def test_rows_of_few_roots_are_not_dealt_out_by_their_block(spark, data):
    plan = QUERIES["g1_closure"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [block" not in plan and "BroadcastHashJoin [block" in plan


def test_many_roots_by_shuffle_give_the_same_closure(spark, monkeypatch):
    edge = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 500).alias("from_urn"), F.concat(F.lit("n"), (F.col("id") * 7 + 3) % 500).alias("to_urn"))
    roots = spark.range(0, 500, 3).select(F.concat(F.lit("n"), "id").alias("root"))
    few = sorted(graph.closure(edge, roots, "down", 3).collect())
    monkeypatch.setattr(graph, "_SENT_ROWS", 10)
    monkeypatch.setattr(graph, "_TASK_ROWS", 700)
    assert few and sorted(graph.closure(edge, roots, "down", 3).collect()) == few


def test_all_edges_meet_their_reviews_unsorted_and_once(spark, data):
    plan = QUERIES["g8_reviews"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_gate_walks_once(spark, data, monkeypatch):
    walks, own = [], graph.closure
    for module in (graph, contracts):
        monkeypatch.setattr(module, "closure", lambda *a, **k: walks.append(1) or own(*a, **k))
    QUERIES["c4_gate"](spark, data)
    assert len(walks) == 1


def test_edges_are_derived_once_and_sorted_once_for_an_upsert(spark, data):
    made = QUERIES["s10_upsert_edges"](spark, data)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Sort [__key" in plan and plan.count("lineitem.parquet") == 2
    # The rows of both sides are those of the SQL.
    load(spark, data, "lineage_edge").createOrReplaceTempView("lineage_edge")
    seen = spark.sql(q_metadata._SEEN)
    again = metadata.upsert_edges(seen.filter("side = 0").drop("side"), seen.filter("side = 1").drop("side"))
    assert again.schema == made.schema and made.exceptAll(again).isEmpty() and again.exceptAll(made).isEmpty()
