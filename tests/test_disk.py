"""What large tables leave on disk: no wide rows are dealt out, nothing is written that is read once, shuffle files go."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from trustlake.functions.storage import written
from trustlake.operators import graph
from trustlake.plans import fixtures
from trustlake.plans.catalog import QUERIES
from trustlake.plans.fixtures import VIEWS, dealt_lineage, lineage_by_number, load, number_of, urn_of


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    assert written(spark.range(200_000).repartition(3, "id"), "numbers").count() == 200_000
    # The count, which is no written table, leaves files of a row for each of its tasks.
    large = lambda: [f for f in files() - before if spark._jvm.java.io.File(f).length() > 4000]
    late = time.time() + 20
    while large() and time.time() < late:
        time.sleep(0.2)
    assert not large()


def test_edges_by_number_are_those_of_the_view(spark, data):
    load(spark, data, "lineage_edge")
    view, made = spark.sql(VIEWS["lineage_edge"]), lineage_by_number(spark, data)
    assert made.schema["from_urn"].dataType.simpleString() == "bigint" and not made.select("from_urn").exceptAll(made.select(number_of(urn_of(F.col("from_urn"))))).count()
    named = made.withColumns({c: urn_of(F.col(c)) for c in ("from_urn", "to_urn")}).distinct()
    assert named.exceptAll(view).isEmpty() and view.exceptAll(named).isEmpty()


def test_the_last_hop_of_many_roots_is_neither_written_nor_joined_to_them(spark, monkeypatch):
    edge = spark.range(300).select((F.col("id") % 60).alias("from_urn"), ((F.col("id") * 7 + 3) % 60).alias("to_urn"))
    roots = spark.range(0, 60, 3).select(F.col("id").alias("root"))
    few, all_few = (sorted(graph.closure(edge, roots, "down", depth).collect()) for depth in (3, None))
    labels, own = [], graph._hop
    monkeypatch.setattr(graph, "_hop", lambda df, label: labels.append(label) or own(df, label))
    monkeypatch.setattr(graph, "_SENT_ROWS", 10)
    made = graph.closure(edge, roots, "down", 3, stored=True)
    assert labels == ["roots", "hop", "hop"] and "block" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert few and sorted(made.collect()) == few
    # A walk without an end stops where nothing new is met.
    assert sorted(graph.closure(edge, roots, "down", None).collect()) == all_few


def test_affected_assets_are_walked_by_number(spark, data, monkeypatch):
    kinds, own = [], graph._hop
    monkeypatch.setattr(graph, "_hop", lambda df, label: kinds.append((label, df.schema[0].dataType.simpleString())) or own(df, label))
    QUERIES["o5_affected"](spark, data)
    assert kinds and all(k == "bigint" for _, k in kinds) and "steps" not in dict(kinds)


def _exchanged(df):
    """The columns of all that a query deals out or sends."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM"), plan
    logical = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return plan, [line for line in logical if "Repartition" in line]


def test_dealt_edges_are_those_of_the_view_repeated_and_without_keys(spark, data, tmp_path):
    for table in ("region", "part", "nation", "supplier", "lineitem", "orders", "customer"):
        own = load(spark, data, table)
        keys = [c for c in own.columns if c.endswith("key")]
        odd = own.limit(3).withColumns({k: F.lit(None).cast(own.schema[k].dataType) for k in keys})
        half = own.limit(5).withColumn(keys[0], F.lit(None).cast(own.schema[keys[0]].dataType))
        own.unionByName(own.limit(20)).unionByName(odd).unionByName(half).write.parquet(f"{tmp_path}/{table}.parquet")
    load(spark, str(tmp_path), "lineage_edge")
    made, view = dealt_lineage(spark, str(tmp_path)), spark.sql(VIEWS["lineage_edge"])
    made = made.withColumns({c: urn_of(F.col(c)) for c in ("from_urn", "to_urn")}).select(*view.columns)
    assert made.exceptAll(view).isEmpty() and view.exceptAll(made).isEmpty() and view.count() > view.distinct().count()


def test_an_upsert_of_edges_deals_out_numbers_alone(spark, data):
    plan, dealt = _exchanged(QUERIES["s10_upsert_edges"](spark, data))
    assert plan.count("Exchange") == 1 and len(dealt) == 1 and "from_urn" in dealt[0] and plan.index("Exchange") > plan.index("is_new")


def test_reviews_meet_edges_where_they_lie(spark, data, monkeypatch):
    monkeypatch.setattr(fixtures, "EDGE_ROWS", 5000)
    plan, dealt = _exchanged(QUERIES["g8_reviews"](spark, data))
    assert plan.count("hashpartitioning(from_urn") == len(dealt) == 2
    # What is dealt out for the reviews are edges that have one.
    assert "Filter" in plan[plan.rindex("Exchange") :] and "% 31" in plan[plan.rindex("Exchange") :]
