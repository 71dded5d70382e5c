"""Logs and streams of several files, written by many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlake.functions import storage
from trustlake.plans import q_streaming
from trustlake.plans.q_ingest import write_documents
from trustlake.sources import ingest
from trustlake.streaming import jobs


def test_every_document_of_a_log_is_read_however_many_a_task_writes(spark):
    log = spark.range(400).select(F.col("id").cast("string").alias("queryId"), (F.col("id") % 40).alias("b"))
    documents = log.groupBy("b").agg(F.collect_list(F.struct("queryId")).alias("records")).select("records")
    path = storage.new_path(spark, "log")
    # Three tasks, forty documents.
    write_documents(documents.repartition(3), path)
    assert sorted(int(r.queryId) for r in ingest.read_audit_log(spark, path, "json").collect()) == list(range(400))


def test_a_stream_takes_files_in_the_order_of_time(spark):
    # Ids and times run against each other, as in a table of repeated events.
    rows = spark.range(6000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 6000).alias("ts"))
    events = jobs.event_stream(spark, q_streaming._in_turn(spark, rows, "ts", 6, "events"), 2)
    spans = []
    stream = events.writeStream.foreachBatch(lambda df, n: spans.append(df.agg(F.min("ts"), F.max("ts"), F.count("*")).first()[:]))
    stream.option("checkpointLocation", storage.new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert len(spans) == 3 and sum(s[2] for s in spans) == 6000
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
