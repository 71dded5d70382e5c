"""Streams over several micro-batches: segments and manifests, replays, merges, and the cost of batches."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from trustlake.functions import storage
from trustlake.plans import q_streaming
from trustlake.streaming import jobs

KEYS, SEQ = ["k"], "seq"


def batch(spark, rows):
    return spark.createDataFrame(rows, "k int, seq long, v string, deleted boolean")


def content(df):
    return sorted((r.k, r.seq, r.v) for r in df.collect())


def plain(rows):
    last = {}
    for k, seq, v, gone in sorted(rows, key=lambda r: r[1]):
        last[k] = (k, seq, v, gone)
    return sorted(r[:3] for r in last.values() if not r[3])


def test_segments_merge_by_size_and_readers_keep_theirs(spark):
    out = storage.new_path(spark, "index")
    rows, seen = [], []
    for n in range(10):
        new = [(k, 100 * n + k, f"v{n}", n % 3 == 2 and k == 1) for k in range(n % 4, n % 4 + 3)]
        jobs.add_segment(batch(spark, new), n, out, KEYS, SEQ, 3)
        rows += new
        now = jobs.manifest(spark, out)
        seen.append((now, plain(rows)))
        assert now["batch"] == n and len(now["segments"]) <= 5
        assert content(jobs.read_index(spark, out, KEYS, SEQ)) == plain(rows)
    # A reader that has a manifest sees its generation, also after merges.
    for held, expected in seen[-4:]:
        assert content(jobs.read_index(spark, out, KEYS, SEQ, held)) == expected
    # A batch that comes again changes nothing.
    before = jobs.manifest(spark, out)
    jobs.add_segment(batch(spark, [(9, 9999, "again", False)]), 9, out, KEYS, SEQ, 3)
    assert jobs.manifest(spark, out) == before
    # Segments that no manifest names are gone.
    for n in range(10, 22):
        jobs.add_segment(batch(spark, [(n, 100 * n, "x", False)]), n, out, KEYS, SEQ, 3)
    assert len(storage.names_in(spark, f"{out}/segments")) < 22
    jobs.compact_index(spark, out, KEYS, SEQ)
    now = jobs.manifest(spark, out)
    assert len(now["segments"]) == 1 and now["batch"] == 21
    assert content(jobs.read_index(spark, out, KEYS, SEQ)) == plain(rows + [(n, 100 * n, "x", False) for n in range(10, 22)])


def test_a_batch_that_died_before_its_manifest_leaves_readers_alone(spark):
    out = storage.new_path(spark, "index")
    jobs.add_segment(batch(spark, [(1, 1, "a", False)]), 0, out, KEYS, SEQ)
    batch(spark, [(1, 2, "half", False)]).write.parquet(f"{out}/segments/{1:012d}-0")
    assert content(jobs.read_index(spark, out, KEYS, SEQ)) == [(1, 1, "a")]
    jobs.add_segment(batch(spark, [(1, 2, "b", False)]), 1, out, KEYS, SEQ)
    assert content(jobs.read_index(spark, out, KEYS, SEQ)) == [(1, 2, "b")]


def test_replay_from_the_start_gives_the_same_rows_and_progress_is_logged(spark):
    source = storage.new_path(spark, "events")
    for n in range(5):
        batch(spark, [(k, 10 * n + k, f"v{n}", False) for k in range(n + 1)]).coalesce(1).write.mode("append").parquet(source)
    found = []
    for _ in range(2):
        out = storage.new_path(spark, "index")
        jobs.run_available(jobs.index_events(jobs.event_stream(spark, source, 1), out, f"{out}/checkpoint", KEYS, SEQ, 2))
        found.append(content(jobs.read_index(spark, out, KEYS, SEQ)))
        log = jobs.progress(spark, f"{out}/progress")
        assert log.agg(F.count("*"), F.sum("input_rows")).first()[:] == (5, 15)
    assert found[0] == found[1] and len(found[0]) == 5
    events = spark.read.parquet(source).unionByName(batch(spark, [(7, 90, "late", False)]))
    assert tuple(jobs.index_progress(spark, out, events, SEQ).first()) == (44, 90, 1)


@pytest.mark.parametrize("keep", [None, "400 days"])
def test_audit_batches_cost_what_they_hold(spark, keep):
    source = storage.new_path(spark, "log")
    for n in range(20):
        rows = spark.range(50 * n, 50 * n + 100).select(F.concat(F.lit("q"), "id").alias("query_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(n))).alias("event_time"), F.when(F.col("id") % 10 != 0, "u").alias("actor"), F.lit("t").alias("resource"))
        rows.coalesce(1).write.mode("append").parquet(source)
    out = storage.new_path(spark, "audit")
    entity = spark.createDataFrame([("t", "urn:t")], "name string, urn string")
    stores = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = jobs.ingest_audit_stream(jobs.event_stream(spark, source, 1), entity, "e", out, f"{out}/checkpoint", keep)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == stores
    jobs.run_available(query)
    counters = sorted(tuple(r) for r in jobs.audit_counters(spark, out).select("batch", "received", "rejected", "accepted", "duplicated", "unresolved").collect())
    assert counters == [(n, 100, 10, 90 if n == 0 else 45, 0 if n == 0 else 45, 0) for n in range(20)]
    assert spark.read.parquet(f"{out}/records").select("record_hash").distinct().count() == 90 + 19 * 45
    took = [r.milliseconds for r in jobs.audit_counters(spark, out).orderBy("batch").collect()]
    assert statistics.median(took[-5:]) < 4 * statistics.median(took[3:8])


def test_grants_expire_by_the_time_of_other_rows(spark):
    source = storage.new_path(spark, "grants")
    rows = [[("a", "ACTIVE", 5, 1), ("b", "ACTIVE", 30, 1), ("c", "REVOKED", 5, 1)], [("b", "ACTIVE", 90, 2)], [("z", "ACTIVE", 99, 40)], [("late", "ACTIVE", 30, 41)]]
    for own in rows:
        df = spark.createDataFrame(own, "id string, status string, e int, t int").coalesce(1)
        day = lambda c: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col(c))
        df.select("id", "status", day("e").alias("expires_at"), day("t").alias("at")).write.mode("append").parquet(source)
    out = storage.new_path(spark, "states")
    states = jobs.grant_states(jobs.event_stream(spark, source, 1))
    sink = states.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    jobs.run_available(jobs.started(sink, spark, **jobs.ROCKSDB))
    got = sorted((r.id, r.status) for r in spark.read.schema(states.schema).parquet(f"{out}/rows").collect())
    assert got == [("a", "ACTIVE"), ("a", "EXPIRED"), ("b", "ACTIVE"), ("b", "ACTIVE"), ("c", "REVOKED"), ("late", "EXPIRED"), ("z", "ACTIVE")]


def test_files_of_a_micro_batch_grow_in_number_with_its_rows(spark, data, monkeypatch):
    taken, own = [], jobs.event_stream
    monkeypatch.setattr(q_streaming, "_FILE_ROWS", 120)
    monkeypatch.setattr(jobs, "event_stream", lambda spark, path, files=None: taken.append((path, files)) or own(spark, path, files))
    rows = spark.read.parquet(f"{data}/events.parquet").count()
    out, files = q_streaming._audited(spark, data), -(-(rows // 2) // 120)
    assert files > 1 and taken[0][1] == files and len(spark.read.parquet(taken[0][0]).inputFiles()) == 7 * files
    log = jobs.progress(spark, f"{out}/progress").agg(F.count("*"), F.sum("input_rows"), F.max("input_rows")).first()
    assert log[0] == 7 and log[1] == 3 * rows and log[2] < rows
    assert spark.read.parquet(f"{out}/records").count() == spark.read.parquet(f"{data}/events.parquet").filter("event_id % 97 != 0").count()
