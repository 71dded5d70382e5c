"""Streams over driver tables, run to the end of what is there."""

from __future__ import annotations


from pyspark.sql import functions as F

from trustlake.functions.storage import discard, new_path, written
from trustlake.plans.fixtures import load, with_views
from trustlake.plans.registry import query
from trustlake.operators import access
from trustlake.sources import ingest
from trustlake.plans.q_ingest import lineage_events, write_documents
from trustlake.streaming import jobs


def _events(spark, sf_dir):
    return jobs.event_stream(spark, f"{sf_dir}/events.parquet")


def _collected(spark, stream, mode):
    """All that a stream gives, written as Parquet in the shared folder."""
    out = new_path(spark, "stream")
    schema = stream.schema
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", f"{out}/rows")
    else:
        sink = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows"))
    jobs.run_available(jobs.started(sink.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True), spark, **jobs.ROCKSDB))
    return spark.read.schema(schema).parquet(f"{out}/rows")


#: Rows of a file that a stream reads; a file is one task's.
_FILE_ROWS = 250_000


def _files(rows):
    """The files of a micro-batch of so many rows."""
    return max(1, -(-rows // _FILE_ROWS))


def _folder(spark, sf_dir, table="events", batches=6):
    """A table in a folder that a stream takes in some micro-batches, and the number of files that each has."""
    path, own = new_path(spark, table), load(spark, sf_dir, table)
    files = _files(own.count() // batches)
    own.repartitionByRange(batches * files, "event_id").write.parquet(path)
    return path, files


def _in_turn(spark, df, order, files, label):
    """A folder whose files a stream takes in the order of a column.

    Streams take files by the time of their writing, and files that tasks write side by side end in any order; so each is
    written after the one before.
    """
    path = new_path(spark, label)
    cut = written(df.repartitionByRange(files, order).withColumn("slice", F.spark_partition_id()), "slices")
    for i in range(files):
        cut.filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
    discard(cut)
    return path


_INDEXED = "WITH l AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


def _indexed(spark, sf_dir, compact=False):
    """An index by several micro-batches; the last event of an erring user takes the user out."""
    out = new_path(spark, "index")
    events = jobs.event_stream(spark, *_folder(spark, sf_dir)).withColumn("deleted", F.col("event_type") == "error")
    jobs.run_available(jobs.index_events(events, out, f"{out}/checkpoint", ["user_id"], "event_id", 3))
    if compact:
        jobs.compact_index(spark, out, ["user_id"], "event_id")
    return out


@query(f"{_INDEXED} SELECT * FROM l WHERE event_type <> 'error'")
def st1_index_stream(spark, sf_dir):
    return jobs.read_index(spark, _indexed(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query(f"{_INDEXED} SELECT * FROM l WHERE event_type <> 'error'")
def st1_compacted_index(spark, sf_dir):
    return jobs.read_index(spark, _indexed(spark, sf_dir, True), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT max(event_id) AS reached, max(event_id) + 5 AS offset, CAST(5 AS BIGINT) AS lag FROM events")
def st1_index_progress(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id")
    late = events.orderBy(F.desc("event_id")).limit(5).select(F.col("event_id") + 5)
    return jobs.index_progress(spark, _indexed(spark, sf_dir), events.union(late), "event_id")


@query("WITH d AS (SELECT DISTINCT 'u' || user_id AS actor, 'app.' || event_type AS resource, upper(event_type) AS operation, event_id FROM events WHERE event_id % 97 <> 0) SELECT actor, resource, operation, count(*) AS n FROM d GROUP BY 1, 2, 3")
def st2_audit_stream(spark, sf_dir):
    e = _events(spark, sf_dir)
    # Each event comes twice; those without an actor are rejected.
    raw = e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "*").select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"), F.col("ts").cast("timestamp").alias("event_time"), F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("actor"), F.col("event_type").alias("operation"), F.concat(F.lit("app."), F.col("event_type")).alias("resource_raw"), F.floor("value").cast("long").alias("rows_scanned")
    )
    found = _collected(spark, jobs.audit_stream(raw, "eng", "40 days").select("actor", "resource", "operation"), "append")
    return found.groupBy("actor", "resource", "operation").agg(F.count("*").alias("n"))


_TWICE = "WITH d AS (SELECT event_id, ts, 'u' || user_id AS actor, 'app.' || event_type AS resource, event_type FROM events WHERE event_id % 97 <> 0)"


def _audited(spark, sf_dir):
    """Each event three times: twice in its own micro-batch, once more in another."""
    again, own = new_path(spark, "again"), load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    files = _files(own.count() // 2)
    own.repartitionByRange(4 * files, "event_id").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).write.parquet(again)
    own.withColumn("copy", F.lit(2)).repartitionByRange(3 * files, F.desc("event_id")).write.mode("append").parquet(again)
    e = jobs.event_stream(spark, again, files)
    raw = e.select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"), F.col("ts").cast("timestamp").alias("event_time"), F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("actor"), F.col("event_type").alias("operation"), F.concat(F.lit("app."), F.col("event_type")).alias("resource_raw")
    )
    entity = load(spark, sf_dir, "events").filter("event_type != 'error'").select(F.concat(F.lit("app."), F.col("event_type")).alias("name"), F.concat(F.lit("urn:asset:Dataset:prod.app."), F.col("event_type")).alias("urn")).distinct()
    # Each micro-batch joins the entities, so they are not to be derived from the events each time.
    entity, out = written(entity, "entities"), new_path(spark, "audit")
    jobs.run_available(jobs.ingest_audit_stream(raw, entity, "eng", out, f"{out}/checkpoint"))
    return out


@query(f"{_TWICE} SELECT sha256('eng|q' || event_id) AS record_hash, actor, resource, upper(event_type) AS operation, CASE WHEN event_type <> 'error' THEN 'urn:asset:Dataset:prod.app.' || event_type END AS urn FROM d")
def st2_audit_records(spark, sf_dir):
    return spark.read.parquet(f"{_audited(spark, sf_dir)}/records").select("record_hash", "actor", "resource", "operation", "urn")


@query(f"{_TWICE} SELECT 3 * (SELECT count(*) FROM events) AS received, 3 * (SELECT count(*) FROM events WHERE event_id % 97 = 0) AS rejected, count(*) AS accepted, 2 * count(*) AS duplicated, count(*) FILTER (event_type = 'error') AS unresolved, min(ts) AS first_event, max(ts) AS last_event FROM d")
def st2_audit_counters(spark, sf_dir):
    counters = jobs.audit_counters(spark, _audited(spark, sf_dir))
    sums = [F.sum(c).alias(c) for c in ("received", "rejected", "accepted", "duplicated", "unresolved")]
    return counters.agg(*sums, F.min("first_event").cast("timestamp_ntz").alias("first_event"), F.max("last_event").cast("timestamp_ntz").alias("last_event"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS value_num FROM events GROUP BY 1, 2")
def st4_daily_stream(spark, sf_dir):
    return _collected(spark, jobs.daily_metrics(_events(spark, sf_dir), "ts", ["event_type"], "40 days"), "complete")


_KEYS = 97
#: Evaluations by second up to ten minutes before the last event, then the state of each key from one to the next.
_ALERTS = f"""
WITH RECURSIVE sig AS (SELECT 'k' || (user_id % {_KEYS}) AS k, date_trunc('second', ts) AS tm, event_type <> 'purchase' AS firing, CASE WHEN event_id % 5 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM events),
ev AS (SELECT k, tm, bool_or(firing) AS firing, CASE WHEN bool_or(firing AND severity = 'CRITICAL') OR (NOT bool_or(firing) AND bool_or(severity = 'CRITICAL')) THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM sig GROUP BY 1, 2),
n AS (SELECT *, epoch(tm) AS t, row_number() OVER (PARTITION BY k ORDER BY tm) AS i FROM ev WHERE tm + INTERVAL 1 SECOND <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE),
st(k, i, tm, live, severity, notified, resolved, fires, action) AS (SELECT DISTINCT k, 0::BIGINT, NULL::TIMESTAMP, false, '', 0::DOUBLE, -1e18::DOUBLE, 0, NULL::VARCHAR FROM n UNION ALL
SELECT s.k, n.i, n.tm, CASE WHEN s.live THEN n.firing ELSE n.firing AND n.t - s.resolved >= 300 END, CASE WHEN NOT s.live AND n.firing AND n.t - s.resolved >= 300 THEN n.severity ELSE s.severity END,
CASE WHEN n.firing AND (s.live AND n.t - s.notified >= 43200 OR NOT s.live AND n.t - s.resolved >= 300) THEN n.t ELSE s.notified END, CASE WHEN s.live AND NOT n.firing THEN n.t ELSE s.resolved END,
CASE WHEN s.live AND n.firing THEN s.fires + 1 WHEN NOT s.live AND n.firing AND n.t - s.resolved >= 300 THEN 1 ELSE s.fires END,
CASE WHEN s.live AND n.firing THEN CASE WHEN n.t - s.notified >= 43200 THEN 'REMINDED' END WHEN s.live THEN 'RESOLVED' WHEN n.firing THEN CASE WHEN n.t - s.resolved < 300 THEN 'FLAP_SUPPRESSED' ELSE 'FIRED' END END
FROM st s JOIN n ON n.k = s.k AND n.i = s.i + 1)
SELECT k AS dedup_key, tm AS "at", action, severity, fires AS fire_count FROM st WHERE action IS NOT NULL"""


@query(_ALERTS)
def st3_alert_stream(spark, sf_dir):
    e = jobs.event_stream(spark, _in_turn(spark, load(spark, sf_dir, "events"), "ts", 6, "events"), 2)
    signals = e.select(F.concat(F.lit("k"), (F.col("user_id") % _KEYS).cast("string")).alias("dedup_key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "purchase").alias("firing"), F.when(F.col("event_id") % 5 == 0, "CRITICAL").otherwise("WARNING").alias("severity"))
    return _collected(spark, jobs.alert_actions(signals), "append").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT 'n.c' || user_id AS from_name, 'n.o' || event_id AS to_name, 'table' AS level, 'DIRECT' AS transform, 0.95::DOUBLE AS confidence FROM events UNION ALL SELECT 'n.c' || user_id || '.y', 'n.o' || event_id || '.x', 'column', CASE WHEN event_id % 3 = 0 THEN 'MASKED' WHEN event_id % 2 = 1 THEN 'INDIRECT' ELSE 'DIRECT' END, 0.95 FROM events")
def s7_openlineage_stream(spark, sf_dir):
    renamed = _events(spark, sf_dir).withColumnsRenamed({"user_id": "o_custkey", "event_id": "o_orderkey"})
    return _collected(spark, ingest.openlineage_edges(lineage_events(renamed)), "append")


@query(with_views("SELECT id, CASE WHEN status = 'ACTIVE' AND expires_at < TIMESTAMP '2024-04-10' THEN 'EXPIRED' ELSE status END AS status FROM access_grant", "access_grant"))
def st5_expiry_scan(spark, sf_dir):
    from trustlake.operators.access import expire

    path = new_path(spark, "grants")
    load(spark, sf_dir, "access_grant").write.parquet(path)
    grants = jobs.event_stream(spark, path)
    return _collected(spark, expire(grants, "2024-04-10 00:00:00").select("id", "status"), "append")


@query(
    with_views(
        "g AS (SELECT subject || '|' || resource_urn AS id, status, expires_at, granted_at FROM access_grant), w AS (SELECT max(granted_at) + INTERVAL 95 DAY AS now FROM g) SELECT id, status, expires_at FROM g UNION ALL SELECT id, 'EXPIRED', expires_at FROM g, w WHERE status = 'ACTIVE' AND expires_at < now UNION ALL SELECT 'other', 'REVOKED', now FROM w",
        "access_grant",
    )
)
def st5_expiry_timers(spark, sf_dir):
    grants = load(spark, sf_dir, "access_grant").select(F.concat_ws("|", "subject", "resource_urn").alias("id"), "status", F.col("expires_at").cast("timestamp").alias("expires_at"), F.col("granted_at").cast("timestamp").alias("at"))
    path = _in_turn(spark, grants, "at", 2, "grants")
    # Long after the others something comes for another grant.
    late = grants.agg((F.max("at") + F.expr("INTERVAL 95 DAY")).alias("at"))
    late.select(F.lit("other").alias("id"), F.lit("REVOKED").alias("status"), F.col("at").alias("expires_at"), "at").write.mode("append").parquet(path)
    found = _collected(spark, jobs.grant_states(jobs.event_stream(spark, path, 1)), "append")
    return found.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("SELECT k AS kind, 'q' || event_id AS query_id, 'u' || user_id AS actor, 'app.' || event_type AS resource, upper(event_type) AS operation FROM events, (VALUES ('jsonl'), ('csv'), ('json')) v(k)")
def s8_audit_log_stream(spark, sf_dir):
    """The events as a log in each form, read as streams."""
    names, out = ["queryId", "eventTime", "user", "table", "op"], None
    own = load(spark, sf_dir, "events").select(F.concat(F.lit("q"), F.col("event_id").cast("string")), F.col("ts").cast("string"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("app."), "event_type"), "event_type").toDF(*names)
    for kind in ("jsonl", "csv", "json"):
        path = new_path(spark, f"log-{kind}")
        if kind == "jsonl":
            own.write.json(path)
        elif kind == "csv":
            own.write.option("header", True).csv(path)
        else:
            write_documents(own.groupBy(F.pmod(F.xxhash64("user"), F.lit(50)).alias("b")).agg(F.collect_list(F.struct(*names)).alias("queries")).select("queries"), path)
        raw = ingest.audit_log_stream(spark, path, kind, ", ".join(f"`{n}` string" for n in names))
        found = _collected(spark, access.normalize_audit(raw)[0].select("query_id", "actor", "resource", "operation"), "append").withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out
