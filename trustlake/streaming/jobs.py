"""Structured Streaming jobs: search index, audit log, alert state, daily metrics (ST1 to ST5)."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trustlake.functions.storage import names_in, remove, write_text
from trustlake.operators import access
from trustlake.operators.metadata import latest_by
from trustlake.operators.observe import severity_rank

REMIND_SECONDS = 12 * 3600
COOLDOWN_SECONDS = 300


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder, or a single file, as a stream. A stream reads folders, so a file is picked out of its folder by name."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


class ProgressLog(StreamingQueryListener):
    """Writes a JSON file for each micro-batch of a query: its rows, offsets, how far the source goes on, and what it observes.

    A batch that is run again replaces its file.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.query, self.over = spark, folder, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) != self.query:
            return
        source = p.sources[0]
        observed = {k: v for row in (p.observedMetrics or {}).values() for k, v in row.asDict().items()}
        line = {"batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "reached": source.endOffset, "offset": source.latestOffset or source.endOffset, "milliseconds": int(p.durationMs.get("triggerExecution", 0)), **observed}
        if p.numInputRows:
            write_text(self.spark, f"{self.folder}/{p.batchId:012d}.json", json.dumps(line, default=str))

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query:
            self.over.set()


_LOGS: dict[str, ProgressLog] = {}


def started(writer, spark: SparkSession, log: str | None = None, **settings: str):
    """Start a stream under some settings, which the session has back afterwards, with a log of its progress in a folder."""
    before = {k: spark.conf.get(k, None) for k in settings}
    listener = ProgressLog(spark, log) if log else None
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        if listener:
            spark.streams.addListener(listener)
        query = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if listener:
        listener.query = str(query.id)
        _LOGS[listener.query] = listener
    return query


def run_available(query, timeout: int | None = None) -> None:
    """Process all that is there now, then stop; the log of the progress is complete then."""
    query.awaitTermination(timeout)
    log = _LOGS.pop(str(query.id), None)
    if log:
        log.over.wait(60)
        log.spark.streams.removeListener(log)


def progress(spark: SparkSession, log: str) -> DataFrame:
    """What a log of progress holds, one row for each micro-batch."""
    return spark.read.json(log)


#: Segments of a level that are merged into one of the next, and manifests that are kept for readers.
FANOUT, KEPT = 4, 8


def manifest(spark: SparkSession, out: str) -> dict:
    """The newest manifest of an index: generation, last batch, and segments (name, level, rows, reached)."""
    names = [n for n in names_in(spark, f"{out}/manifests") if n.endswith(".json")]
    if not names:
        return {"generation": 0, "batch": -1, "segments": []}
    return json.loads(spark.read.text(f"{out}/manifests/{names[-1]}", wholetext=True).first()[0])


def _segment(spark: SparkSession, out: str, name: str, level: int, rows: DataFrame, seq: str) -> dict:
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(seq).cast("string").alias("reached")).write.mode("overwrite").parquet(f"{out}/segments/{name}")
    return {"name": name, "level": level, **seen.get}


def _publish(spark: SparkSession, out: str, now: dict) -> None:
    """The next manifest, in one step; segments that none of the last KEPT manifests names are deleted."""
    write_text(spark, f"{out}/manifests/{now['generation']:012d}.json", json.dumps(now, default=str))
    old = [n for n in names_in(spark, f"{out}/manifests") if n.endswith(".json")][:-KEPT]
    if old:
        named = {s["name"] for r in spark.read.text(f"{out}/manifests", wholetext=True, pathGlobFilter="*.json").collect() for s in json.loads(r[0])["segments"] if int(json.loads(r[0])["generation"]) > now["generation"] - KEPT}
        for name in names_in(spark, f"{out}/segments"):
            if name not in named:
                remove(spark, f"{out}/segments/{name}")
        for name in old:
            remove(spark, f"{out}/manifests/{name}")


def add_segment(batch: DataFrame, number: int, out: str, keys: list[str], seq: str, fanout: int = FANOUT) -> None:
    """The latest event of each key of a batch as a segment, and a manifest with it (ST1).

    Segments are never changed. ``fanout`` segments of a level are merged into one of the next level, before the manifest is
    published; so a key is written again once for each level, and readers have few segments. Deleted keys stay as such
    until everything is merged into one segment. A batch that the manifest has already changes nothing.
    """
    spark, now = batch.sparkSession, manifest(batch.sparkSession, out)
    if number <= now["batch"]:
        return
    segments = [*now["segments"], _segment(spark, out, f"{number:012d}-0", 0, latest_by(batch, keys, seq), seq)]
    level = 0
    while len(own := [s for s in segments if s["level"] == level]) >= fanout:
        rows = latest_by(spark.read.parquet(*[f"{out}/segments/{s['name']}" for s in own]), keys, seq)
        rest = [s for s in segments if s["level"] != level]
        if not rest and "deleted" in rows.columns:
            rows = rows.filter(~F.coalesce("deleted", F.lit(False)))
        merged = _segment(spark, out, f"{number:012d}-{level + 1}", level + 1, rows, seq)
        reached = [s["reached"] for s in own if s["reached"] is not None]
        segments = [*rest, merged | {"reached": max(reached, key=lambda x: (len(x), x)) if reached else None}]
        level += 1
    _publish(spark, out, {"generation": now["generation"] + 1, "batch": number, "segments": segments})


def index_events(events: DataFrame, out: str, checkpoint: str, keys: list[str], seq: str, fanout: int = FANOUT):
    """A search index that follows a stream of events, by segments under a manifest (ST1).

    At least once: a batch that is run again is known by its number. An event with ``deleted`` true takes its key out. Readers
    see one manifest's segments. A rebuild is a run from the start into a new folder. ``progress`` has lag and offsets.
    """
    write = lambda batch, number: add_segment(batch, number, out, keys, seq, fanout)
    stream = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return started(stream, events.sparkSession, f"{out}/progress")


def read_index(spark: SparkSession, out: str, keys: list[str], seq: str, of: dict | None = None) -> DataFrame:
    """The index by its newest manifest, or by the one given: the latest event of each key, deleted keys left out (ST1)."""
    segments = (of or manifest(spark, out))["segments"]
    last = latest_by(spark.read.parquet(*[f"{out}/segments/{s['name']}" for s in segments]), keys, seq)
    return last.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in last.columns else last


def compact_index(spark: SparkSession, out: str, keys: list[str], seq: str) -> None:
    """All segments of an index merged into one, without what is deleted, under the next manifest (ST1). No stream may write meanwhile."""
    now = manifest(spark, out)
    generation, level = now["generation"] + 1, max((s["level"] for s in now["segments"]), default=0) + 1
    rows = latest_by(spark.read.parquet(*[f"{out}/segments/{s['name']}" for s in now["segments"]]), keys, seq)
    rows = rows.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in rows.columns else rows
    reached = [s["reached"] for s in now["segments"] if s["reached"] is not None]
    merged = _segment(spark, out, f"{generation:012d}-all", level, rows, seq) | {"reached": max(reached, key=lambda x: (len(x), x)) if reached else None}
    _publish(spark, out, {"generation": generation, "batch": now["batch"], "segments": [merged]})


def index_progress(spark: SparkSession, out: str, events: DataFrame, seq: str) -> DataFrame:
    """One row: the offset that the index has reached by its manifest, that of the events, and how many events it lags behind (ST1).

    ``seq`` is a whole number. Only events behind the offset are counted, which a scan can prune by its statistics.
    """
    reached = [int(s["reached"]) for s in manifest(spark, out)["segments"] if s["reached"] is not None]
    at = F.lit(max(reached) if reached else None).cast("long")
    return events.agg(at.alias("reached"), F.max(seq).alias("offset"), F.count_if(at.isNull() | (F.col(seq) > at)).alias("lag"))


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


#: State is not read once more for each row that is written, only to count its rows.
UNCOUNTED = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def audit_stream(raw: DataFrame, engine: str, late: str = "7 days") -> DataFrame:
    """Audit rows under common names, each record once within the watermark (ST2)."""
    ok = access.normalize_audit(raw)[0].withColumn("record_hash", access.record_hash(engine))
    return ok.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["record_hash"])


def ingest_audit_stream(raw: DataFrame, entity: DataFrame, engine: str, out: str, checkpoint: str, keep: str | None = None):
    """Audit records by micro-batch, each once, with their URN; and counters for each batch (ST2).

    Hashes that have been seen are state in RocksDB, so a batch costs what it holds, however long the log is. With ``keep``
    a hash is held only so long behind the watermark, and what comes later than that is left out and counted as
    duplicated; without it for ever. Records go to ``out``/records; ``audit_counters`` reads what was received and
    rejected from the stream's own observations, and the rest from the writes. ``entity``: name, urn.
    """
    spark = raw.sparkSession
    urns = access.unique_urns(entity)
    marked = access.marked_audit(raw).withColumn("record_hash", access.record_hash(engine))
    marked = marked.observe("audit", F.count(F.lit(1)).alias("received"), F.count("reason").alias("rejected"))
    ok = marked.filter("reason IS NULL").drop("reason")
    once = ok.withWatermark("event_time", keep).dropDuplicatesWithinWatermark(["record_hash"]) if keep else ok.dropDuplicates(["record_hash"])

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        new = batch.join(urns, "resource", "left")
        counts = [F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("urn").isNull()).alias("unresolved"), F.min("event_time").cast("string").alias("first_event"), F.max("event_time").cast("string").alias("last_event")]
        new.observe(seen, *counts).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        write_text(spark, f"{out}/accepted/{number:012d}.json", json.dumps({"batch": number, **seen.get}))

    stream = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return started(stream, spark, f"{out}/progress", **ROCKSDB, **UNCOUNTED)


def audit_counters(spark: SparkSession, out: str) -> DataFrame:
    """Counters of each micro-batch of ``ingest_audit_stream``: received, rejected, accepted, duplicated, unresolved, first_event, last_event (ST2)."""
    got = spark.read.schema("batch long, received long, rejected long, milliseconds long").json(f"{out}/progress")
    kept = spark.read.schema("batch long, accepted long, unresolved long, first_event string, last_event string").json(f"{out}/accepted")
    both = got.join(kept, "batch", "left").fillna(0, ["accepted", "unresolved"])
    times = [F.col(c).cast("timestamp").alias(c) for c in ("first_event", "last_event")]
    return both.select("batch", "received", "rejected", "accepted", (F.col("received") - F.col("rejected") - F.col("accepted")).alias("duplicated"), "unresolved", *times, "milliseconds")


def daily_metrics(events: DataFrame, time_col: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Row counts per key and day, events later than the watermark left out (ST4)."""
    day = F.window(F.col("__t"), "1 day")
    return events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late).groupBy(day, *keys).agg(F.count("*").alias("value_num")).select(*keys, F.col("window.start").alias("window_start"), "value_num")


STATE = "state string, severity string, notified double, resolved double, fires int"
ACTION = "dedup_key string, at timestamp, action string, severity string, fire_count int"
START = ("RESOLVED", "", 0.0, float("-inf"), 0)
_COLUMNS = ["dedup_key", "at", "action", "severity", "fire_count"]


def evaluations(signals: DataFrame, late: str | None = None) -> DataFrame:
    """One evaluation of a key for each second that has a signal: rows (dedup_key, at, firing, severity).

    It fires if any signal of the second does, with their worst severity. A key has so few rows then, however many signals
    it has, and they are counted where they are before any is sent. With ``late``, for streams, seconds come out once the
    watermark has passed them, so that an evaluation never comes after a later one; what comes later is left out.
    """
    own = signals.withColumn("at", F.col("at").cast("timestamp"))
    own = own.withWatermark("at", late) if late else own
    firing = F.coalesce("firing", F.lit(False))
    worst = F.max_by("severity", F.when(firing, severity_rank(F.col("severity"))).otherwise(-1))
    each = own.groupBy(F.window("at", "1 second"), "dedup_key").agg(F.max(firing).alias("firing"), worst.alias("severity"))
    return each.select("dedup_key", F.col("window.start").alias("at"), "firing", F.coalesce("severity", F.lit("")).alias("severity"), F.window_time("window").alias("event_time"))


def advance(key: str, state: tuple, rows: pd.DataFrame, remind: int, cooldown: int) -> tuple[tuple, pd.DataFrame]:
    """The state of a key after some evaluations, and the actions on the way."""
    now, severity, notified, resolved, fires = state
    out = []
    for r in rows.sort_values("at").itertuples():
        t, action = r.at.timestamp(), None
        if now == "FIRING" and r.firing:
            fires += 1
            if t - notified >= remind:
                notified, action = t, "REMINDED"
        elif now == "FIRING":
            now, resolved, action = "RESOLVED", t, "RESOLVED"
        elif r.firing and t - resolved < cooldown:
            action = "FLAP_SUPPRESSED"
        elif r.firing:
            now, severity, notified, fires, action = "FIRING", r.severity, t, 1, "FIRED"
        if action:
            out.append((key, r.at, action, severity, fires))
    return (now, severity, notified, resolved, fires), pd.DataFrame(out, columns=_COLUMNS)


class AlertProcessor(StatefulProcessor):
    """Holds an alert's state for each key, and a timer that drops it once a resolved key's cooldown is over."""

    def __init__(self, remind: int, cooldown: int):
        self.remind, self.cooldown = remind, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A row for each second at most.
        held = self.alert.get()
        new, actions = advance(key[0], held if held is not None else START, pd.concat(list(rows)), self.remind, self.cooldown)
        self.alert.update(new)
        if new[0] == "RESOLVED" and new[3] > 0:
            self.handle.registerTimer(int((new[3] + self.cooldown) * 1000) + 1)
        yield actions

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.alert.get()
        if held is not None and held[0] == "RESOLVED" and (held[3] + self.cooldown) * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.alert.clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def alert_actions(signals: DataFrame, remind: int = REMIND_SECONDS, cooldown: int = COOLDOWN_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Alert actions of a stream of signals (dedup_key, at, firing, severity), with the state of each key kept (ST3).

    A key fires once; each further evaluation counts, and one that is ``remind`` seconds or more after the last
    notification reminds; one that does not fire resolves it, and within ``cooldown`` seconds of that a new one is a
    suppressed flap. A resolved key's state is dropped by a timer once its cooldown is over. Keys with state need the
    RocksDB store: start the stream by ``started(..., **ROCKSDB)``.
    """
    keyed = evaluations(signals, late).groupBy("dedup_key")
    return keyed.transformWithStateInPandas(AlertProcessor(remind, cooldown), ACTION, "Append", "EventTime")


def alerts_batch(signals: DataFrame, remind: int = REMIND_SECONDS, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """The same actions over a whole table of signals."""
    return evaluations(signals).drop("event_time").groupBy("dedup_key").applyInPandas(lambda key, rows: advance(key[0], START, rows, remind, cooldown)[1], ACTION)


class ExpiryProcessor(StatefulProcessor):
    """Holds the status of a grant, and a timer that expires it when its time is up, whether or not anything comes for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grant = handle.getValueState("grant", "status string, expires long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r.at)
        # Timers have milliseconds.
        due = -(-last.micros // 1000)
        before = self.grant.get()
        if before is not None and before[0] == "ACTIVE":
            self.handle.deleteTimer(-(-before[1] // 1000))
        status = last.status
        if status == "ACTIVE" and due <= timerValues.getCurrentWatermarkInMs():
            status = "EXPIRED"
        elif status == "ACTIVE":
            self.handle.registerTimer(due)
        self.grant.update((status, last.micros))
        yield Row(id=key[0], status=status, micros=last.micros)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, expires = self.grant.get()
        if status == "ACTIVE":
            self.grant.update(("EXPIRED", expires))
            yield Row(id=key[0], status="EXPIRED", micros=expires)

    def close(self) -> None:
        pass


def grant_states(grants: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes of the status of grants in a stream of (id, status, expires_at, at): what comes, and EXPIRED when the stream's time passes expires_at (ST5).

    Time passes by the rows of any grant. Rows come out in the order of time for a grant. Needs the RocksDB store, as ``alert_actions``.
    """
    own = grants.select("id", "status", F.unix_micros(F.col("expires_at").cast("timestamp")).alias("micros"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    kind = grants.schema["id"].dataType.simpleString()
    found = own.groupBy("id").transformWithState(ExpiryProcessor(), f"id {kind}, status string, micros long", "Append", "EventTime")
    return found.select("id", "status", F.timestamp_micros("micros").alias("expires_at"))
