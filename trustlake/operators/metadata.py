"""Versioned facts: source-priority merge, versions, rollback, snapshots, guards, presence, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.functions.storage import written

# Priority of sources; the limits of the deletion guard.
PRIORITY = {"MANUAL": 40, "IMPORTED": 30, "AI_GENERATED": 20, "AUTO_COLLECTED": 10}
MAX_DELETIONS = 200
MAX_RATIO = 0.30
SMALL_BASELINE = 10
MIN_RETENTION = 0.70
FIELD = ["urn", "aspect_type", "field"]


def priority(source: Column) -> Column:
    out = F.lit(0)
    for k, v in PRIORITY.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def judge_writes(writes: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Each write with accepted and changed.

    A write wins if its source's priority is at least the field's so far. That priority is the running maximum, since a
    rejected write never raises it; so one window decides all fields at once.

    ``resets`` (urn, aspect_type, seq, field, value, source) holds what aspects were rolled back to, one row for each
    field: from that seq on, fields have these values and sources and those that are not among them none, and priorities
    run anew. Such rows are accepted and come out with a null tie.
    """
    own = writes.withColumn("p", priority(F.col("source"))).withColumn("segment", F.lit(0))
    if resets is not None:
        back = resets.select("seq", F.lit(None).cast(writes.schema["tie"].dataType).alias("tie"), "urn", "aspect_type", "field", "value", "source")
        every = own.drop("segment").unionByName(back.withColumn("p", priority(F.col("source"))), allowMissingColumns=True)
        marks = resets.select("urn", "aspect_type", F.col("seq").alias("at")).distinct()
        # An aspect is seldom rolled back, so it has few marks.
        begun = marks.groupBy("urn", "aspect_type").agg(F.sort_array(F.collect_list("at")).alias("marks"))
        own = every.join(begun, ["urn", "aspect_type"], "left").withColumn("segment", F.coalesce(F.size(F.filter("marks", lambda m: m <= F.col("seq"))), F.lit(0))).drop("marks")
        own = own.withColumn("segment", F.greatest("segment", F.lit(0)))
    key = [*FIELD, "segment"]
    order = Window.partitionBy(*key).orderBy("seq", F.asc_nulls_first("tie"))
    own = own.withColumn("accepted", F.col("p") == F.max("p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.last(F.when(F.col("accepted"), F.struct("value", "source")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", before)
    same = F.col("before").isNotNull() & F.col("value").eqNullSafe(F.col("before.value")) & (F.col("source") == F.col("before.source"))
    out = own.withColumn("changed", F.col("accepted") & ~F.coalesce(same, F.lit(False))).drop("p", "before")
    return out if resets is not None else out.drop("segment")


def merge_aspects(writes: DataFrame, resets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The current value and source of each field, and the writes that a stronger source held off."""
    judged = judge_writes(writes, resets)
    held = judged.filter("NOT accepted").select(*FIELD, "seq", "tie", "value", "source")
    if resets is not None:
        # Fields that the last roll-back took out and nobody wrote since are gone.
        last = judged.groupBy("urn", "aspect_type").agg(F.max("segment").alias("segment"))
        judged = judged.join(last, ["urn", "aspect_type", "segment"])
    current = latest_by(judged.filter("accepted"), FIELD, "seq", "tie").select(*FIELD, "value", "source")
    return current, held


def version_timeline(writes: DataFrame) -> DataFrame:
    """Changed fields with the aspect version that each write made.

    The fields that one write (a ``seq`` of an aspect) changes are one version; a write that changes nothing is none.
    """
    changed = judge_writes(writes).filter("changed")
    order = Window.partitionBy("urn", "aspect_type").orderBy("seq")
    return changed.select("urn", "aspect_type", F.dense_rank().over(order).alias("version"), "field", "value", "source", "seq", "tie")


def aspect_at(timeline: DataFrame, version: int) -> DataFrame:
    """Fields as they were at a version."""
    return latest_by(timeline.filter(F.col("version") <= version), FIELD, "version", "tie").select(*FIELD, "value", "source", "version")


def rollback(timeline: DataFrame, targets: DataFrame) -> DataFrame:
    """A new version on top of each target (urn, aspect_type, to_version) with that version's whole content."""
    own = timeline.join(targets, ["urn", "aspect_type"])
    top = own.groupBy("urn", "aspect_type").agg(F.max("version").alias("top"))
    held = latest_by(own.filter("version <= to_version"), FIELD, "version", "tie")
    return held.join(top, ["urn", "aspect_type"]).select(*FIELD, "value", "source", (F.col("top") + 1).alias("version"))


def rollback_run(versions: DataFrame, entity: DataFrame, edge_events: DataFrame, edge: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """What undoing a collection run changes.

    ``versions``: urn, aspect_type, version, content, run_id (null for what was not collected), all versions of each
    aspect. ``entity``: urn, run_id (that made it), lifecycle. ``edge_events``: edge_id, run_id. ``edge``: edge_id.

    restored: aspects whose current version is the run's get the content of the version before as a new version of no
    run. dropped: the run's aspects that have no version before. tombstoned: entities that the run made and that have
    no aspect left. deleted_edges: edges that an event of the run wrote.
    """
    mine = lambda c: F.col(c).eqNullSafe(run_id)
    keys = ["urn", "aspect_type"]
    current = latest_by(versions, keys, "version").select(*keys, "version", "run_id")
    hit = current.filter(mine("run_id")).select(*keys, F.col("version").alias("undone"))
    before = versions.join(hit, keys).filter(F.col("version") < F.col("undone"))
    restored = before.filter(F.col("version") == F.col("undone") - 1).select(*keys, (F.col("undone") + 1).alias("version"), "content", F.col("version").alias("restored_from"))
    dropped = hit.filter("undone = 1").join(before.select(*keys).distinct(), keys, "left_anti").select(*keys)
    left = current.select(*keys).join(dropped, keys, "left_anti").select("urn").distinct()
    alive = F.coalesce(F.col("lifecycle"), F.lit("ACTIVE")) != "TOMBSTONE"
    tombstoned = entity.filter(mine("run_id") & alive).select("urn").distinct().join(left, "urn", "left_anti")
    written = edge_events.filter(mine("run_id")).select("edge_id").distinct()
    return {"restored": restored, "dropped": dropped, "tombstoned": tombstoned, "deleted_edges": edge.select("edge_id").distinct().join(written, "edge_id", "left_semi")}


def version_diff(timeline: DataFrame, v1: int, v2: int) -> DataFrame:
    """Fields whose value differs between two versions."""
    a = aspect_at(timeline, v1).select(*FIELD, F.col("value").alias("old_value"))
    b = aspect_at(timeline, v2).select(*FIELD, F.col("value").alias("new_value"))
    return a.join(b, FIELD, "full_outer").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def verify_chain(audit: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of a hash chain (chain, seq, hash) whose hash is not sha256(previous hash and the fields)."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("chain").orderBy("seq")), F.lit(""))
    expected = F.sha2(F.concat_ws("|", before, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    return audit.withColumn("expected", expected).filter(~F.col("hash").eqNullSafe(F.col("expected")))


def snapshot_diff(prev: DataFrame, cur: DataFrame, scope: str = "source") -> DataFrame:
    """Rows (scope, urn, change): REMOVED and ADDED."""
    keys = [scope, "urn"]
    gone = prev.select(*keys).distinct().join(cur.select(*keys), keys, "left_anti").withColumn("change", F.lit("REMOVED"))
    return gone.unionByName(cur.select(*keys).distinct().join(prev.select(*keys), keys, "left_anti").withColumn("change", F.lit("ADDED")))


def guard(prev: DataFrame, cur: DataFrame, scope: str = "source", max_deletions: int = MAX_DELETIONS, max_ratio: float = MAX_RATIO, small: int = SMALL_BASELINE, min_retention: float = MIN_RETENTION) -> DataFrame:
    """Per scope: counts, and whether its deletions are blocked and why; without a baseline nothing is deleted (M1)."""
    keys = [scope, "urn"]
    both = prev.select(*keys).distinct().withColumn("p", F.lit(1)).join(cur.select(*keys).distinct().withColumn("c", F.lit(1)), keys, "full_outer")
    n = both.groupBy(scope).agg(F.count("p").alias("baseline"), F.count("c").alias("seen"), F.count_if(F.col("c").isNull()).alias("missing"))
    ratio = F.when(F.col("baseline") > 0, F.col("missing") / F.col("baseline")).otherwise(0.0)
    kept = F.when(F.col("baseline") > 0, F.col("seen") / F.col("baseline")).otherwise(1.0)
    reasons = F.array_compact(F.array(F.when(F.col("missing") > max_deletions, F.lit("too many deletions")), F.when((F.col("baseline") >= small) & (ratio > max_ratio), F.lit("too large a share")), F.when((F.col("baseline") >= small) & (kept < min_retention), F.lit("too few left"))))
    blocked = (F.col("baseline") > 0) & (F.size(reasons) > 0)
    return n.select(scope, "baseline", "seen", "missing", F.round(ratio, 4).alias("ratio"), blocked.alias("blocked"), F.when(F.col("baseline") > 0, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(blocked | (F.col("baseline") == 0), 0).otherwise(F.col("missing")).alias("deletions"))


def next_baseline(prev: DataFrame, cur: DataFrame, verdict: DataFrame, scope: str = "source") -> DataFrame:
    """The next run's baseline: the current snapshot, or the old one where the guard blocked (M1, M2)."""
    held = verdict.filter("blocked").select(scope)
    return prev.join(held, scope, "left_semi").select(scope, "urn").unionByName(cur.join(held, scope, "left_anti").select(scope, "urn")).distinct()


def collection_run(prev: DataFrame, cur: DataFrame, schemas: DataFrame, verdict: DataFrame, run_id: str, started_at: str, scope: str = "source") -> DataFrame:
    """One record per source of a collection run: SUCCEEDED or BLOCKED, what was seen, created, deleted, and schemas changed or not (M2).

    ``schemas``: scope, urn, before_hash, schema_hash (before_hash null for a new one). ``verdict``: as ``guard`` gives it.
    """
    keys = [scope, "urn"]
    fresh = cur.select(*keys).distinct().join(prev.select(*keys), keys, "left_anti").groupBy(scope).agg(F.count("*").alias("created"))
    same = F.col("before_hash").eqNullSafe(F.col("schema_hash"))
    kept = schemas.groupBy(scope).agg(F.count_if(same).alias("schemas_unchanged"), F.count_if(~same).alias("schemas_changed"))
    out = verdict.join(fresh, scope, "left").join(kept, scope, "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        F.lit(run_id).alias("run_id"), scope, F.lit(started_at).cast("timestamp_ntz").alias("started_at"), F.when(F.col("blocked"), "BLOCKED").otherwise("SUCCEEDED").alias("status"),
        "seen", number("created"), "deletions", number("schemas_unchanged"), number("schemas_changed"), "reasons",
    )


def apply_presence(entity: DataFrame, seen: DataFrame) -> DataFrame:
    """Lifecycle after a crawl: missing entities are DELETED_AT_SOURCE, seen ones ACTIVE, with the event of each change (M3)."""
    both = entity.join(seen.select("urn").distinct().withColumn("here", F.lit(True)), "urn", "full_outer")
    here, old = F.coalesce("here", F.lit(False)), F.col("lifecycle")
    event = F.when(old.isNull(), "CREATED").when(here & (old == "DELETED_AT_SOURCE"), "RESURRECTED").when(~here & (old == "ACTIVE"), "TOMBSTONED")
    state = F.when(here & (old.isNull() | (old == "DELETED_AT_SOURCE")), "ACTIVE").when(~here & (old == "ACTIVE"), "DELETED_AT_SOURCE").otherwise(old)
    return both.select("urn", state.alias("lifecycle"), event.alias("event"))


def orphans(entity: DataFrame, cur: DataFrame, prefix: str) -> DataFrame:
    """Entities of a platform that the current snapshot does not have (M4)."""
    return entity.filter(F.col("urn").startswith(prefix)).join(cur.select("urn"), "urn", "left_anti")


def collector_health(runs: DataFrame, as_of: str, stale_hours: int = 48, unhealthy: int = 3) -> DataFrame:
    """Failures in a row from the newest run, and HEALTHY, DEGRADED or UNHEALTHY."""
    newest = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run_id"))
    own = runs.withColumn("n", F.row_number().over(newest)).withColumn("bad", F.col("status").isin("FAILED", "BLOCKED"))
    g = own.groupBy("source").agg(F.min(F.when(~F.col("bad"), F.col("n"))).alias("first_good"), F.count("*").alias("runs"), F.max(F.when(F.col("status") == "SUCCEEDED", F.col("started_at"))).alias("last_success_at"))
    streak = F.coalesce(F.col("first_good") - 1, F.col("runs"))
    stale = F.coalesce(F.col("last_success_at").cast("timestamp") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {stale_hours} HOURS"), F.lit(True))
    return g.select("source", streak.alias("failure_streak"), "last_success_at", F.when(streak >= unhealthy, "UNHEALTHY").when((streak >= 1) | stale, "DEGRADED").otherwise("HEALTHY").alias("health"))


def upsert_metrics(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The latest row of each key over both tables."""
    return latest_by(old.unionByName(new), keys, seq)


# What tells two edges apart.
EDGE_KEY = ["from_urn", "to_urn", "edge_type", "source", "dependency_kind"]
_EDGE_FACTS = ["transform", "transform_expression", "cardinality", "parse_level"]


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by EDGE_KEY: the higher confidence, observations added up, of each fact the latest that is known, ACTIVE if seen again.

    So an edge from one source says nothing of that from another, nor a control edge of a value edge. Both tables: EDGE_KEY
    (a null dependency_kind is VALUE), confidence, observed_count, transform, transform_expression, cardinality,
    parse_level, state, first_seen, last_seen and seq, the order of what was seen.
    """
    return merged_edges(old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1))))


def merged_edges(both: DataFrame, dealt: bool = False) -> DataFrame:
    """``upsert_edges`` of one table of both, where ``is_new`` is 1 for what is new and else 0.

    Edges seldom repeat, so rows are dealt out once and sorted once, before any aggregate. A hash of the key leads the
    order: URNs begin alike, so comparing them for each step of a sort is slow. ``dealt`` says that rows have been dealt
    out by from_urn and to_urn, so that wide rows stay where they are.
    """
    whole = both.withColumn("dependency_kind", F.coalesce("dependency_kind", F.lit("VALUE"))).withColumn("__key", F.xxhash64(*EDGE_KEY))
    own = whole if dealt else whole.repartition("__key")
    order = F.struct("is_new", "seq")
    facts = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in _EDGE_FACTS]
    state = F.when(F.max("is_new") == 1, "ACTIVE").otherwise(F.max_by("state", "seq")).alias("state")
    return own.groupBy("__key", *EDGE_KEY).agg(F.max("confidence").alias("confidence"), F.sum("observed_count").alias("observed_count"), *facts, state, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).drop("__key")


def emit_events(df: DataFrame, batch_id: int, order: list[str], bits: int = 40) -> DataFrame:
    """Rows with a sequence number that grows with the batch and, in it, with the order.

    ``order`` tells rows apart. The number is the batch and the row's place in it. Rows are dealt out by ranges and
    written; the rows of each range are counted, and a place is what stands before the range and the place within it. It
    depends on the rows alone, not on where the ranges were cut, so a batch that is run again gets the same numbers.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "events")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    # One row for each partition.
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before") - 1
    return dealt.join(F.broadcast(before), "__range").withColumn("seq", F.lit(batch_id).cast("long") * F.lit(1 << bits) + place).drop("__range", "__before")


def schema_changes(versions: DataFrame) -> DataFrame:
    """Versions of (urn, version, schema_hash) whose hash differs from the one before."""
    before = F.lag("schema_hash").over(Window.partitionBy("urn").orderBy("version"))
    return versions.withColumn("before_hash", before).filter(F.col("before_hash").isNotNull() & (F.col("before_hash") != F.col("schema_hash")))
