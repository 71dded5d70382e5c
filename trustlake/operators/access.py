"""Engine audit logs, grants, requests and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.functions.storage import written

# Names that audit logs give the same field, the first that is there holds.
ALIASES = {
    "query_id": ["externalId", "external_id", "queryId", "query_id", "id", "requestId"],
    "event_time": ["eventTime", "event_time", "timestamp", "time", "queryTime", "eventTimeMillis", "createTime", "accessTime"],
    "actor": ["actor", "user", "reqUser", "requestUser", "principal", "accessedBy", "username"],
    "resource": ["resource", "resourceRaw", "resource_raw", "table", "tableName", "object", "resourceName", "target"],
    "operation": ["operation", "op", "access", "action", "queryType"],
    "columns": ["columns", "columnList", "accessedColumns"],
    "rows_scanned": ["rowsScanned", "rows_scanned", "rows", "inputRows", "processedRows"],
    "bytes_scanned": ["bytesScanned", "bytes_scanned", "bytes", "inputBytes", "processedBytes"],
    "succeeded": ["succeeded", "success", "result"],
    "source_ip": ["sourceIp", "source_ip", "clientIp", "remoteAddr", "ip"],
}
SUCCESS_WORDS, FAILURE_WORDS = ["success", "allowed", "true", "1"], ["failed", "denied", "false", "0"]
# Who decides, hours by granularity, days of grants and requests.
HIGH_LEVELS = ["L3", "L4"]
APPROVERS, HIGH_APPROVERS = ["STEWARD"], ["STEWARD", "ADMIN"]
SLA_HOURS = {"COLUMN": 72, "TABLE": 48}
SHORT_PURPOSE, LONG_DAYS = 4, 365
GRANT_DAYS, MOST_GRANT_DAYS = 90, 3650
STALE_REQUEST_DAYS, EXPIRING_DAYS = 30, 30
UNUSED_DAYS, JUDGE_DAYS, NEVER_REVIEWED_DAYS, EVIDENCE_DAYS = 90, 30, 180, 3650


def days_before(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def event_time(text: Column) -> Column:
    """A time from text: seconds or milliseconds since 1970, or ISO-8601; null if neither."""
    n = F.try_to_number(F.when(text.rlike(r"^\d{1,16}$"), text), F.lit("9" * 16)).cast("double")
    seconds = F.when(n < 1e11, n).otherwise(n / 1000)
    return F.coalesce(F.timestamp_millis((seconds * 1000).cast("long")), F.when(n.isNull(), text.try_cast("timestamp")))


def outcome(text: Column) -> Column:
    """Whether a status word says success; null if it is no such word."""
    return F.when(F.lower(text).isin(SUCCESS_WORDS), True).when(F.lower(text).isin(FAILURE_WORDS), False)


def marked_audit(df: DataFrame) -> DataFrame:
    """Audit rows under common names, with the reason where time, actor or resource is not there.

    A record counts as one that succeeded unless a status word says otherwise; ``asked`` is its operation as sent.
    """
    have = {f.name.lower(): f for f in df.schema.fields}

    def named(field: str) -> list[Column]:
        found = [have[n.lower()] for n in dict.fromkeys(ALIASES[field]) if n.lower() in have]
        lists = lambda f: f.dataType.typeName() == "array"
        return [F.nullif(F.trim((F.array_join(F.col(f"`{f.name}`"), ",") if lists(f) else F.col(f"`{f.name}`")).cast("string")), F.lit("")) for f in dict.fromkeys(found)]

    def first(field: str, read=lambda c: c, kind: str = "string") -> Column:
        found = [read(c) for c in named(field)]
        return F.coalesce(*found) if found else F.lit(None).cast(kind)

    own = df.select(
        first("query_id").alias("query_id"),
        event_time(first("event_time")).alias("event_time"),
        first("actor").alias("actor"),
        first("resource").alias("resource"),
        F.upper(F.coalesce(first("operation"), F.lit("SELECT"))).alias("operation"),
        first("operation").alias("asked"),
        F.coalesce(F.filter(F.transform(F.split(first("columns"), ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>")).alias("columns"),
        F.coalesce(first("succeeded", outcome, "boolean"), F.lit(True)).alias("succeeded"),
        first("rows_scanned", lambda c: c.try_cast("long"), "long").alias("rows_scanned"),
        first("bytes_scanned", lambda c: c.try_cast("long"), "long").alias("bytes_scanned"),
        first("source_ip").alias("source_ip"),
    )
    why = F.when(F.col("event_time").isNull(), "no time").when(F.col("actor").isNull(), "no actor").when(F.col("resource").isNull(), "no resource")
    return own.withColumn("reason", why)


def normalize_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit rows under common names, and those without time, actor or resource with the reason."""
    own = marked_audit(df)
    return own.filter("reason IS NULL").drop("reason"), own.filter("reason IS NOT NULL")


def record_hash(engine: str) -> Column:
    """The identity of an audit record: its query id, or time, actor, resource, operation as sent and columns."""
    own = F.concat_ws("|", F.col("event_time").cast("string"), "actor", "resource", F.coalesce("asked", F.lit("")), F.array_join("columns", ","))
    return F.sha2(F.concat_ws("|", F.lit(engine), F.coalesce(F.col("query_id"), own)), 256)


def unique_urns(entity: DataFrame) -> DataFrame:
    """Rows (resource, urn) of the names that exactly one URN has. ``entity``: name, urn."""
    return entity.groupBy("name").agg(F.min("urn").alias("urn"), F.count_distinct("urn").alias("n")).filter("n = 1").select(F.col("name").alias("resource"), "urn")


def ingest_audit(raw: DataFrame, entity: DataFrame, existing: DataFrame, engine: str) -> tuple[DataFrame, DataFrame]:
    """New audit rows with their URN where the resource has exactly one, and the batch's counters.

    The log is read and parsed once, into a written table; new rows are written too, and counters are sums over the two.
    ``entity``: name, urn. ``existing``: record_hash. Rows that cannot be resolved are kept with a null URN.
    """
    marked = written(marked_audit(raw).withColumn("record_hash", F.when(F.col("reason").isNull(), record_hash(engine))), "audit")
    ok = marked.filter("reason IS NULL").drop("reason")
    new = written(ok.join(existing.select("record_hash"), "record_hash", "left_anti").dropDuplicates(["record_hash"]).join(unique_urns(entity), "resource", "left"), "new-audit")
    received = marked.agg(F.count("*").alias("received"), F.count("reason").alias("rejected"))
    accepted = new.agg(F.count("*").alias("accepted"), F.count_if(F.col("urn").isNull()).alias("unresolved"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))
    # Both sides are one row.
    return new, received.crossJoin(accepted).withColumn("duplicated", F.col("received") - F.col("rejected") - F.col("accepted"))


def admit_batches(df: DataFrame, batch_col: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """Batches of at most ``cap`` rows; larger ones are refused whole and reported, never cut."""
    report = df.groupBy(batch_col).agg(F.count("*").alias("received")).withColumn("admitted", F.col("received") <= cap)
    return df.join(report.filter("admitted").select(batch_col), batch_col, "left_semi"), report


def audit_coverage(audit: DataFrame) -> DataFrame:
    """Per operation: rows, resolved rows, distinct actors and the window."""
    return audit.groupBy("operation").agg(F.count("*").alias("records"), F.count_if(F.col("urn").isNotNull()).alias("resolved"), F.count_distinct("actor").alias("actors"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))


def records(audit: DataFrame, as_of: str, resource: str | None = None, actor: str | None = None, days: int | None = None, limit: int = 100) -> DataFrame:
    """The newest records under the filters that are set; the limit is kept within 1 and 1000."""
    for cond in (
        None if resource is None else F.col("resource") == resource,
        None if actor is None else F.col("actor") == actor,
        None if days is None else F.col("event_time") >= days_before(as_of, days),
    ):
        audit = audit if cond is None else audit.filter(cond)
    return audit.orderBy(F.desc_nulls_last("event_time"), "record_hash").limit(min(max(limit, 1), 1000))


def usage_evidence(audit: DataFrame, grant: DataFrame, as_of: str, days: int) -> DataFrame:
    """Each grant with its uses in the window: count, last, rows and operations (A10)."""
    own = audit.filter(F.col("event_time") >= days_before(as_of, days)).groupBy(F.col("actor").alias("subject"), F.col("resource").alias("resource_urn"))
    used = own.agg(F.count("*").alias("uses"), F.max("event_time").alias("last_use"), F.sum("rows_scanned").alias("rows_scanned"), F.count_distinct("operation").alias("operations"))
    out = grant.join(used, ["subject", "resource_urn"], "left")
    return out.withColumn("uses", F.coalesce("uses", F.lit(0)))


def unapproved_access(audit: DataFrame, grant: DataFrame, as_of: str, days: int) -> DataFrame:
    """(actor, resource) used without an active grant on it, or a DATASET grant on a prefix that ends at a dot.

    A resource is exploded into its dotted prefixes, so that the test is an equi anti join.
    """
    live = grant.filter("status = 'ACTIVE'").select(F.col("subject").alias("actor"), F.col("resource_urn").alias("covers"), (F.col("granularity") == "DATASET").alias("whole"))
    used = audit.filter(F.col("event_time") >= days_before(as_of, days)).groupBy("actor", "resource").agg(F.count("*").alias("uses"), F.max("event_time").alias("last_use"))
    parts = F.split("resource", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    each = used.select("actor", "resource", F.explode(prefixes).alias("covers"))
    ok = each.join(live, ["actor", "covers"]).filter((F.col("covers") == F.col("resource")) | F.col("whole")).select("actor", "resource").distinct()
    return used.join(ok, ["actor", "resource"], "left_anti")


def expire(grants: DataFrame, as_of: str) -> DataFrame:
    """Grants with EXPIRED where the time is up, and whether that is new."""
    over = (F.col("status") == "ACTIVE") & (F.col("expires_at").cast("timestamp") < F.lit(as_of).cast("timestamp"))
    return grants.withColumn("expired_now", over).withColumn("status", F.when(over, "EXPIRED").otherwise(F.col("status")))


def expire_requests(requests: DataFrame, as_of: str) -> DataFrame:
    """Requests with EXPIRED where nobody has decided 30 days after they were due, and whether that is new.

    ``requests``: status (SUBMITTED, IN_REVIEW, ...), sla_due_at.
    """
    over = F.col("status").isin("SUBMITTED", "IN_REVIEW") & (F.col("sla_due_at").cast("timestamp") < days_before(as_of, STALE_REQUEST_DAYS))
    return requests.withColumn("expired_now", F.coalesce(over, F.lit(False))).withColumn("status", F.when(over, "EXPIRED").otherwise(F.col("status")))


def route_requests(requests: DataFrame, as_of: str) -> DataFrame:
    """Who decides by level, the hours allowed, when it is due and whether that is past, what to ask for, and notes.

    ``requests``: request_id, classification (L2 where it is null or blank), granularity, purpose, duration_days,
    requested_at, requester.
    """
    level = F.coalesce(F.upper(F.nullif(F.trim("classification"), F.lit(""))), F.lit("L2"))
    high = level.isin(HIGH_LEVELS)
    roles = lambda names: F.array(*map(F.lit, names))
    by_column = F.coalesce(F.upper("granularity") == "COLUMN", F.lit(False))
    hours = F.when(by_column, SLA_HOURS["COLUMN"]).otherwise(SLA_HOURS["TABLE"])
    due = F.col("requested_at").cast("timestamp") + F.make_dt_interval(hours=hours)
    notes = F.array_compact(
        F.array(
            F.concat(F.lit("level "), level, F.when(high, F.lit(": a steward signs too")).otherwise(F.lit(": a steward or the owner decides"))),
            F.when(by_column, F.lit("columns: 72 hours")).otherwise(F.lit("whole table: 48 hours")),
            F.when(F.length(F.trim(F.coalesce("purpose", F.lit("")))) < SHORT_PURPOSE, F.lit("purpose too short")),
            F.when(F.col("duration_days") > LONG_DAYS, F.concat(F.lit("asked for "), F.col("duration_days"), F.lit(" days: a role fits better"))),
            F.concat(F.nullif(F.trim("requester"), F.lit("")), F.lit(" does not decide on this")),
        )
    )
    return requests.select(
        "request_id", F.when(high, roles(HIGH_APPROVERS)).otherwise(roles(APPROVERS)).alias("approvers"), hours.alias("sla_hours"), due.alias("sla_due_at"), (due < F.lit(as_of).cast("timestamp")).alias("overdue"),
        F.when(by_column, "as asked").otherwise("ask for columns").alias("suggestion"), notes.alias("notes"),
    )


def grant_end(approved_at: Column, duration_days: Column) -> Column:
    """When a grant ends: the days asked for, 90 where none are, 3650 at most."""
    days = F.when(F.coalesce(duration_days, F.lit(0)) <= 0, GRANT_DAYS).otherwise(F.least(duration_days, F.lit(MOST_GRANT_DAYS)))
    return approved_at.cast("timestamp") + F.make_dt_interval(days=days)


def check_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with what is wrong with them: nobody named, own request, role outside the chain, rejection without a reason.

    ``decisions``: request_id, requester, approvers, decider, decider_roles array<string>, decision, reason. An ADMIN may
    decide on all requests but their own.
    """
    unnamed = F.coalesce(F.trim("decider"), F.lit("")) == ""
    may = F.coalesce(F.array_contains("decider_roles", "ADMIN") | F.arrays_overlap("decider_roles", "approvers"), F.lit(False))
    wrong = F.array_compact(
        F.array(
            F.when(unnamed, F.lit("nobody named")),
            F.when(~unnamed & (F.lower("decider") == F.lower("requester")), F.lit("own request")),
            F.when(~unnamed & ~may, F.lit("not in the chain")),
            F.when((F.col("decision") == "REJECT") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), F.lit("no reason")),
        )
    )
    return decisions.select("request_id", "decider", "decision", wrong.alias("problems"), (F.size(wrong) == 0).alias("legal"))


def observation_window(audit: DataFrame) -> DataFrame:
    """First and last event and count over all records."""
    return audit.agg(F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), F.count("*").alias("records"))


def grant_evidence(grants: DataFrame, audit: DataFrame, as_of: str) -> DataFrame:
    """Grants with their uses in ten years, age in whole days, and whether the log is there and covers their whole life."""
    now = F.lit(as_of).cast("timestamp")
    # One row, so its broadcast is bounded.
    start = F.broadcast(audit.agg(F.min("event_time").alias("log_start")))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("granted_at").cast("timestamp"))) / 86400)
    out = usage_evidence(audit, grants, as_of, EVIDENCE_DAYS).crossJoin(start).withColumn("age_days", age)
    return out.withColumn("logged", F.col("log_start").isNotNull()).withColumn("covered", F.coalesce(F.col("log_start") <= F.col("granted_at").cast("timestamp"), F.lit(False)))


def least_privilege(grants: DataFrame, audit: DataFrame, as_of: str, reviewed: DataFrame | None = None) -> DataFrame:
    """Each active grant as IN_USE, REVOKE_CANDIDATE or INSUFFICIENT_EVIDENCE, and whether it is wide (P5).

    Without use, a grant of 30 days or more is a candidate if the log covers its life, or if it is 180 days old and was
    never reviewed. Wide is a whole dataset, held for 30 days or more and not used. ``reviewed``: id.
    """
    live = grant_evidence(grants.filter("status = 'ACTIVE'"), audit, as_of)
    seen = reviewed.select("id").distinct().withColumn("was_reviewed", F.lit(True)) if reviewed is not None else None
    j = live.join(seen, "id", "left") if seen is not None else live.withColumn("was_reviewed", F.lit(None).cast("boolean"))
    used, old = F.col("uses") > 0, F.col("age_days") >= JUDGE_DAYS
    forgotten = F.col("was_reviewed").isNull() & (F.col("age_days") >= NEVER_REVIEWED_DAYS)
    verdict = F.when(used, "IN_USE").when(F.col("logged") & old & (F.col("covered") | forgotten), "REVOKE_CANDIDATE").otherwise("INSUFFICIENT_EVIDENCE")
    wide = (F.col("granularity") == "DATASET") & old & ~used
    return j.select("id", "subject", "resource_urn", "uses", "last_use", verdict.alias("verdict"), wide.alias("wide"))


def review_campaign(grants: DataFrame, reviews: DataFrame, audit: DataFrame, campaign: str, as_of: str) -> DataFrame:
    """Active grants that a campaign has not reviewed, with KEEP, REVOKE or NEED_MORE_INFO.

    Only a log that covers the grant's whole life, and a grant of 30 days or more, can be judged; then 90 days without
    use call for REVOKE.
    """
    done = reviews.filter(F.col("campaign") == campaign).select("id").distinct()
    j = grant_evidence(grants.filter("status = 'ACTIVE'").join(done, "id", "left_anti"), audit, as_of)
    judged = F.col("covered") & (F.col("age_days") >= JUDGE_DAYS)
    unused = (F.col("uses") == 0) & (F.col("age_days") >= UNUSED_DAYS)
    return j.select("id", "subject", "resource_urn", "uses", F.when(~judged, "NEED_MORE_INFO").when(unused, "REVOKE").otherwise("KEEP").alias("proposal"))


def access_report(grants: DataFrame, as_of: str, soon_days: int = EXPIRING_DAYS) -> DataFrame:
    """Grants by status and granularity, with the active ones that end within the days given or have ended."""
    soon = (F.col("status") == "ACTIVE") & (F.col("expires_at").cast("timestamp") < F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {soon_days} DAYS"))
    return grants.groupBy("status", "granularity").agg(F.count("*").alias("grants"), F.count_distinct("subject").alias("subjects"), F.count_if(soon).alias("expiring"))


def request_funnel(requests: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Requests of the last days by status: how many, and mean and longest hours to the decision.

    ``requests``: status, created_at, decided_at.
    """
    own = requests.filter(F.col("created_at").cast("timestamp") > days_before(as_of, days if days > 0 else 90))
    hours = (F.unix_timestamp(F.col("decided_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600
    return own.groupBy("status").agg(F.count("*").alias("requests"), F.count("decided_at").alias("decided"), F.round(F.avg(hours), 2).alias("mean_hours"), F.round(F.max(hours), 2).alias("longest_hours"))


def grants_by_level(grants: DataFrame, requests: DataFrame) -> DataFrame:
    """Grants by the level of the request they come from, L2 where there is none (P7). ``grants``: request_id. ``requests``: request_id, classification."""
    own = grants.select("request_id").join(requests.select("request_id", "classification"), "request_id", "left")
    return own.groupBy(F.coalesce("classification", F.lit("L2")).alias("classification")).agg(F.count("*").alias("grants"))


def decision_latency(requests: DataFrame) -> DataFrame:
    """Mean and longest hours from request to decision, by outcome."""
    hours = (F.unix_timestamp(F.col("decided_at").cast("timestamp")) - F.unix_timestamp(F.col("requested_at").cast("timestamp"))) / 3600
    return requests.filter("decided_at IS NOT NULL").groupBy("outcome").agg(F.count("*").alias("requests"), F.round(F.avg(hours), 3).alias("mean_hours"), F.round(F.max(hours), 3).alias("longest_hours"))


def dedup_occurrences(df: DataFrame, keys: list[str], time_col: str, weight: Column | None = None) -> DataFrame:
    """One row per content hash: occurrences, first and last seen."""
    h = F.sha2(F.to_json(F.struct(*keys)), 256)
    return df.groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).alias("occurrences"), F.min(time_col).alias("first_seen"), F.max(time_col).alias("last_seen")).withColumn("content_hash", h)


def ranked_top(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).filter(F.col("rank") <= k)
