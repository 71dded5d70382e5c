"""Policies, audit logs, grants and reviews over derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlake.operators import access, policy
from trustlake.plans.fixtures import AS_OF, load, with_views
from trustlake.plans.registry import query


@query(with_views("SELECT urn, classification FROM asset WHERE coalesce(classification, 'L2') IN ('L1', 'L2', 'L3')", "asset"))
def f1_visible(spark, sf_dir):
    return policy.visible(load(spark, sf_dir, "asset"), ["READER"]).select("urn", "classification")


_POLICIES = [
    {"id": "p1", "kind": "row_filter", "column": "c_mktsegment", "operator": "IN", "value": ["BUILDING", "MACHINERY"], "roles": ["ANALYST"], "priority": 5},
    {"id": "p2", "kind": "row_filter", "column": "c_acctbal", "operator": ">", "value": 0.0, "users": ["ann"]},
    {"id": "p3", "kind": "mask", "column": "c_name", "mask": "partial", "roles": ["ANALYST"], "priority": 3},
    {"id": "p4", "kind": "mask", "column": "c_name", "mask": "hash", "priority": 1},
    {"id": "p5", "kind": "mask", "column": "c_mktsegment", "mask": "hash", "teams": ["risk"]},
    {"id": "p6", "kind": "mask", "column": "c_nationkey", "mask": "null"},
    {"id": "p7", "kind": "deny", "roles": ["GUEST"]},
]


@query("SELECT c_custkey, substr(c_name, 1, 2) || '****' AS c_name, NULL::INTEGER AS c_nationkey, c_acctbal, upper(sha256(c_mktsegment)) AS c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def f4_policies(spark, sf_dir):
    return policy.apply_policies(load(spark, sf_dir, "customer"), _POLICIES, {"user": "ann", "roles": ["ANALYST"], "teams": ["risk"]})


@query("SELECT o_orderkey, '***' AS o_orderstatus, date_trunc('year', o_orderdate)::TIMESTAMP AS o_orderdate FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice <= 150000")
def f3_masks(spark, sf_dir):
    own = [
        {"id": "a", "kind": "row_filter", "column": "o_orderpriority", "operator": "!=", "value": "5-LOW"},
        {"id": "b", "kind": "row_filter", "column": "o_totalprice", "operator": "<=", "value": 150000.0},
        {"id": "c", "kind": "mask", "column": "o_orderstatus", "mask": "constant"},
        {"id": "d", "kind": "mask", "column": "o_orderdate", "mask": "year"},
    ]
    return policy.apply_policies(load(spark, sf_dir, "orders"), own, {"user": "x"}).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007'")
def f2_current_user(spark, sf_dir):
    own = {"column": "c_name", "operator": "CURRENT_USER"}
    return load(spark, sf_dir, "customer").filter(policy.row_filter(own, "Customer#000000007")).select("c_custkey")


_SELECTORS = [
    ("a", ["prod.Brand#1", "prod.Brand#2"], None, None, None),
    ("b", None, None, ["l4"], None),
    ("c", ["prod.BUILDING", "prod.MACH"], None, ["L2"], ["building", "none"]),
    ("d", None, "part_5", None, None),
    ("e", None, "x.part_7", ["L2", "L3"], []),
    ("f", [], None, None, ["Supply"]),
]
_COVERED = """d AS (SELECT DISTINCT 'prod.' || platform || '.' || replace(urn, ':', '_') AS urn, classification, coalesce(classification, 'L2') AS level, platform AS domain FROM asset),
p AS (SELECT urn, classification, CAST(urn LIKE 'prod.Brand#1%' OR urn LIKE 'prod.Brand#2%' AS BIGINT) + CAST(level = 'L4' AS BIGINT) + CAST(domain = 'BUILDING' AND level = 'L2' AS BIGINT) + CAST(urn LIKE '%.part!_7' ESCAPE '!' AND level IN ('L2', 'L3') AS BIGINT) + CAST(domain = 'supply' AS BIGINT) AS policies FROM d)"""


@query(with_views(f"{_COVERED} SELECT urn, classification, policies, policies > 0 AS covered FROM p", "asset"))
def p1_policy_coverage(spark, sf_dir):
    policies = spark.createDataFrame(_SELECTORS, "policy_id string, prefixes array<string>, table_name string, classifications array<string>, domains array<string>")
    urn = F.concat_ws(".", F.lit("prod"), "platform", F.replace("urn", F.lit(":"), F.lit("_")))
    assets = load(spark, sf_dir, "asset").select(urn.alias("urn"), "classification", F.col("platform").alias("domain")).distinct()
    return policy.policy_coverage(assets, policies)


@query(with_views(f"{_COVERED} SELECT classification, count(*) AS assets, count(*) FILTER (policies > 0) AS covered, round(count(*) FILTER (policies > 0) / count(*), 4) AS ratio FROM p GROUP BY 1", "asset"))
def p1_coverage_summary(spark, sf_dir):
    return policy.coverage_summary(p1_policy_coverage(spark, sf_dir))


_NORMAL = """n AS (SELECT nullif(trim(query_id), '') AS query_id, event_time, nullif(trim(actor), '') AS actor, nullif(trim(resource_raw), '') AS resource, upper(coalesce(nullif(trim(operation), ''), 'SELECT')) AS operation, coalesce(trim(operation), '') AS asked, rows_scanned FROM engine_audit_raw),
ok AS (SELECT *, sha256('eng|' || coalesce(query_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(event_time) % 1000000 = 0 THEN '' ELSE rtrim(strftime(event_time, '.%f'), '0') END || '|' || actor || '|' || resource || '|' || asked || '|')) AS record_hash FROM n WHERE event_time IS NOT NULL AND actor IS NOT NULL AND resource IS NOT NULL)"""


@query(with_views(f"{_NORMAL} SELECT query_id, event_time, actor, resource, operation, rows_scanned FROM ok", "engine_audit_raw"))
def f6_normalize_audit(spark, sf_dir):
    ok = access.normalize_audit(load(spark, sf_dir, "engine_audit_raw"))[0]
    return ok.select("query_id", "event_time", "actor", "resource", "operation", "rows_scanned")


_SENT = """SELECT CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING) AS createTime, 'u' || CAST(user_id AS STRING) AS reqUser, CASE WHEN event_id % 11 <> 0 THEN 'app.' || event_type END AS tableName, CASE WHEN event_id % 3 <> 0 THEN event_type END AS queryType, CASE WHEN event_id % 2 = 0 THEN 'r' || CAST(event_id AS STRING) END AS requestId,
CASE event_id % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'DENIED' WHEN 2 THEN 'failed' WHEN 3 THEN 'Allowed' WHEN 4 THEN 'odd' END AS result, CAST(event_id * 10 AS STRING) AS processedBytes, '10.0.0.' || CAST(event_id % 9 AS STRING) AS clientIp, CASE WHEN event_id % 4 = 0 THEN 'a, b,' END AS accessedColumns FROM events"""


@query("""
SELECT CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS query_id, date_trunc('milliseconds', ts) AS event_time, 'u' || user_id AS actor, 'app.' || event_type AS resource, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) ELSE 'SELECT' END AS operation, CASE WHEN event_id % 4 = 0 THEN ['a', 'b'] ELSE [] END AS columns,
event_id % 6 NOT IN (1, 2) AS succeeded, NULL::BIGINT AS rows_scanned, event_id * 10 AS bytes_scanned, '10.0.0.' || (event_id % 9) AS source_ip FROM events WHERE event_id % 11 <> 0""")
def f6_engine_fields(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return access.normalize_audit(spark.sql(_SENT))[0].withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).drop("asked")


@query(with_views(f"{_NORMAL} SELECT CASE WHEN event_time IS NULL THEN 'no time' WHEN actor IS NULL THEN 'no actor' ELSE 'no resource' END AS reason, count(*) AS n FROM n WHERE event_time IS NULL OR actor IS NULL OR resource IS NULL GROUP BY 1", "engine_audit_raw"))
def f6_rejected_audit(spark, sf_dir):
    return access.normalize_audit(load(spark, sf_dir, "engine_audit_raw"))[1].groupBy("reason").agg(F.count("*").alias("n"))


def _audit(spark, sf_dir):
    """The whole raw log, ingested; record hashes that end in 0 are there already."""
    raw = load(spark, sf_dir, "engine_audit_raw")
    entity = load(spark, sf_dir, "events").select(F.concat(F.lit("app."), F.col("event_type")).alias("name"), F.concat(F.lit("urn:asset:Dataset:prod.app."), F.col("event_type")).alias("urn")).distinct()
    held = access.normalize_audit(raw)[0].select(access.record_hash("eng").alias("record_hash")).filter("record_hash LIKE '%0'")
    return access.ingest_audit(raw, entity, held, "eng")


_INGESTED = f"""{_NORMAL}, au AS (SELECT record_hash, any_value(resource) AS resource, any_value(actor) AS actor, any_value(event_time) AS event_time, any_value(operation) AS operation, any_value(rows_scanned) AS rows_scanned FROM ok WHERE record_hash NOT LIKE '%0' GROUP BY 1),
a AS (SELECT *, CASE WHEN resource LIKE 'app.%' THEN 'urn:asset:Dataset:prod.' || resource END AS urn FROM au)"""


@query(with_views(f"{_INGESTED} SELECT record_hash, resource, actor, event_time, operation, urn FROM a", "engine_audit_raw"))
def p8_ingest_audit(spark, sf_dir):
    return _audit(spark, sf_dir)[0].select("record_hash", "resource", "actor", "event_time", "operation", "urn")


@query(with_views(f"{_INGESTED}, c AS (SELECT (SELECT count(*) FROM engine_audit_raw) AS received, (SELECT count(*) FROM engine_audit_raw) - (SELECT count(*) FROM ok) AS rejected, count(*) AS accepted, count(*) FILTER (urn IS NULL) AS unresolved, min(event_time) AS first_event, max(event_time) AS last_event FROM a) SELECT *, received - rejected - accepted AS duplicated FROM c", "engine_audit_raw"))
def a9_ingest_report(spark, sf_dir):
    return _audit(spark, sf_dir)[1]


@query(with_views(f"{_INGESTED} SELECT operation, count(*) AS records, count(urn) AS resolved, count(DISTINCT actor) AS actors, min(event_time) AS first_event, max(event_time) AS last_event FROM a GROUP BY 1", "engine_audit_raw"))
def a8_audit_coverage(spark, sf_dir):
    return access.audit_coverage(_audit(spark, sf_dir)[0])


@query(with_views(f"{_INGESTED} SELECT record_hash, actor, resource, event_time FROM a WHERE resource = 'app.click' AND event_time >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY ORDER BY event_time DESC, record_hash LIMIT 20", "engine_audit_raw"))
def f5_records(spark, sf_dir):
    return access.records(_audit(spark, sf_dir)[0], AS_OF, resource="app.click", days=10, limit=20).select("record_hash", "actor", "resource", "event_time")


@query(with_views(f"{_INGESTED} SELECT min(event_time) AS first_event, max(event_time) AS last_event, count(*) AS records FROM a", "engine_audit_raw"))
def p9_observation_window(spark, sf_dir):
    return access.observation_window(_audit(spark, sf_dir)[0])


_USED = "use AS (SELECT actor AS subject, resource AS resource_urn, count(*) AS uses, max(event_time) AS last_use, CAST(sum(rows_scanned) AS BIGINT) AS rows_scanned, count(DISTINCT operation) AS operations FROM ok WHERE event_time >= TIMESTAMP '2024-01-31' - INTERVAL {} DAY GROUP BY 1, 2)"


def _ok(spark, sf_dir):
    return access.normalize_audit(load(spark, sf_dir, "engine_audit_raw"))[0]


@query(with_views(f"{_NORMAL}, {_USED.format(20)} SELECT id, subject, resource_urn, coalesce(uses, 0) AS uses, last_use, rows_scanned, operations FROM access_grant LEFT JOIN use USING (subject, resource_urn)", "engine_audit_raw", "access_grant"))
def a10_usage_evidence(spark, sf_dir):
    return access.usage_evidence(_ok(spark, sf_dir), load(spark, sf_dir, "access_grant"), AS_OF, 20).select("id", "subject", "resource_urn", "uses", "last_use", "rows_scanned", "operations")


@query(
    with_views(
        f"{_NORMAL}, u AS (SELECT actor, resource, count(*) AS uses, max(event_time) AS last_use FROM ok WHERE event_time >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1, 2) SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM access_grant g WHERE g.status = 'ACTIVE' AND g.subject = u.actor AND (g.resource_urn = u.resource OR (g.granularity = 'DATASET' AND starts_with(u.resource, g.resource_urn || '.'))))",
        "engine_audit_raw",
        "access_grant",
    )
)
def j4_unapproved_access(spark, sf_dir):
    return access.unapproved_access(_ok(spark, sf_dir), load(spark, sf_dir, "access_grant"), AS_OF, 30)


@query(with_views("SELECT id, CASE WHEN status = 'ACTIVE' AND expires_at < TIMESTAMP '2024-04-15' THEN 'EXPIRED' ELSE status END AS status, status = 'ACTIVE' AND expires_at < TIMESTAMP '2024-04-15' AS expired_now FROM access_grant", "access_grant"))
def p2_expire_grants(spark, sf_dir):
    return access.expire(load(spark, sf_dir, "access_grant"), "2024-04-15 00:00:00").select("id", "status", "expired_now")


_ASKED = "SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'O' THEN 'SUBMITTED' WHEN 'F' THEN 'APPROVED' ELSE 'IN_REVIEW' END AS status, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS sla_due_at FROM orders"


@query(f"WITH q AS ({_ASKED}), x AS (SELECT *, coalesce(status IN ('SUBMITTED', 'IN_REVIEW') AND sla_due_at < TIMESTAMP '1998-06-01' - INTERVAL 30 DAY, false) AS expired_now FROM q) SELECT request_id, CASE WHEN expired_now THEN 'EXPIRED' ELSE status END AS status, expired_now FROM x")
def p2_expire_requests(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return access.expire_requests(spark.sql(_ASKED), "1998-06-01 00:00:00").select("request_id", "status", "expired_now")


_REQUEST = "SELECT p_partkey AS request_id, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'l3' WHEN 4 THEN 'L4' ELSE ' ' END AS classification, CASE WHEN p_partkey % 3 = 0 THEN 'column' ELSE 'TABLE' END AS granularity, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ab ' ELSE p_name END AS purpose, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 20 END AS duration_days, TIMESTAMP '2024-01-31 00:00:00' - (INTERVAL 1 HOUR) * (p_partkey % 100) AS requested_at, CASE WHEN p_partkey % 8 <> 0 THEN 'u' || CAST(p_partkey % 9 AS STRING) END AS requester FROM part"


def _routed(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_REQUEST)


_ROUTED = f"""q AS ({_REQUEST}), l AS (SELECT *, upper(coalesce(nullif(trim(classification), ''), 'L2')) AS lv, granularity = 'column' AS fine FROM q), h AS (SELECT *, lv IN ('L3', 'L4') AS high, CASE WHEN fine THEN 72 ELSE 48 END AS sla_hours FROM l),
ro AS (SELECT request_id, requester, CASE WHEN high THEN ['STEWARD', 'ADMIN'] ELSE ['STEWARD'] END AS approvers, sla_hours, requested_at + INTERVAL 1 HOUR * sla_hours AS sla_due_at, requested_at + INTERVAL 1 HOUR * sla_hours < TIMESTAMP '2024-01-31' AS overdue, CASE WHEN fine THEN 'as asked' ELSE 'ask for columns' END AS suggestion,
list_filter(['level ' || lv || CASE WHEN high THEN ': a steward signs too' ELSE ': a steward or the owner decides' END, CASE WHEN fine THEN 'columns: 72 hours' ELSE 'whole table: 48 hours' END, CASE WHEN length(trim(coalesce(purpose, ''))) < 4 THEN 'purpose too short' END, CASE WHEN duration_days > 365 THEN 'asked for ' || duration_days || ' days: a role fits better' END, requester || ' does not decide on this'], lambda x: x IS NOT NULL) AS notes FROM h)"""


@query(f"WITH {_ROUTED} SELECT request_id, approvers, sla_hours, sla_due_at, overdue, suggestion, notes FROM ro")
def p3_route_requests(spark, sf_dir):
    return access.route_requests(_routed(spark, sf_dir), AS_OF)


@query(f"""
WITH {_ROUTED}, d AS (SELECT request_id, requester, approvers, CASE request_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'U' || (request_id % 7) END AS decider, CASE request_id % 4 WHEN 0 THEN ['OWNER', 'STEWARD'] WHEN 1 THEN ['ADMIN'] WHEN 2 THEN ['READER'] END AS roles, CASE WHEN request_id % 2 = 0 THEN 'REJECT' ELSE 'APPROVE' END AS decision, CASE WHEN request_id % 4 = 0 THEN ' ' ELSE 'r' END AS reason FROM ro),
n AS (SELECT *, coalesce(trim(decider), '') = '' AS unnamed, coalesce(list_contains(roles, 'ADMIN') OR list_contains(roles, 'STEWARD'), false) AS may FROM d),
w AS (SELECT *, list_filter([CASE WHEN unnamed THEN 'nobody named' END, CASE WHEN NOT unnamed AND lower(decider) = requester THEN 'own request' END, CASE WHEN NOT unnamed AND NOT may THEN 'not in the chain' END, CASE WHEN decision = 'REJECT' AND trim(reason) = '' THEN 'no reason' END], lambda x: x IS NOT NULL) AS problems FROM n)
SELECT request_id, decider, decision, problems, len(problems) = 0 AS legal FROM w""")
def p4_check_decisions(spark, sf_dir):
    own = _routed(spark, sf_dir)
    routed = access.route_requests(own, AS_OF).join(own.select("request_id", "requester"), "request_id")
    k = F.col("request_id")
    roles = lambda *names: F.array(*map(F.lit, names))
    decisions = routed.select(
        "request_id", "requester", "approvers", F.when(k % 11 == 0, " ").when(k % 11 != 1, F.concat(F.lit("U"), (k % 7).cast("string"))).alias("decider"), F.when(k % 4 == 0, roles("OWNER", "STEWARD")).when(k % 4 == 1, roles("ADMIN")).when(k % 4 == 2, roles("READER")).alias("decider_roles"),
        F.when(k % 2 == 0, "REJECT").otherwise("APPROVE").alias("decision"), F.when(k % 4 == 0, " ").otherwise("r").alias("reason"),
    )
    return access.check_decisions(decisions)


_LIFE = """use AS (SELECT actor AS subject, resource AS resource_urn, count(*) AS uses, max(event_time) AS last_use FROM ok GROUP BY 1, 2), s AS (SELECT min(event_time) AS log_start FROM ok),
j AS (SELECT *, floor(epoch(TIMESTAMP '{}' - granted_at) / 86400) AS age, log_start <= granted_at AS covered FROM access_grant LEFT JOIN use USING (subject, resource_urn), s WHERE status = 'ACTIVE')"""


@query(
    with_views(
        f"""{_NORMAL}, {_LIFE.format('2024-07-05')} SELECT id, subject, resource_urn, coalesce(uses, 0) AS uses, last_use, CASE WHEN uses > 0 THEN 'IN_USE' WHEN age >= 30 AND (covered OR (id % 3 <> 0 AND age >= 180)) THEN 'REVOKE_CANDIDATE' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict,
granularity = 'DATASET' AND age >= 30 AND uses IS NULL AS wide FROM j""",
        "engine_audit_raw",
        "access_grant",
    )
)
def p5_least_privilege(spark, sf_dir):
    grants = load(spark, sf_dir, "access_grant")
    return access.least_privilege(grants, _ok(spark, sf_dir), "2024-07-05 00:00:00", grants.filter("id % 3 = 0"))


@query(
    with_views(
        f"""{_NORMAL}, {_LIFE.format('2024-04-05')} SELECT id, subject, resource_urn, coalesce(uses, 0) AS uses, CASE WHEN NOT covered OR age < 30 THEN 'NEED_MORE_INFO' WHEN uses IS NULL AND age >= 90 THEN 'REVOKE' ELSE 'KEEP' END AS proposal FROM j WHERE id % 4 <> 0""",
        "engine_audit_raw",
        "access_grant",
    )
)
def p6_review_campaign(spark, sf_dir):
    grants = load(spark, sf_dir, "access_grant")
    done = grants.filter("id % 4 = 0").select("id", F.lit("spring").alias("campaign"))
    return access.review_campaign(grants, done, _ok(spark, sf_dir), "spring", "2024-04-05 00:00:00")


@query(with_views("SELECT status, granularity, count(*) AS grants, count(DISTINCT subject) AS subjects, count(*) FILTER (status = 'ACTIVE' AND expires_at < TIMESTAMP '2024-03-15' + INTERVAL 30 DAY) AS expiring FROM access_grant GROUP BY 1, 2", "access_grant"))
def p7_access_report(spark, sf_dir):
    return access.access_report(load(spark, sf_dir, "access_grant"), "2024-03-15 00:00:00")


_FUNNEL = "SELECT o_orderkey AS request_id, o_orderstatus AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + (INTERVAL 1 HOUR) * (o_custkey % 70) END AS decided_at, CASE WHEN o_orderkey % 4 <> 0 THEN 'L' || CAST(o_orderkey % 4 AS STRING) END AS classification FROM orders"


@query(f"WITH q AS ({_FUNNEL}), h AS (SELECT *, epoch(decided_at - created_at) / 3600 AS hours FROM q WHERE created_at > TIMESTAMP '1998-06-01' - INTERVAL 900 DAY) SELECT status, count(*) AS requests, count(decided_at) AS decided, round(avg(hours), 2) AS mean_hours, round(max(hours), 2) AS longest_hours FROM h GROUP BY 1")
def p7_request_funnel(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return access.request_funnel(spark.sql(_FUNNEL), "1998-06-01 00:00:00", 900)


@query(with_views(f"q AS ({_FUNNEL}) SELECT coalesce(classification, 'L2') AS classification, count(*) AS grants FROM access_grant LEFT JOIN q ON request_id = id GROUP BY 1", "access_grant"))
def p7_grants_by_level(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return access.grants_by_level(load(spark, sf_dir, "access_grant").withColumn("request_id", F.col("id")), spark.sql(_FUNNEL))


@query("SELECT o_orderstatus AS outcome, count(*) AS requests, round(avg(o_custkey % 70), 3) AS mean_hours, round(max(o_custkey % 70)::DOUBLE, 3) AS longest_hours FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def a11_decision_latency(spark, sf_dir):
    own = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("outcome"), F.col("o_orderdate").alias("requested_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_custkey").cast("int") % 70)).alias("decided_at"))
    return access.decision_latency(own)


@query("SELECT event_type, user_id % 50 AS who, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, sha256('{\"event_type\":\"' || event_type || '\",\"who\":' || (user_id % 50) || '}') AS content_hash FROM events GROUP BY 1, 2")
def a16_occurrences(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("who", F.col("user_id") % 50)
    return access.dedup_occurrences(events, ["event_type", "who"], "ts")


@query("WITH n AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS INTEGER) AS rank FROM n) SELECT * FROM r WHERE rank <= 10")
def a15_top_per_group(spark, sf_dir):
    return access.ranked_top(load(spark, sf_dir, "events"), "event_type", "user_id", 10)


@query("WITH b AS (SELECT user_id % 20 AS batch, count(*) AS n FROM events GROUP BY 1) SELECT event_id, user_id % 20 AS batch FROM events WHERE user_id % 20 IN (SELECT batch FROM b WHERE n <= 500)")
def s9_admit_batches(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("batch"))
    return access.admit_batches(events, "batch", 500)[0].select("event_id", "batch")


@query("SELECT user_id % 20 AS batch, count(*) AS received, count(*) <= 500 AS admitted FROM events GROUP BY 1")
def s9_admission_report(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("batch"))
    return access.admit_batches(events, "batch", 500)[1]
