"""Audit fields, routing, decisions, reviews, policies, incidents, alerts and rollbacks on rows made by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trustlake.operators import access, graph, metadata, observe, policy

T = dt.datetime(2024, 6, 1)


def days(n):
    return T + dt.timedelta(days=n)


def test_audit_fields_of_engines(spark):
    rows = [
        {"eventTime": "2024-01-01T00:00:00Z", "user": "a", "table": "t", "operation": None, "succeeded": None},
        {"eventTimeMillis": "1704067200000", "reqUser": "b", "resourceName": "t", "access": "select", "result": "DENIED", "requestId": "r1", "bytes": "7"},
        {"queryTime": "1704067200", "username": "c", "tableName": " t ", "queryType": "Insert", "result": "ALLOWED", "columnList": "x, y,,", "clientIp": "10.0.0.1"},
        {"createTime": "never", "principal": "d", "object": "t"},
        {"timestamp": "2024-01-01 00:00:00", "object": "t"},
        {"time": "2024-01-01 00:00:00", "accessedBy": "e"},
    ]
    names = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([[r.get(n) for n in names] for r in rows], ", ".join(f"{n} string" for n in names))
    ok, rejected = access.normalize_audit(df)
    got = {r.actor: r for r in ok.collect()}
    assert set(got) == {"a", "b", "c"} and {r.event_time for r in got.values()} == {dt.datetime(2024, 1, 1)}
    assert (got["a"].operation, got["a"].asked, got["a"].succeeded, got["a"].columns) == ("SELECT", None, True, [])
    assert (got["b"].operation, got["b"].succeeded, got["b"].query_id, got["b"].bytes_scanned) == ("SELECT", False, "r1", 7)
    assert (got["c"].resource, got["c"].operation, got["c"].succeeded, got["c"].columns, got["c"].source_ip) == ("t", "INSERT", True, ["x", "y"], "10.0.0.1")
    assert sorted(r.reason for r in rejected.collect()) == ["no actor", "no resource", "no time"]


def test_a_record_without_an_operation_is_not_one_that_says_select(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a", "t", None), ("2024-01-01 00:00:00", "a", "t", "select")], "event_time string, actor string, resource string, operation string")
    assert access.normalize_audit(df)[0].select(access.record_hash("e")).distinct().count() == 2


def route(spark, level, granularity, purpose="weekly report", duration=30, requester="ann", at=T):
    df = spark.createDataFrame([(1, level, granularity, purpose, duration, requester, at)], "request_id int, classification string, granularity string, purpose string, duration_days int, requester string, requested_at timestamp_ntz")
    return access.route_requests(df, "2024-06-03 12:00:00").first()


def test_routing(spark):
    r = route(spark, "L4", "COLUMN")
    assert (r.approvers, r.sla_hours, r.overdue, r.suggestion) == (["STEWARD", "ADMIN"], 72, False, "as asked")
    r = route(spark, "l3", "TABLE", " ab ", 400, None)
    assert (r.approvers, r.sla_hours, r.overdue, r.suggestion) == (["STEWARD", "ADMIN"], 48, True, "ask for columns")
    assert r.notes[2:] == ["purpose too short", "asked for 400 days: a role fits better"]
    assert route(spark, None, "DATASET").approvers == ["STEWARD"] and route(spark, " ", None).notes[0].startswith("level L2:")
    ends = spark.createDataFrame([(T, None), (T, 0), (T, 7), (T, 9999)], "t timestamp_ntz, d int").select(access.grant_end(F.col("t"), F.col("d")).alias("e")).collect()
    assert [r.e for r in ends] == [days(90), days(90), days(7), days(3650)]


def test_decisions(spark):
    chain = ["STEWARD", "ADMIN"]
    cases = {
        (1, "ann", "bob", ("STEWARD",), "APPROVE", None): [],
        (2, "ann", "ANN", ("ADMIN",), "APPROVE", None): ["own request"],
        (3, "ann", "bob", ("ADMIN",), "REJECT", "no need"): [],
        (4, "ann", "bob", ("READER",), "REJECT", " "): ["not in the chain", "no reason"],
        (5, "ann", None, ("ADMIN",), "APPROVE", None): ["nobody named"],
        (6, "ann", "bob", None, "APPROVE", None): ["not in the chain"],
    }
    df = spark.createDataFrame([(i, r, chain if i != 3 else ["STEWARD"], d, None if x is None else list(x), w, y) for i, r, d, x, w, y in cases], "request_id int, requester string, approvers array<string>, decider string, decider_roles array<string>, decision string, reason string")
    got = {r.request_id: r.problems for r in access.check_decisions(df).collect()}
    assert got == {k[0]: v for k, v in cases.items()}


GRANT = "id int, subject string, resource_urn string, granularity string, granted_at timestamp_ntz, status string"
AUDIT = "actor string, resource string, event_time timestamp, rows_scanned long, operation string"


def test_least_privilege_needs_a_log_that_covers_the_grant(spark):
    grants = spark.createDataFrame([(1, "a", "t", "DATASET", days(-100), "ACTIVE"), (2, "b", "t", "DATASET", days(-100), "ACTIVE"), (3, "b", "u", "COLUMN", days(-20), "ACTIVE"), (4, "b", "v", "COLUMN", days(-200), "ACTIVE"), (5, "b", "w", "COLUMN", days(-200), "ACTIVE"), (6, "b", "x", "COLUMN", days(-130), "ACTIVE"), (7, "b", "y", "DATASET", days(-99), "REVOKED")], GRANT)
    audit = spark.createDataFrame([("z", "z", days(-120), 1, "S"), ("a", "t", days(-5), 9, "S"), ("a", "t", days(-4), 9, "S")], AUDIT)
    reviewed = spark.createDataFrame([(5,)], "id int")
    got = {r.id: (r.verdict, r.wide) for r in access.least_privilege(grants, audit, "2024-06-01 00:00:00", reviewed).collect()}
    weak, gone = "INSUFFICIENT_EVIDENCE", "REVOKE_CANDIDATE"
    assert got == {1: ("IN_USE", False), 2: (gone, True), 3: (weak, False), 4: (gone, False), 5: (weak, False), 6: (weak, False)}
    none = {r.id: r.verdict for r in access.least_privilege(grants, audit.limit(0), "2024-06-01 00:00:00").collect()}
    assert set(none.values()) == {weak}


def test_review_campaign_asks_for_more_without_evidence(spark):
    grants = spark.createDataFrame([(1, "a", "t", "D", days(-100), "ACTIVE"), (2, "b", "t", "D", days(-100), "ACTIVE"), (3, "b", "u", "D", days(-20), "ACTIVE"), (4, "b", "v", "D", days(-200), "ACTIVE"), (5, "b", "w", "D", days(-60), "ACTIVE"), (6, "a", "v", "D", days(-100), "ACTIVE")], GRANT)
    audit = spark.createDataFrame([("z", "z", days(-120), 1, "S"), ("a", "t", days(-5), 9, "S")], AUDIT)
    done = spark.createDataFrame([(6, "spring"), (1, "fall")], "id int, campaign string")
    got = {r.id: r.proposal for r in access.review_campaign(grants, done, audit, "spring", "2024-06-01 00:00:00").collect()}
    assert got == {1: "KEEP", 2: "REVOKE", 3: "NEED_MORE_INFO", 4: "NEED_MORE_INFO", 5: "KEEP"}


def test_stale_requests_and_ended_grants(spark):
    requests = spark.createDataFrame([(1, "SUBMITTED", days(-31)), (2, "IN_REVIEW", days(-29)), (3, "APPROVED", days(-99)), (4, "SUBMITTED", None)], "request_id int, status string, sla_due_at timestamp_ntz")
    assert {r.request_id: r.status for r in access.expire_requests(requests, "2024-06-01 00:00:00").collect()} == {1: "EXPIRED", 2: "IN_REVIEW", 3: "APPROVED", 4: "SUBMITTED"}
    grants = spark.createDataFrame([(1, "ACTIVE", T), (2, "ACTIVE", days(-1))], "id int, status string, expires_at timestamp_ntz")
    assert {r.id: r.status for r in access.expire(grants, "2024-06-01 00:00:00").collect()} == {1: "ACTIVE", 2: "EXPIRED"}


def test_policy_coverage(spark):
    assets = spark.createDataFrame([("ns.db.s.orders", None, None), ("ns.db.s.orders_old", "l3", "Sales"), ("other.orders", "L4", "hr")], "urn string, classification string, domain string")
    policies = [
        ("prefix", ["ns.db"], None, None, None, {"ns.db.s.orders", "ns.db.s.orders_old"}),
        ("level", None, None, ["l2"], None, {"ns.db.s.orders"}),
        ("domain", None, None, None, ["SALES", "x"], {"ns.db.s.orders_old"}),
        ("table only", None, "s.orders", None, None, set()),
        ("table in prefix", ["ns."], "q.orders", None, None, {"ns.db.s.orders"}),
        ("all", ["ns.", "other"], None, ["L3", "L4"], ["hr"], {"other.orders"}),
        ("empty", [], None, [], [], set()),
    ]
    for name, prefixes, table, levels, domains, want in policies:
        own = spark.createDataFrame([(name, prefixes, table, levels, domains)], "policy_id string, prefixes array<string>, table_name string, classifications array<string>, domains array<string>")
        got = {r.urn for r in policy.policy_coverage(assets, own).collect() if r.covered}
        assert got == want, name


def test_constant_masks_hide_what_is_null(spark):
    df = spark.createDataFrame([("x",), (None,)], "a string")
    assert [r[0] for r in df.select(policy.mask(F.col("a"), "constant")).collect()] == ["***", "***"]


def test_impact_weights_and_reasons(spark):
    edge = spark.createDataFrame([("r", "a", "derivesFrom", "VALUE"), ("r", "b", "derivesFrom", "VALUE"), ("a", "c", "derivesFrom", "VALUE"), ("a", "d", "contains", "CONTROL"), ("c", "e", "derivesFrom", "VALUE"), ("r", "urn:asset:Column:x", "derivesFrom", "VALUE")], "from_urn string, to_urn string, edge_type string, dependency_kind string").withColumns({"state": F.lit("ACTIVE"), "confidence": F.lit(0.9)})
    asset = spark.createDataFrame([("a", "Dataset", "L3", "o", "Tier1"), ("b", "Dashboard", "L4", None, None)], "urn string, entity_type string, classification string, owner string, tag string")
    roots = spark.createDataFrame([("r",)], "root string")
    got = {r.urn: r for r in graph.impact(edge, asset, roots, 2).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].score == pytest.approx((0.4 * 0.8 + 0.25 + 0.15 + 0.2 * 0.2385606) * 0.7, abs=6e-4)
    assert got["b"].score == pytest.approx((0.4 + 0.25 * 0.4 + 0.15 * 0.9) * 0.7, abs=6e-4)
    assert got["c"].score == pytest.approx((0.4 * 0.5 + 0.25 * 0.4 + 0.15 * 0.9 + 0.2 * 0.1505150) * 0.49, abs=6e-4)
    assert got["a"].reasons == ["level L3", "critical tag", "downstream 2"] and got["b"].reasons == ["level L4", "no owner"]
    assert (got["a"].critical, got["b"].critical, got["c"].critical) == (True, True, False) and got["c"].entity_type == "Unknown"
    assert [u for u, r in got.items() if r.boundary] == ["c"]
    assert "urn:asset:Column:x" in {r.urn for r in graph.impact(edge, asset, roots, 2, include_columns=True).collect()}


def test_subgraph_without_columns_walks_over_them(spark):
    edge = spark.createDataFrame([("a", "urn:asset:Column:x"), ("urn:asset:Column:x", "b"), ("b", "c")], "from_urn string, to_urn string").withColumns({"edge_type": F.lit("derivesFrom"), "dependency_kind": F.lit("VALUE"), "state": F.lit("ACTIVE"), "confidence": F.lit(0.9)})
    focus = spark.createDataFrame([("a",)], "root string")
    nodes, edges, counts = graph.subgraph(edge, focus, 2, include_columns=False)
    assert {(r.urn, r.depth) for r in nodes.collect()} == {("a", 0), ("b", 2)} and edges.count() == 0 and counts.first().found == 2
    assert {r.urn for r in graph.subgraph(edge, focus, 2)[0].collect()} == {"a", "urn:asset:Column:x", "b"}


def test_incidents_affect_their_own_dataset(spark):
    edge = spark.createDataFrame([("a", "b")], "from_urn string, to_urn string")
    found = spark.createDataFrame([("a", "HIGH", True), ("a", "CRITICAL", True), ("z", "LOW", False)], "dataset_urn string, severity string, flagged boolean")
    opened, affected = observe.open_incidents(found, spark.createDataFrame([], "dataset_urn string, status string"), edge)
    assert [tuple(r) for r in opened.collect()] == [("a", "CRITICAL", 2, 2, "OPEN")]
    assert {(r.urn, r.depth) for r in affected.collect()} == {("a", 0), ("b", 1)}


def test_incidents_close_with_a_rule_or_a_reason(spark):
    incidents = spark.createDataFrame([(i, "OPEN", None, None) for i in (1, 2, 3)], "incident_id int, status string, resolved_at timestamp_ntz, closing_rule string")
    actions = spark.createDataFrame([(1, "RESOLVED", T, "rule", None), (2, "RESOLVED", T, " ", None), (3, "RESOLVED", T, None, "restart"), (9, "NOTE", T, None, None)], "incident_id int, event_type string, occurred_at timestamp_ntz, closing_rule string, no_rule_reason string")
    out, refused = observe.resolve_incidents(incidents, actions)
    assert {r.incident_id: (r.status, r.closing_rule) for r in out.collect()} == {1: ("RESOLVED", "rule"), 2: ("OPEN", None), 3: ("RESOLVED", None)}
    assert {(r.incident_id, r.reason) for r in refused.collect()} == {(2, "a rule or a reason is needed"), (9, "no such incident")}


def test_alerts_by_evaluation(spark):
    def once(firing, alerts, at):
        candidates = spark.createDataFrame([(k, "CRITICAL") for k in firing], "dedup_key string, severity string")
        old = spark.createDataFrame(alerts, "dedup_key string, severity string, state string, first_fired_at timestamp_ntz, notified_at timestamp_ntz, resolved_at timestamp_ntz, fire_count int")
        return {r.dedup_key: (r.action, r.fire_count, r.flapping) for r in observe.reconcile_alerts(candidates, old, str(at)).collect()}

    minutes = lambda n: T + dt.timedelta(minutes=n)
    assert once(["k"], [], T) == {"k": ("FIRED", 1, False)}
    assert once(["k"], [("k", "CRITICAL", "FIRING", T, T, None, 1)], minutes(5)) == {"k": ("UPDATED", 2, False)}
    assert once(["k"], [("k", "CRITICAL", "FIRING", T, None, None, 2)], minutes(720)) == {"k": ("REMINDED", 3, False)}
    assert once(["k"], [("k", "CRITICAL", "FIRING", None, None, None, 2)], minutes(1)) == {"k": ("REMINDED", 3, False)}
    assert once([], [("k", "CRITICAL", "FIRING", T, T, None, 3)], minutes(9)) == {"k": ("RESOLVED", 3, False)}
    resolved = ("k", "CRITICAL", "RESOLVED", T, T, minutes(1), 3)
    assert once(["k"], [resolved], minutes(5)) == {"k": ("UPDATED", 3, True)} and once(["k"], [resolved], minutes(6)) == {"k": ("FIRED", 1, False)}
    assert once([], [resolved], minutes(9)) == {}


def test_schedules_that_never_succeeded(spark):
    state = spark.createDataFrame([("s", "p", 2, "FAILED", T)], "source string, namespace string, consecutive_failures int, last_status string, last_success_at timestamp_ntz")
    schedules = spark.createDataFrame([("new", "p", True, None), ("ran", "p", True, "FAILED"), ("off", "p", False, None)], "source string, namespace string, enabled boolean, last_status string")
    assert {r.dedup_key for r in observe.alert_candidates(state, schedules, "2024-06-01 00:00:00").collect()} == {"never_succeeded:p:new"}


def test_rollback_of_a_run_keeps_what_others_wrote(spark):
    versions = spark.createDataFrame([
        ("manual then run", "a", 1, "m", None), ("manual then run", "a", 2, "r", "run"), ("only run", "a", 1, "r", "run"), ("two aspects", "a", 1, "r", "run"), ("two aspects", "b", 1, "m", None),
        ("other run", "a", 1, "x", "old"), ("not current", "a", 1, "r", "run"), ("not current", "a", 2, "m", None), ("run twice", "a", 1, "r1", "run"), ("run twice", "a", 2, "r2", "run"),
    ], "urn string, aspect_type string, version long, content string, run_id string")
    names = ["manual then run", "only run", "two aspects", "other run", "not current", "run twice"]
    entity = spark.createDataFrame([(n, "run", "ACTIVE") for n in names] + [("bare", "run", "ACTIVE"), ("hand", None, "ACTIVE")], "urn string, run_id string, lifecycle string")
    events = spark.createDataFrame([(1, "run"), (2, None), (3, "old")], "edge_id int, run_id string")
    out = metadata.rollback_run(versions, entity, events, spark.createDataFrame([(1,), (2,), (3,)], "edge_id int"), "run")
    assert {(r.urn, r.version, r.content) for r in out["restored"].collect()} == {("manual then run", 3, "m"), ("run twice", 3, "r1")}
    assert {(r.urn, r.aspect_type) for r in out["dropped"].collect()} == {("only run", "a"), ("two aspects", "a")}
    assert {r.urn for r in out["tombstoned"].collect()} == {"only run", "bare"} and [r.edge_id for r in out["deleted_edges"].collect()] == [1]


def test_one_version_for_each_write(spark):
    rows = [(1, 0.0, "u", "d", "text", "x", "MANUAL"), (1, 0.0, "u", "d", "owner", "y", "MANUAL"), (2, 0.0, "u", "d", "text", "x", "MANUAL"), (3, 0.0, "u", "d", "text", "z", "IMPORTED"), (4, 0.0, "u", "d", "owner", "w", "MANUAL")]
    df = spark.createDataFrame(rows, "seq int, tie double, urn string, aspect_type string, field string, value string, source string")
    assert {(r.field, r.value, r.version) for r in metadata.version_timeline(df).collect()} == {("text", "x", 1), ("owner", "y", 1), ("owner", "w", 2)}


def test_a_rolled_back_aspect_takes_weaker_sources_again(spark):
    schema = "seq int, tie double, urn string, aspect_type string, field string, value string, source string"
    rows = [(1, 0.0, "u", "d", "text", "auto", "AUTO_COLLECTED"), (2, 0.0, "u", "d", "text", "hand", "MANUAL"), (2, 0.0, "u", "d", "owner", "ann", "MANUAL"), (3, 0.0, "u", "d", "text", "held off", "IMPORTED"), (5, 0.0, "u", "d", "text", "new", "IMPORTED"), (6, 0.0, "u", "d", "text", "weak", "AUTO_COLLECTED"), (1, 0.0, "v", "d", "text", "x", "MANUAL")]
    writes = spark.createDataFrame(rows, schema)
    resets = spark.createDataFrame([(4, "u", "d", "text", "auto", "AUTO_COLLECTED")], "seq int, urn string, aspect_type string, field string, value string, source string")
    current, held = metadata.merge_aspects(writes, resets)
    assert {(r.urn, r.field, r.value) for r in current.collect()} == {("u", "text", "new"), ("v", "text", "x")}
    assert {r.value for r in held.collect()} == {"held off", "weak"}
    assert {(r.field, r.value) for r in metadata.merge_aspects(writes)[0].filter("urn = 'u'").collect()} == {("text", "hand"), ("owner", "ann")}


def test_event_numbers_do_not_depend_on_where_rows_lie(spark):
    df = spark.range(500).withColumn("k", F.col("id") * 37 % 500)
    one, two = ({(r.id, r.seq) for r in metadata.emit_events(df.repartition(n), 2, ["k"]).collect()} for n in (1, 7))
    assert one == two and {s for _, s in one} == {(2 << 40) + i for i in range(500)}


def test_review_health(spark):
    edge = spark.createDataFrame([("PENDING_REVIEW", 0.9, "manual", days(-3), None), ("ACTIVE", 0.5, "sql", days(-9), None), ("ACTIVE", 0.5, "manual", days(-99), None), ("ACTIVE", 0.5, "sql", days(-99), "ann"), ("ACTIVE", 0.7, "sql", days(-99), None)], "state string, confidence double, source string, first_seen timestamp_ntz, confirmed_by string")
    findings = spark.createDataFrame([(days(-1),), (days(-40),)], "occurred_at timestamp_ntz")
    assert tuple(graph.review_health(edge, findings, "2024-06-01 12:00:00").first()) == (5, 1, 1, 9.5, 1)
