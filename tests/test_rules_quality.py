"""Front ends and verdicts of quality rules, keys and reviews of edges, and propagation, on rows made by hand."""

from __future__ import annotations

import pytest

from trustlake.operators import graph, metadata, observe, rules


def one(spark, **check):
    return rules.rules_from_checks(spark, [{"id": "r", "table": "t", **check}]).first()


def test_templates_have_their_metrics_and_operators(spark):
    r = one(spark, check="notNull", column="id")
    assert (r.metric, r.op, r.threshold, r.problem) == ("null_count", "=", 0.0, None)
    r = one(spark, check="uniqueness", column="id", threshold=0.999)
    assert (r.metric, r.op, r.problem) == ("duplicate_ratio", "<=", None) and abs(r.threshold - 0.001) < 1e-9
    r = one(spark, check="freshness", maxLag="PT6H")
    assert (r.metric, r.op, r.threshold, r.columns) == ("freshness_seconds", "<=", 21600.0, ["updated_at"])
    assert (one(spark, check="rowCount", threshold=1).op, one(spark, check="distinctness", column="a", threshold=1).op, one(spark, check="nullRatio", column="a", threshold=1).op) == (">=", ">=", "<=")
    # The operator of a template that fixes it cannot be chosen.
    assert one(spark, check="nullRatio", column="a", threshold=1, op="=").op == "<="
    assert one(spark, check="rowCount", threshold=1, op="<").op == "<"


@pytest.mark.parametrize(
    ("check", "problem"),
    [
        ({"check": "mystery"}, "unknown check"),
        ({"check": "unique", "column": "a"}, "a threshold is needed"),
        ({"check": "notNull"}, "a column is needed"),
        ({"check": "rowCount", "op": "~", "threshold": 1}, "unknown operator ~"),
        ({"check": "rowCount", "threshold": 1, "severity": "BLOCK"}, "unknown severity BLOCK"),
        ({"check": "freshness", "maxLag": "6 hours"}, "maxLag"),
        ({"check": "freshness", "maxLag": "PT0S"}, "maxLag"),
        ({"check": "rowCountChange"}, "maxDropPct"),
        ({"check": "acceptedValues", "column": "a"}, "accepted values"),
        ({"check": "regex", "column": "a", "threshold": 1}, "a pattern"),
        ({"check": "sqlAssertion", "sql": "DELETE FROM t"}, "SELECT"),
        ({"check": "rowCount", "op": "between", "threshold": 1}, "upper threshold"),
        ({"check": "percentile", "column": "a", "threshold": 1}, "a percentile"),
    ],
)
def test_what_is_missing_is_named(spark, check, problem):
    assert problem in one(spark, **check).problem


@pytest.mark.parametrize(("duration", "seconds"), [("PT6H", 21600), ("P1D", 86400), ("PT1H30M", 5400), ("p1dt1s", 86401), ("P", None), ("PT0S", None), ("6 hours", None), ("", None)])
def test_durations(duration, seconds):
    assert rules.seconds_of(duration) == seconds


def test_severity_and_action_are_apart(spark):
    got = [one(spark, check="rowCount", threshold=1, severity=s).on_fail for s in ("critical", "HIGH", "MEDIUM", "LOW", "INFO")]
    assert got == ["BLOCK", "ALERT", "ALERT", "RECORD", "RECORD"]
    r = one(spark, check="rowCount", threshold=1, severity="LOW", on_fail="BLOCK")
    assert (r.severity, r.on_fail) == ("LOW", "BLOCK")


def test_build_tests_and_assertions(spark):
    tests = [{"unique": "id"}, {"not_null": "id"}, {"accepted_values": {"field": "s", "values": ["a", "b"]}}, {"relationships": {"field": "id", "to": "p"}}, {"relationships": {"field": "id"}}, {"accepted_values": {"field": "s"}}, {"never": 1}]
    rows = rules.rules_from_dbt_tests(spark, "m", "t", tests).collect()
    assert [r.metric for r in rows] == ["duplicate_count", "null_count", "accepted_values", "orphan_count", "orphan_count", "accepted_values", None]
    assert [r.problem is None for r in rows] == [True] * 4 + [False] * 3
    assert [r.rule_id for r in rows[:2]] == ["dbt:m#1", "dbt:m#2"] and {r.severity for r in rows} == {"HIGH"}
    own = rules.rules_from_sql(spark, [("a", "t", "select 1", None), ("b", "t", "update t", None)], "CRITICAL").collect()
    assert [(r.threshold, r.on_fail, r.problem is None) for r in own] == [(0.0, "ALERT", True), (0.0, "ALERT", False)]


def test_verdicts(spark):
    t = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "c,d")], "n int, s string")
    checks = [
        ("ratio", {"check": "nullRatio", "column": "n", "threshold": 0.5}, "PASS", 0.25),
        ("rows", {"check": "rowCount", "threshold": 1}, "PASS", 4.0),
        ("many", {"check": "rowCount", "op": ">", "threshold": 3.9999999999}, "PASS", 4.0),
        ("unique", {"check": "uniqueness", "column": "n", "threshold": 0.5}, "PASS", 0.5),
        ("strict", {"check": "uniqueness", "column": "n", "threshold": 0.6}, "FAIL", 0.5),
        ("in", {"check": "distinctCount", "column": "n", "op": "in", "acceptedValues": [1, "2"]}, "PASS", 2.0),
        ("out", {"check": "distinctCount", "column": "n", "op": "in", "acceptedValues": ["x", 3]}, "FAIL", 2.0),
        ("match", {"check": "regex", "column": "s", "pattern": "[abc]", "threshold": 0.8}, "FAIL", 0.75),
        ("values", {"check": "enum", "column": "s", "acceptedValues": ["a", "b", "c,d"]}, "PASS", 0.0),
        ("drop", {"check": "rowCountChange", "maxDropPct": 30}, "SKIPPED", 4.0),
        ("odd", {"check": "rowCount", "op": "~", "threshold": 1}, "ERROR", None),
        ("none", {"check": "rowCount"}, "FAIL", 4.0),
    ]
    own = rules.rules_from_checks(spark, [{"id": i, "table": "t", **c} for i, c, _, _ in checks])
    got = {r.rule_id: (r.status, r.observed) for r in rules.evaluate_rules({"t": t}, own, "2024-01-01 00:00:00").collect()}
    assert got == {i: (status, value) for i, _, status, value in checks}
    base = lambda n: {r.rule_id: r.status for r in rules.evaluate_rules({"t": t}, own, "2024-01-01 00:00:00", spark.createDataFrame([("t", n)], "table_name string, value double")).collect()}["drop"]
    assert (base(5.0), base(6.0)) == ("PASS", "FAIL")


EDGE = "from_urn string, to_urn string, edge_type string, source string, dependency_kind string, confidence double, observed_count long, transform string, transform_expression string, cardinality string, parse_level string, state string, first_seen int, last_seen int, seq int"


def test_edges_from_two_sources_stay_two(spark):
    old = [("a", "b", "derivesFrom", "manual", "VALUE", 0.9, 1, "DIRECT", "x", "1:1", None, "ACTIVE", 1, 1, 1), ("a", "b", "derivesFrom", "sql_parse", "CONTROL", 0.5, 3, None, None, None, "derived", "REJECTED", 1, 2, 2)]
    new = [("a", "b", "derivesFrom", "manual", None, 0.4, 1, None, "y", None, "exact", "STALE", 5, 6, 3)]
    rows = {(r.source, r.dependency_kind): r for r in metadata.upsert_edges(spark.createDataFrame(old, EDGE), spark.createDataFrame(new, EDGE)).collect()}
    assert set(rows) == {("manual", "VALUE"), ("sql_parse", "CONTROL")}
    r = rows["manual", "VALUE"]
    assert (r.confidence, r.observed_count, r.transform, r.transform_expression, r.cardinality, r.parse_level, r.state, r.first_seen, r.last_seen) == (0.9, 2, "DIRECT", "y", "1:1", "exact", "ACTIVE", 1, 6)
    assert (rows["sql_parse", "CONTROL"].state, rows["sql_parse", "CONTROL"].observed_count) == ("REJECTED", 3)


def test_a_review_is_of_one_edge(spark):
    key = "from_urn string, to_urn string, edge_type string, source string, dependency_kind string"
    edges = spark.createDataFrame([("a", "b", "derivesFrom", "sql", "VALUE", "ACTIVE", 0.5, None), ("a", "b", "contains", "sql", "VALUE", "ACTIVE", 1.0, None), ("a", "c", "derivesFrom", "sql", "VALUE", "PENDING_REVIEW", 0.5, "old")], f"{key}, state string, confidence double, confirmed_by string")
    acts = [("a", "b", "derivesFrom", "sql", "VALUE", "CONFIRM", None, "ann", 1), ("a", "b", "derivesFrom", "sql", "VALUE", "REJECT", "wrong", "bob", 2), ("a", "b", "contains", "sql", "VALUE", "REJECT", " ", "bob", 3), ("a", "c", "derivesFrom", "sql", "VALUE", "CONFIRM", None, "eve", 4), ("x", "y", "derivesFrom", "sql", "VALUE", "CONFIRM", None, "eve", 5), ("a", "c", "derivesFrom", "sql", "VALUE", "SHRUG", None, "eve", 6)]
    out, refused = graph.apply_reviews(edges, spark.createDataFrame(acts, f"{key}, action string, reason string, actor string, seq int"))
    got = {(r.to_urn, r.edge_type): (r.state, r.confidence, r.confirmed_by, r.rejected_by, r.reject_reason) for r in out.collect()}
    assert got == {("b", "derivesFrom"): ("REJECTED", 0.99, "ann", "bob", "wrong"), ("b", "contains"): ("ACTIVE", 1.0, None, None, None), ("c", "derivesFrom"): ("ACTIVE", 0.99, "eve", None, None)}
    assert {r.seq: r.problem for r in refused.collect()} == {3: "a rejection needs a reason", 5: "no such edge", 6: "unknown action"}
    with pytest.raises(ValueError):
        graph.retire_edges(edges, "contains", " ")


def test_an_upstream_that_is_not_flagged_causes_nothing(spark):
    edge = spark.createDataFrame([("up", "down")], "from_urn string, to_urn string")
    found = lambda flag: spark.sql(f"SELECT * FROM VALUES ('up', 'rows', TIMESTAMP '2024-01-02', {flag}), ('down', 'rows', TIMESTAMP '2024-01-02', true) t(dataset_urn, metric, window_start, flagged)")
    kinds = lambda flag: {r.dataset_urn: r.propagation for r in observe.classify_propagation(found(flag), edge).collect()}
    assert kinds("false") == {"down": "SOURCE"}
    assert kinds("true") == {"up": "ISOLATED", "down": "PROPAGATED"}
