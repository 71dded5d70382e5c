"""Branches of operators on small literal tables."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from trustlake.functions import types as kinds
from trustlake.operators import access, contracts, graph, metadata, observe, policy, rules, search
from trustlake.streaming import jobs


def series(spark, name, values):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(name, None, "m", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "dataset_urn string, column_name string, metric string, window_start timestamp, value_num double")


def test_anomalies_flag_skip_and_flat(spark):
    cases = {"jump": [1000] * 13 + [100000], "short": [1, 2, 3], "flat": [5] * 10, "zero": [0] * 9 + [3], "even": [1, 2, 3, 4, 5, 6, 7, 40]}
    df = None
    for n, v in cases.items():
        df = series(spark, n, v) if df is None else df.union(series(spark, n, v))
    out = {r.dataset_urn: r for r in observe.anomalies(df, "2024-02-01 00:00:00").collect()}
    assert out["jump"].flagged and out["jump"].severity == "CRITICAL"
    assert out["short"].skipped == "too few points" and not out["short"].flagged
    assert out["flat"].score == 0.0 and out["zero"].score == 9.9
    assert out["even"].flagged


def test_seasonal_needs_four_places(spark):
    long, short = series(spark, "long", [i % 7 for i in range(35)]), series(spark, "short", [i % 7 for i in range(20)])
    out = {r.dataset_urn: r.method for r in observe.anomalies(long.union(short), "2024-03-01 00:00:00", period=7).collect()}
    assert out == {"long": "seasonal_mad", "short": "mad"}


def snapshot(spark, n, skip=0, source="s"):
    return spark.createDataFrame([(source, f"u{i}") for i in range(skip, n)], "source string, urn string")


def test_guard_branches(spark):
    empty = snapshot(spark, 0)
    first = metadata.guard(empty, snapshot(spark, 5)).first()
    assert not first.blocked and first.deletions == 0
    assert not metadata.guard(snapshot(spark, 20), snapshot(spark, 20)).first().blocked
    assert metadata.guard(snapshot(spark, 20), snapshot(spark, 20, 2)).first().deletions == 2
    many = metadata.guard(snapshot(spark, 1000), snapshot(spark, 1000, 201)).first()
    assert many.blocked and many.reasons == ["too many deletions"]
    assert "too large a share" in metadata.guard(snapshot(spark, 20), snapshot(spark, 20, 7)).first().reasons
    assert not metadata.guard(snapshot(spark, 5), snapshot(spark, 5, 4)).first().blocked


def test_closure_ends_on_cycles_and_finds_least_depth(spark):
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "from_urn string, to_urn string")
    roots = spark.createDataFrame([("a",)], "root string")
    out = {(r.urn, r.depth) for r in graph.closure(edge, roots, "down", None).collect()}
    assert out == {("b", 1), ("c", 1), ("d", 2)}


def test_shortest_path_takes_the_least_parent(spark):
    edge = spark.createDataFrame([(a, b, 0.9, "ACTIVE") for a, b in ("sb", "sa", "at", "bt", "tx")], "from_urn string, to_urn string, confidence double, state string")
    pairs = spark.createDataFrame([("s", "t"), ("t", "s"), ("s", "s")], "source string, target string")
    out = {(r.source, r.target): (r.found, r.path) for r in graph.shortest_paths(edge, pairs).collect()}
    assert out == {("s", "t"): (True, ["s", "a", "t"]), ("t", "s"): (False, None), ("s", "s"): (True, ["s"])}


def test_type_changes(spark):
    cases = [("int", "bigint", "widened"), ("bigint", "int", "narrowed"), ("int", "text", "changed"), ("decimal(10,2)", "double", "widened"), ("numeric(3)", "NUMERIC(5)", "same")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", kinds.type_change(F.col("a"), F.col("b"))).collect())


def test_version_bumps(spark):
    cases = [("1.2.3", "2.0.0", 3), ("1.2.3", "1.3.0", 2), ("1.2.3", "1.2.4", 1), ("1.2.3", "1.2.3", 0), ("1.2.3", "0.9.9", 2), ("x", "1.0.0", None), ("1.0.0", "1.0.1-rc1", None), ("1.0", "1.1", 2)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", contracts.bump(F.col("a"), F.col("b"))).collect())


def test_durations_and_comparisons(spark):
    df = spark.createDataFrame([("PT24H",), ("P1DT2H3M4S",), ("P",), ("24h",), (None,)], "d string")
    assert [r[0] for r in df.select(rules.duration_seconds(F.col("d"))).collect()] == [86400, 93784, None, None, None]
    one = spark.range(1)
    ok = lambda op, v, a, b=None: one.select(rules.holds(F.lit(v), F.lit(op), F.lit(a), F.lit(b if b is not None else a))).first()[0]
    assert ok("=", 1.0, 1.0 + 1e-12) and ok("between", 2.0, 1.0, 3.0) and not ok(">", 1.0, 1.0) and ok("<=", 1.0, 1.0)
    assert ok(">", 2.0, 1.9999999999) and not ok(">=", 1.9999999999, 2.0) and ok("<", 1.9999999999, 2.0) and not ok("between", 0.9999999999, 1.0, 3.0)
    assert ok("~", 1.0, 1.0) is None and ok("in", 1.0, 1.0) is False
    among = lambda v: one.select(rules.holds(F.lit(v), F.lit("in"), F.lit(None).cast("double"), None, F.array(F.lit("2"), F.lit("x"), F.lit("3.0")))).first()[0]
    assert (among(3.0), among(2.0), among(4.0)) == (True, True, False)


def test_empty_tables_give_defined_rule_results(spark):
    empty = spark.createDataFrame([], "a int, s string")
    checks = [{"id": "n", "table": "t", "columns": ["a"], "check": "nullRatio", "threshold": 0}, {"id": "p", "table": "t", "columns": ["s"], "check": "pattern", "threshold": 1, "args": {"regex": "x"}}, {"id": "f", "table": "t", "columns": ["s"], "check": "freshness", "maxLag": "PT6H"}, {"id": "u", "table": "t", "columns": ["a"], "check": "duplicates"}, {"id": "r", "table": "t", "columns": ["a"], "check": "unique", "threshold": 1}]
    out = {r.rule_id: r.status for r in rules.evaluate_rules({"t": empty}, rules.rules_from_checks(spark, checks), "2024-01-01 00:00:00").collect()}
    assert out == {"n": "PASS", "p": "PASS", "f": "PASS", "u": "PASS", "r": "PASS"}


def test_quarantine_counts_null_as_broken(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "a int")
    good, bad = rules.quarantine(df, {"small": F.col("a") < 3})
    assert [r.a for r in good.collect()] == [1] and {r.a for r in bad.collect()} == {None, 5}


def test_deny_and_unknown_operator(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert policy.apply_policies(df, [{"id": "1", "kind": "deny"}], {"user": "u"}).count() == 0
    try:
        policy.row_filter({"column": "a", "operator": "LIKE", "value": "x"}, "u")
        raise AssertionError("not refused")
    except ValueError:
        pass


def test_event_time_forms(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(access.event_time(F.col("t")).cast("string")).collect()]
    assert got == ["2023-11-14 22:13:20"] * 3 + [None, None]


def test_repartitioning_changes_nothing(spark):
    rows = [(i, float(i % 7), f"u{i % 5}", "a", "f", str(i % 3), ["MANUAL", "IMPORTED", "AI_GENERATED", "AUTO_COLLECTED"][i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "seq int, tie double, urn string, aspect_type string, field string, value string, source string")
    one, many = metadata.version_timeline(df.coalesce(1)), metadata.version_timeline(df.repartition(7, "seq"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_hash_chain(spark):
    import hashlib

    rows, before = [], ""
    for i in range(4):
        before = hashlib.sha256(f"{before}|c{i}".encode()).hexdigest()
        rows.append(("k", i, f"c{i}", before))
    df = spark.createDataFrame(rows, "chain string, seq int, content string, hash string")
    assert metadata.verify_chain(df, ["content"]).count() == 0
    assert metadata.verify_chain(df.withColumn("content", F.when(F.col("seq") == 2, "y").otherwise(F.col("content"))), ["content"]).count() == 1


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


ALERT_SIGNALS = [(0, True, "WARNING"), (0.4, False, "LOW"), (10, True, "WARNING"), (20, True, "CRITICAL"), (20 + 43200, True, "CRITICAL"), (43300, False, "CRITICAL"), (43400, True, "WARNING"), (44000, True, "WARNING"), (44001, None, "LOW")]
ALERT_ACTIONS = [("FIRED", 1), ("REMINDED", 4), ("RESOLVED", 4), ("FLAP_SUPPRESSED", 4), ("FIRED", 1), ("RESOLVED", 1)]


def alert_signals(spark, signals, key="k"):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(key, t + dt.timedelta(seconds=s), f, x) for s, f, x in signals], "dedup_key string, at timestamp, firing boolean, severity string")


def test_alert_state_machine(spark):
    got = [(r.action, r.fire_count) for r in jobs.alerts_batch(alert_signals(spark, ALERT_SIGNALS)).orderBy("at").collect()]
    assert got == ALERT_ACTIONS


def run_alerts(spark, folder, tmp_path):
    out = f"{tmp_path}/out"
    stream = jobs.alert_actions(jobs.event_stream(spark, folder, 1), late="1 minute")
    sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    jobs.run_available(jobs.started(sink, spark, **jobs.ROCKSDB))
    return spark.read.schema(stream.schema).parquet(out)


def test_alert_stream_over_micro_batches_orders_late_signals(spark, tmp_path):
    import time

    # Each file is a micro-batch; within the minute allowed, a signal may come after a later one, beyond it is left out.
    batches = [[ALERT_SIGNALS[0], ALERT_SIGNALS[3]], [ALERT_SIGNALS[2], ALERT_SIGNALS[1]], [ALERT_SIGNALS[4]], ALERT_SIGNALS[5:7], [(43000, False, "LOW")], ALERT_SIGNALS[7:], [(60_000, False, "LOW")]]
    folder = f"{tmp_path}/in"
    for batch in batches:
        alert_signals(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    got = [(r.action, r.fire_count) for r in run_alerts(spark, folder, tmp_path).orderBy("at").collect()]
    assert got == ALERT_ACTIONS


def test_alert_stream_equals_batch_for_a_hot_key(spark, tmp_path):
    rows = [(i * 7.3 % 5000, i % 11 != 0, "CRITICAL" if i % 5 == 0 else "WARNING") for i in range(4000)]
    folder = f"{tmp_path}/in"
    alert_signals(spark, rows, "hot").union(alert_signals(spark, rows[::40], "cold")).union(alert_signals(spark, [(9000, False, "LOW")], "end")).coalesce(1).write.parquet(folder)
    want = sorted(map(tuple, jobs.alerts_batch(spark.read.parquet(folder)).collect()), key=repr)
    assert sorted(map(tuple, run_alerts(spark, folder, tmp_path).collect()), key=repr) == want and len(want) > 20


def test_sample_by_key_repeats(spark, data):
    from trustlake.operators.profile import sample_for_profile

    orders = spark.read.parquet(f"{data}/orders.parquet")
    a, b = (sample_for_profile(orders.repartition(n), 20, "o_orderkey")[0].select("o_orderkey").collect() for n in (1, 5))
    assert sorted(a) == sorted(b) and 0 < len(a) < orders.count()


def test_block_sample_repeats_and_has_its_share(spark):
    from trustlake.operators.profile import sample_for_profile

    df = spark.range(20_000).repartition(4, "id")
    one, precision = sample_for_profile(df, 10)
    again = sample_for_profile(df, 10)[0]
    assert precision == "ESTIMATED" and sorted(one.collect()) == sorted(again.collect()) and 1600 < one.count() < 2400


def test_profile_percentiles_equal_brute_force(spark):
    from trustlake.operators.profile import profile

    rng = random.Random(3)
    rows = [(rng.choice([None, -0.0, 0.0, 1.5, rng.random()]), rng.randint(0, 5), rng.random() < 0.5, None) for _ in range(999)]
    df = spark.createDataFrame(rows, "a double, b int, c boolean, d int").repartition(5)
    got = {(r.column_name, r.metric): (r.value_num, r.value_text) for r in profile(df).collect()}
    for i, name in enumerate("ab"):
        own = sorted(r[i] for r in rows if r[i] is not None)
        for p in (0.5, 0.95):
            k = p * (len(own) - 1)
            want = own[int(k)] + (own[min(int(k) + 1, len(own) - 1)] - own[int(k)]) * (k - int(k))
            assert abs(got[name, f"p{int(p * 100)}"][0] - want) < 1e-6
        assert got[name, "distinct_count"][0] == len(set(own))
    assert got["c", "min"][1] == "false" and got["c", "max"][1] == "true" and got["c", "distinct_count"][0] == 2
    assert got["d", "p50"] == (None, None) and got["d", "distinct_count"][0] == 0
