"""Profiles and quality rules over the driver tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from trustlake.functions import types as kinds
from trustlake.operators import profile, rules
from trustlake.plans.fixtures import load
from trustlake.plans.registry import query

LEVELS = {"l_extendedprice": "L3"}


def _profile_sql() -> str:
    columns = [("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"), ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"), ("l_tax", "num"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")]
    out = []
    for c, kind in columns:
        num = lambda m, e, c=c: out.append(f"SELECT '{c}' AS column_name, '{m}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value_num, NULL::VARCHAR AS value_text, 'EXACT' AS precision FROM lineitem")
        num("total", "count(*)")
        num("non_null", f"count({c})")
        num("null_count", f"count(*) - count({c})")
        num("null_ratio", f"(count(*) - count({c})) / count(*)")
        num("distinct_count", f"count(DISTINCT {c})")
        if c not in LEVELS:
            for m in ("min", "max"):
                out.append(f"SELECT '{c}', '{m}', NULL, CAST({m}({c + ' + 0' if kind == 'num' else c}) AS VARCHAR), 'EXACT' FROM lineitem")
        if kind == "text":
            num("min_length", f"min(length({c}))")
            num("max_length", f"max(length({c}))")
        if kind == "num":
            num("p50", f"quantile_cont(CAST({c} AS DOUBLE), 0.5)")
            num("p95", f"quantile_cont(CAST({c} AS DOUBLE), 0.95)")
    return " UNION ALL ".join(out)


@query(_profile_sql())
def a1_profile(spark, sf_dir):
    return profile.profile(load(spark, sf_dir, "lineitem"), LEVELS)


@query("SELECT 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value_num, 'EXACT' AS precision FROM orders UNION ALL SELECT 'row_count_estimate', 12345.0, 'ESTIMATED'")
def a2_row_counts(spark, sf_dir):
    return profile.row_counts(load(spark, sf_dir, "orders"), 12345)


@query("""
WITH v AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
c AS (SELECT column_name, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 5""")
def a3_top_values(spark, sf_dir):
    return profile.top_values(load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"), classification={"o_totalprice": "L4"})


@query("SELECT CAST(date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS DOUBLE) AS freshness_seconds FROM events")
def a4_freshness(spark, sf_dir):
    return profile.freshness(load(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00")


@query("SELECT 'EXACT' AS precision, count(*) AS n FROM orders")
def a5_sampling_full(spark, sf_dir):
    df, precision = profile.sample_for_profile(load(spark, sf_dir, "orders"), 100)
    return df.agg(F.lit(precision).alias("precision"), F.count("*").alias("n"))


@query("SELECT * FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000")
def a5_sampling_by_key(spark, sf_dir):
    return profile.sample_for_profile(load(spark, sf_dir, "orders"), 10, "o_orderkey")[0]


_CHECKS = [
    {"id": "r01", "table": "orders", "columns": ["o_custkey"], "check": "notNull", "severity": "CRITICAL"},
    {"id": "r02", "table": "orders", "columns": ["o_orderstatus"], "check": "nullRatio", "op": "<=", "threshold": 0.01},
    {"id": "r03", "table": "orders", "columns": ["o_orderpriority"], "check": "missing"},
    {"id": "r04", "table": "orders", "columns": ["o_orderstatus"], "check": "distinctness", "op": "between", "threshold": 2, "threshold_high": 3},
    {"id": "r05", "table": "orders", "columns": ["o_custkey"], "check": "duplicates", "severity": "HIGH"},
    {"id": "r06", "table": "orders", "columns": ["o_custkey"], "check": "duplicateRatio", "op": "<", "threshold": 0.5},
    {"id": "r07", "table": "orders", "check": "rowCount", "op": ">", "threshold": 10},
    {"id": "r08", "table": "orders", "columns": ["o_orderdate"], "check": "freshness", "maxLag": "P1D", "severity": "LOW"},
    {"id": "r09", "table": "orders", "columns": ["o_totalprice"], "check": "percentile", "op": ">", "threshold": 1000, "args": {"p": 0.95}},
    {"id": "r10", "table": "orders", "columns": ["o_orderpriority"], "check": "pattern", "threshold": 0.99, "args": {"regex": "^[1-5]-"}},
    {"id": "r11", "table": "orders", "columns": ["o_orderstatus"], "check": "acceptedValues", "args": {"values": ["O", "F"]}},
    {"id": "r12", "table": "orders", "columns": ["o_custkey"], "check": "relationships", "args": {"to": "customer", "field": "c_custkey"}},
    {"id": "r13", "table": "lineitem", "columns": ["l_orderkey", "l_linenumber"], "check": "duplicates"},
    {"id": "r14", "table": "orders", "check": "customSql", "args": {"sql": "SELECT count(*) FROM orders WHERE o_totalprice < 0"}},
    {"id": "r15", "table": "orders", "check": "customSql", "args": {"sql": "DROP TABLE orders"}},
    {"id": "r16", "table": "orders", "columns": ["nowhere"], "check": "notNull"},
    {"id": "r17", "table": "orders", "check": "rowCountChange", "maxDropPct": 10},
    {"id": "r18", "table": "lineitem", "check": "rowCountChange", "maxDropPct": 10},
    {"id": "r19", "table": "orders", "column": "o_custkey", "check": "uniqueness", "threshold": 0.999},
    {"id": "r20", "table": "orders", "column": "o_orderstatus", "check": "distinctCount", "op": "in", "acceptedValues": ["2", "3.0", "x"]},
    {"id": "r21", "table": "orders", "check": "rowCount", "threshold": 10},
    {"id": "r22", "table": "orders", "check": "rowCount", "op": "~", "threshold": 10},
    {"id": "r23", "table": "orders", "column": "o_custkey", "check": "nullRatio", "threshold": 0.5},
    {"id": "r24", "table": "orders", "check": "rowCount", "threshold": 1, "severity": "urgent"},
    {"id": "r25", "table": "orders", "column": "o_custkey", "check": "unique"},
]
# Per rule: the observed value and the condition to pass, as DuckDB reads them.
_RULE_SQL = {
    "r01": ("orders", "null_count", "count(*) FILTER (o_custkey IS NULL)", "v = 0", "BLOCK"),
    "r02": ("orders", "null_ratio", "count(*) FILTER (o_orderstatus IS NULL) / count(*)", "v <= 0.01", "ALERT"),
    "r03": ("orders", "missing_count", "count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority = '')", "v = 0", "ALERT"),
    "r04": ("orders", "distinct_count", "count(DISTINCT o_orderstatus)", "v BETWEEN 2 AND 3", "ALERT"),
    "r05": ("orders", "duplicate_count", "count(*) - count(DISTINCT o_custkey)", "v = 0", "ALERT"),
    "r06": ("orders", "duplicate_ratio", "1 - count(DISTINCT o_custkey) / count(*)", "v < 0.5", "ALERT"),
    "r07": ("orders", "row_count", "count(*)", "v > 10", "ALERT"),
    "r08": ("orders", "freshness_seconds", "date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02 00:00:00')", "v <= 86400", "RECORD"),
    "r09": ("orders", "percentile", "quantile_cont(o_totalprice, 0.95)", "v > 1000", "ALERT"),
    "r10": ("orders", "pattern_match_rate", "count(*) FILTER (regexp_matches(o_orderpriority, '^[1-5]-')) / count(*)", "v >= 0.99", "ALERT"),
    "r11": ("orders", "accepted_values", "count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))", "v = 0", "ALERT"),
    "r12": ("orders", "orphan_count", "count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer))", "v = 0", "ALERT"),
    "r13": ("lineitem", "duplicate_count", "count(*) - count(DISTINCT (l_orderkey, l_linenumber))", "v = 0", "ALERT"),
    "r14": ("orders", "custom_sql", "count(*) FILTER (o_totalprice < 0)", "v = 0", "ALERT"),
    "r17": ("orders", "row_count_drop", "count(*)", "v >= 1000 * 0.9", "ALERT"),
    "r18": ("lineitem", "row_count_drop", "count(*)", "NULL", "ALERT"),
    "r19": ("orders", "duplicate_ratio", "1 - count(DISTINCT o_custkey) / count(*)", "v <= 1 - 0.999", "ALERT"),
    "r20": ("orders", "distinct_count", "count(DISTINCT o_orderstatus)", "v IN (2, 3)", "ALERT"),
    "r21": ("orders", "row_count", "count(*)", "v >= 10", "ALERT"),
    "r23": ("orders", "null_ratio", "count(*) FILTER (o_custkey IS NULL) / count(*)", "v <= 0.5", "ALERT"),
}
_RULES_ORACLE = " UNION ALL ".join(
    f"SELECT '{i}' AS rule_id, '{t}' AS table_name, '{m}' AS metric, round(v, 6) AS observed, CASE WHEN ({ok}) IS NULL THEN 'SKIPPED' WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN NOT ({ok}) THEN '{act}' END AS action, NULL AS reason FROM (SELECT CAST({e} AS DOUBLE) AS v FROM {t})"
    for i, (t, m, e, ok, act) in _RULE_SQL.items()
) + " UNION ALL SELECT 'r15', 'orders', 'custom_sql', NULL, 'ERROR', NULL, 'one SELECT statement is needed' UNION ALL SELECT 'r16', 'orders', 'null_count', NULL, 'ERROR', NULL, 'unknown column' UNION ALL SELECT 'r22', 'orders', 'row_count', NULL, 'ERROR', NULL, 'unknown operator ~' UNION ALL SELECT 'r24', 'orders', 'row_count', NULL, 'ERROR', NULL, 'unknown severity URGENT; what a failure does is on_fail' UNION ALL SELECT 'r25', 'orders', 'duplicate_ratio', NULL, 'ERROR', NULL, 'a threshold is needed'"


@query(_RULES_ORACLE)
def q1_evaluate_rules(spark, sf_dir):
    tables = {t: load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer")}
    baselines = spark.createDataFrame([("orders", 1000.0)], "table_name string, value double")
    return rules.evaluate_rules(tables, rules.rules_from_checks(spark, _CHECKS), "2001-08-02 00:00:00", baselines)


@query("SELECT count(*)::DOUBLE AS value FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def j3_orphans(spark, sf_dir):
    return rules.orphan_count(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").filter("c_custkey % 3 = 0"), "o_custkey", "c_custkey")


@query("""
WITH c AS (SELECT 'c' || n_regionkey AS contract_id, n_name AS table_name, [{'column': 'a', 'check': 'notNull', 'op': '=', 'threshold': 0.0}, {'column': 'b', 'check': 'unique', 'op': '=', 'threshold': 0.0}] AS quality FROM nation)
SELECT contract_id || '#0' AS rule_id, table_name, 'a' AS column_name, 'notNull' AS "check", '=' AS op, 0.0::DOUBLE AS threshold FROM c UNION ALL SELECT contract_id || '#1', table_name, 'b', 'unique', '=', 0.0 FROM c""")
def c6_rules_from_contracts(spark, sf_dir):
    quality = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.lit("=").alias("op"), F.lit(0.0).alias("threshold")) for c, k in (("a", "notNull"), ("b", "unique"))])
    contracts = load(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("contract_id"), F.col("n_name").alias("table_name"), quality.alias("quality"))
    return rules.rules_from_contracts(contracts)


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, list_filter(['quantity', 'discount', 'flag'], lambda x: (x = 'quantity' AND l_quantity > 45) OR (x = 'discount' AND l_discount > 0.09) OR (x = 'flag' AND l_returnflag = 'R')) AS broken_rules
FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.09 OR l_returnflag = 'R'""")
def q4_quarantine(spark, sf_dir):
    checks = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.09, "flag": F.col("l_returnflag") != "R"}
    bad = rules.quarantine(load(spark, sf_dir, "lineitem"), checks)[1]
    return bad.select("l_orderkey", "l_linenumber", "l_extendedprice", "broken_rules")


_TYPES = ["INTEGER", "varchar(20)", "timestamptz", "jsonb", "uuid", "bytea", "boolean", "numeric(10,2)", "geometry", "interval", "text[]", "xml"]
_TYPE = f"list_element([{', '.join(repr(t) for t in _TYPES)}], CAST(p_partkey % {len(_TYPES)} + 1 AS BIGINT)) AS type"


@query(f"""
WITH t AS (SELECT p_partkey, {_TYPE} FROM part) SELECT p_partkey, type, CASE type WHEN 'INTEGER' THEN 'numeric' WHEN 'interval' THEN 'numeric' WHEN 'varchar(20)' THEN 'string' WHEN 'text[]' THEN 'string' WHEN 'timestamptz' THEN 'temporal' WHEN 'jsonb' THEN 'json' WHEN 'uuid' THEN 'uuid' WHEN 'bytea' THEN 'binary' WHEN 'boolean' THEN 'boolean' WHEN 'numeric(10,2)' THEN 'numeric' ELSE 'other' END AS family,
type IN ('INTEGER', 'interval', 'varchar(20)', 'text[]', 'timestamptz', 'numeric(10,2)', 'boolean') AS orderable, type NOT IN ('jsonb', 'xml') AS equatable FROM t""")
def f8_type_caps(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_partkey") % len(_TYPES) + 1).cast("int"))
    df = load(spark, sf_dir, "part").select("p_partkey", names.alias("type"))
    return df.withColumn("caps", kinds.type_caps(F.col("type"))).select("p_partkey", "type", "caps.*")


_DURATION = "CASE p_partkey % 5 WHEN 0 THEN 'PT' || CAST(p_size AS STRING) || 'H' WHEN 1 THEN 'P' || CAST(p_size AS STRING) || 'DT' || CAST(p_partkey % 60 AS STRING) || 'M' || CAST(p_size AS STRING) || 'S' WHEN 2 THEN 'P' WHEN 3 THEN CAST(p_size AS STRING) || 'h' END"


@query(f"SELECT p_partkey, {_DURATION} AS duration, CASE p_partkey % 5 WHEN 0 THEN p_size * 3600 WHEN 1 THEN p_size * 86400 + p_partkey % 60 * 60 + p_size END::BIGINT AS seconds FROM part")
def x5_durations(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.expr(_DURATION).alias("duration")).withColumn("seconds", rules.duration_seconds(F.col("duration")))


@query("""
WITH v(rule_id, metric, op, threshold, observed) AS (VALUES ('dbt:orders#1', 'duplicate_count', '=', 0, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)), ('dbt:orders#2', 'null_count', '=', 0, (SELECT count(*) FILTER (o_custkey IS NULL) FROM orders)),
('dbt:orders#3', 'accepted_values', '=', 0, (SELECT count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders)), ('dbt:orders#4', 'orphan_count', '=', 0, (SELECT count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)) FROM orders)),
('sql', 'custom_sql', '=', 3, (SELECT count(*) FROM orders WHERE o_totalprice < 0)))
SELECT rule_id, metric, CAST(observed AS DOUBLE) AS observed, CASE WHEN observed = threshold THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN observed <> threshold THEN 'ALERT' END AS action FROM v""")
def q2_front_ends(spark, sf_dir):
    tables = {"orders": load(spark, sf_dir, "orders")}
    tables["even"] = tables["orders"].filter("o_custkey % 2 = 0")
    tests = [{"unique": "o_orderkey"}, {"not_null": "o_custkey"}, {"accepted_values": {"field": "o_orderstatus", "values": ["O", "F"]}}, {"relationships": {"field": "o_custkey", "to": "even"}}]
    own = rules.rules_from_dbt_tests(spark, "orders", "orders", tests)
    own = own.unionByName(rules.rules_from_sql(spark, [("sql", "orders", "SELECT count(*) FROM orders WHERE o_totalprice < 0", 3)], "CRITICAL"))
    return rules.evaluate_rules(tables, own, "2001-08-02 00:00:00").select("rule_id", "metric", "observed", "status", "action")


_KEPT = ["l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag"]
_BOUNDS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS non_null, true AS same_as_one_pass, true AS distinct_within_4_percent, true AS median_within_2_percent FROM lineitem" for c in _KEPT
)


@query(_BOUNDS)
def a1_merged_profile(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    merged = profile.merged_profile(profile.day_sketches(df, F.date_trunc("year", "l_shipdate"), _KEPT))
    one = profile.merged_profile(profile.day_sketches(df, F.lit(0), _KEPT)).select("column_name", F.col("distinct_count").alias("d1"), F.col("p50").alias("m1"))
    parts = []
    for c in _KEPT:
        # The share of values under the estimated median, and the exact distinct count.
        exact = df.agg(F.count_distinct(c).alias("d")).crossJoin(merged.filter(F.col("column_name") == c).select("column_name", "total", "non_null", "distinct_count", "p50"))
        if c != "l_returnflag":
            below = df.select(F.col(c).cast("double").alias("v")).crossJoin(F.broadcast(merged.filter(F.col("column_name") == c).select("p50"))).agg((F.count_if(F.col("v") < F.col("p50")) / F.count("*")).alias("low"), (F.count_if(F.col("v") <= F.col("p50")) / F.count("*")).alias("high"))
        else:
            below = spark.range(1).select(F.lit(0.5).alias("low"), F.lit(0.5).alias("high"))
        parts.append(exact.crossJoin(below).join(one, "column_name"))
    both = functools.reduce(lambda a, b: a.unionByName(b), parts)
    same = (F.abs(F.col("distinct_count") - F.col("d1")) <= 0.04 * F.col("d1")) & (F.col("p50").isNull() == F.col("m1").isNull())
    close = F.abs(F.col("distinct_count") - F.col("d")) <= 0.04 * F.col("d")
    return both.select("column_name", "total", "non_null", same.alias("same_as_one_pass"), close.alias("distinct_within_4_percent"), ((F.col("low") <= 0.52) & (F.col("high") >= 0.48)).alias("median_within_2_percent"))
