"""Quality rules: normal form, fused evaluation, verdicts, quarantine."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.operators.profile import distinct_counts, exact_percentiles

# Check templates, with the metric that each measures and its operator; operators, severities and what a failure does.
TEMPLATES = {
    "notNull": ("null_count", "="),
    "not_null": ("null_count", "="),
    "uniqueness": ("duplicate_ratio", "<="),
    "unique": ("duplicate_ratio", "<="),
    "nullRatio": ("null_ratio", "<="),
    "distinctness": ("distinct_count", ">="),
    "distinctCount": ("distinct_count", ">="),
    "rowCount": ("row_count", ">="),
    "rowCountChange": ("row_count_drop", ">="),
    "freshness": ("freshness_seconds", "<="),
    "acceptedValues": ("accepted_values", "="),
    "enum": ("accepted_values", "="),
    "regex": ("pattern_match_rate", ">="),
    "pattern": ("pattern_match_rate", ">="),
    "customSql": ("custom_sql", "="),
    "sqlAssertion": ("custom_sql", "="),
}
# Metrics that have no template, as checks of their own.
METRICS = {"missing": ("missing_count", "="), "duplicates": ("duplicate_count", "="), "duplicateRatio": ("duplicate_ratio", "<="), "percentile": ("percentile", "<="), "relationships": ("orphan_count", "=")}
DBT_TESTS = {"not_null": "null_count", "unique": "duplicate_count", "accepted_values": "accepted_values", "relationships": "orphan_count"}
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "between", "in")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
ACTIONS = {"CRITICAL": "BLOCK", "HIGH": "ALERT", "MEDIUM": "ALERT"}
RULE = "rule_id string, table_name string, columns array<string>, check string, metric string, op string, threshold double, threshold_high double, accepted array<string>, args map<string,string>, severity string, on_fail string, problem string"
EPSILON = 1e-9
#: Templates whose operator a check may choose.
_OPEN = {"distinctness", "distinctCount", "rowCount", *METRICS}
_ZERO = {"null_count", "accepted_values", "orphan_count", "missing_count", "duplicate_count"}


def seconds_of(duration: str) -> int | None:
    """Seconds of an ISO-8601 duration, None if it is none or not above zero."""
    found = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", duration.strip().upper())
    total = sum(int(n or 0) * unit for n, unit in zip(found.groups(), (86400, 3600, 60, 1))) if found else 0
    return total or None


def _rule(c: dict) -> tuple:
    """A check as a row of RULE."""
    args = c.get("args", {})
    given = lambda *names: next((x[n] for x in (c, args) for n in names if x.get(n) is not None), None)
    check = given("check", "type")
    metric, op = (TEMPLATES | METRICS).get(check, (None, None))
    columns = c.get("columns") or ([c["column"]] if c.get("column") else ["updated_at"] if check == "freshness" else [])
    threshold, high = given("threshold"), given("threshold_high", "thresholdMax")
    accepted = [str(v) for v in given("acceptedValues", "values") or []]
    kept = {"p": given("percentile", "p"), "regex": given("pattern", "regex"), "sql": given("sql"), "to": given("to"), "field": given("field")}
    severity = str(c.get("severity") or "MEDIUM").upper()
    asked = given("op", "operator")
    op = asked if asked and check in _OPEN else op
    if metric in ("null_count", "accepted_values", "orphan_count") or threshold is None and metric in _ZERO:
        threshold = 0
    elif metric == "custom_sql":
        threshold = given("expect") or 0
    elif metric == "freshness_seconds":
        threshold = seconds_of(given("maxLag") or "")
    elif metric == "row_count_drop":
        threshold = given("maxDropPct")
    elif check in ("uniqueness", "unique") and threshold is not None:
        threshold = 1 - threshold
    problem = None
    if metric is None:
        problem = f"unknown check {check}; there are {', '.join(TEMPLATES)}"
    elif severity not in SEVERITIES:
        problem = f"unknown severity {severity}; what a failure does is on_fail"
    elif op not in OPERATORS:
        problem = f"unknown operator {op}"
    elif metric == "accepted_values" and not accepted:
        problem = "accepted values are needed"
    elif metric == "pattern_match_rate" and kept["regex"] is None:
        problem = "a pattern is needed"
    elif metric == "percentile" and kept["p"] is None:
        problem = "a percentile is needed"
    elif metric == "custom_sql" and not re.match(r"(?is)^\s*select\b[^;]*$", kept["sql"] or ""):
        problem = "one SELECT statement is needed"
    elif metric == "freshness_seconds" and threshold is None:
        problem = "maxLag is needed, a duration such as PT6H"
    elif metric == "row_count_drop" and threshold is None:
        problem = "maxDropPct is needed"
    elif threshold is None and metric != "row_count" and op != "in":
        problem = "a threshold is needed"
    elif op == "between" and high is None:
        problem = "between needs an upper threshold"
    elif metric not in ("row_count", "custom_sql", "row_count_drop") and not columns:
        problem = "a column is needed"
    number = lambda x: None if x is None else float(x)
    kept = {k: str(v) for k, v in kept.items() if v is not None}
    return c["id"], c["table"], columns, check, metric, op, number(threshold), number(high), accepted, kept, severity, c.get("on_fail") or ACTIONS.get(severity, "RECORD"), problem


def rules_from_checks(spark: SparkSession, checks: list[dict]) -> DataFrame:
    """Checks as rule rows; a check that cannot be measured has its reason in ``problem`` (Q2).

    Keys: id, table, column or columns, check (a template or one of METRICS), severity, on_fail, and what the template needs:
    threshold (for uniqueness the share of values that are the only ones), threshold_high, maxLag, maxDropPct, pattern,
    percentile, acceptedValues, sql and expect, to and field; these may stand under ``args`` too. ``op`` counts only
    where the template leaves it open.
    """
    return spark.createDataFrame([_rule(c) for c in checks], RULE)


def rules_from_sql(spark: SparkSession, assertions: list[tuple[str, str, str, float | None]], severity: str = "MEDIUM") -> DataFrame:
    """SQL assertions (id, table, sql, expected value, 0 by default) as rule rows; a failure alerts (Q2)."""
    return rules_from_checks(spark, [{"id": i, "table": t, "check": "sqlAssertion", "sql": q, "expect": e, "severity": severity, "on_fail": "ALERT"} for i, t, q, e in assertions])


def rules_from_dbt_tests(spark: SparkSession, model: str, table: str, tests: list[dict]) -> DataFrame:
    """The tests of a build model as rule rows, HIGH: unique, not_null, accepted_values (field, values), relationships (field, to) (Q2)."""
    checks = {"null_count": "notNull", "duplicate_count": "duplicates", "accepted_values": "acceptedValues", "orphan_count": "relationships"}
    out = []
    for i, test in enumerate(tests, 1):
        kind = next((k for k in DBT_TESTS if k in test), None)
        spec = test.get(kind) if isinstance(test.get(kind), dict) else {"field": test.get(kind)}
        field = spec.get("field")
        c = {"id": f"dbt:{model}#{i}", "table": table, "check": checks.get(DBT_TESTS.get(kind), next(iter(test), None)), "column": field, "severity": "HIGH", "acceptedValues": spec.get("values"), "args": {"to": spec.get("to"), "field": field}}
        row = _rule(c)
        lacks = kind == "relationships" and not (field and spec.get("to"))
        out.append((*row[:-1], "field and to are needed" if lacks else row[-1]))
    return spark.createDataFrame(out, RULE)


def rules_from_contracts(contracts: DataFrame) -> DataFrame:
    """Each contract's quality array as rule rows (C6): contract_id, table_name, quality array<struct<column,check,op,threshold>>."""
    q = contracts.select("contract_id", "table_name", F.posexplode("quality").alias("i", "q"))
    return q.select(F.concat_ws("#", "contract_id", F.col("i").cast("string")).alias("rule_id"), "table_name", F.col("q.column").alias("column_name"), F.col("q.check").alias("check"), F.col("q.op").alias("op"), F.col("q.threshold").alias("threshold"))


def holds(value: Column, op: Column, low: Column, high: Column | None = None, accepted: Column | None = None) -> Column:
    """``value op low``; between uses ``high`` too, in the numbers among ``accepted``.

    Equality has a small tolerance, the other comparisons have none. Null for an unknown operator; without a threshold
    nothing holds.
    """
    close = lambda a, b: F.abs(a - b) < EPSILON
    among = F.exists(accepted, lambda a: F.coalesce(close(value, a.try_cast("double")), F.lit(False))) if accepted is not None else F.lit(False)
    high = F.lit(0.0) if high is None else F.coalesce(high, F.lit(0.0))
    known = (
        F.when(op == "=", close(value, low))
        .when(op == "!=", ~close(value, low))
        .when(op == ">", value > low)
        .when(op == ">=", value >= low)
        .when(op == "<", value < low)
        .when(op == "<=", value <= low)
        .when(op == "between", (value >= low) & (value <= high))
        .when(op == "in", among)
    )
    return F.when(op.isin(*OPERATORS) & value.isNotNull(), F.coalesce(known, F.lit(False)))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds; null if it is none."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda i, n: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long"), F.lit(0)) * n
    return F.when(text.rlike(pattern) & ~text.isin("P", "PT"), part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1))


def _measure(metric: str, columns: list[str], args: dict[str, str], accepted: list[str], as_of: str) -> Column | None:
    """The aggregate of a metric, or None for metrics that need a shuffle of their own."""
    c = F.col(f"`{columns[0]}`") if columns else None
    total = F.count(F.lit(1))
    if metric == "row_count":
        return total.cast("double")
    if metric == "null_count":
        return F.count_if(c.isNull()).cast("double")
    if metric == "null_ratio":
        return F.when(total > 0, F.count_if(c.isNull()) / total).otherwise(0.0)
    if metric == "missing_count":
        return F.count_if(c.isNull() | (c.cast("string") == "")).cast("double")
    if metric == "freshness_seconds":
        lag = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.max(c).cast("timestamp"))
        return F.coalesce(lag, F.lit(-1)).cast("double")
    if metric == "pattern_match_rate":
        return F.when(total > 0, F.count_if(c.cast("string").rlike(args.get("regex", ""))) / total).otherwise(1.0)
    if metric == "accepted_values":
        return F.count_if(c.isNotNull() & ~c.cast("string").isin(accepted)).cast("double")
    return None


def duplicate_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each key, the null key included."""
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("value"))


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key is not null and has no parent."""
    keys = parent.select(F.col(parent_key).alias("__key")).distinct()
    left = child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__key"), "left_anti")
    return left.agg(F.count("*").cast("double").alias("value"))


def value_metrics(df: DataFrame, rules: list) -> DataFrame:
    """Rows (rule_id, value) of distinct counts, duplicate ratios and percentiles of the columns they need."""
    spark = df.sparkSession
    plain = [r for r in rules if r.metric != "percentile"]
    places = [(r.rule_id, (r.columns[0], float(r.args["p"]))) for r in rules if r.metric == "percentile"]
    known = exact_percentiles(df, [k for _, k in places]) if places else {}
    out = spark.createDataFrame([(i, known[k]) for i, k in places], "rule_id string, value double")
    if plain:
        names = sorted({r.columns[0] for r in plain})
        # Rules are a short list. Distinct values leave null out, rows do not.
        asked = spark.createDataFrame([(r.rule_id, names.index(r.columns[0]), r.metric) for r in plain], "rule_id string, i int, metric string")
        both = asked.join(distinct_counts(df, list(enumerate(names))), "i").crossJoin(df.agg(F.count("*").alias("rows")))
        ratio = F.when(F.col("rows") > 0, 1 - F.col("d") / F.col("rows")).otherwise(0.0)
        out = out.unionByName(both.select("rule_id", F.when(F.col("metric") == "distinct_count", F.col("d").cast("double")).otherwise(ratio).alias("value")))
    return out


def measure_rules(tables: dict[str, DataFrame], rules: list, as_of: str) -> DataFrame | None:
    """Rows (rule_id, value): all plain metrics of a table in one aggregation, those of values by columns, the others in one each."""
    fused, alone, valued = defaultdict(list), [], defaultdict(list)
    for r in rules:
        df = tables.get(r.table_name)
        if r.problem or df is None or any(c not in df.columns for c in r.columns):
            continue
        if r.metric in ("distinct_count", "duplicate_ratio", "percentile"):
            valued[r.table_name].append(r)
            continue
        own = _measure(r.metric, r.columns, r.args, r.accepted, as_of)
        if own is not None:
            fused[r.table_name].append((r.rule_id, own))
        elif r.metric == "duplicate_count":
            alone.append((r.rule_id, duplicate_count(df, r.columns)))
        elif r.metric == "orphan_count" and r.args.get("to") in tables:
            alone.append((r.rule_id, orphan_count(df, tables[r.args["to"]], r.columns[0], r.args.get("field", r.columns[0]))))
        elif r.metric == "custom_sql":
            for name, t in tables.items():
                t.createOrReplaceTempView(name)
            one = df.sparkSession.sql(r.args["sql"])
            alone.append((r.rule_id, one.select(F.col(f"`{one.columns[0]}`").cast("double").alias("value")).limit(1)))
        elif r.metric == "row_count_drop":
            alone.append((r.rule_id, df.agg(F.count("*").cast("double").alias("value"))))
    parts = []
    for name, own in fused.items():
        wide = tables[name].agg(*[m.alias(f"m{i}") for i, (_, m) in enumerate(own)])
        parts.append(wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col(f"m{k}").cast("double").alias("value")) for k, (i, _) in enumerate(own)]))))
    parts += [value_metrics(tables[name], own) for name, own in valued.items()]
    parts += [v.select(F.lit(i).alias("rule_id"), "value") for i, v in alone]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def evaluate_rules(tables: dict[str, DataFrame], rules: DataFrame, as_of: str, baselines: DataFrame | None = None) -> DataFrame:
    """One row per rule: PASS, FAIL, ERROR (with its reason) or SKIPPED (no value or no baseline) (Q1, Q3).

    ``rules`` is a short list of rows as ``rules_from_checks`` gives them; the tables are as large as they are.
    ``baselines`` (table_name, value) holds the row counts that a drop is measured against: the expected least count
    is value * (1 - threshold / 100).
    """
    spark = rules.sparkSession
    listed = rules.collect()
    known = {r.rule_id: r.problem or ("unknown table" if r.table_name not in tables else "unknown column" if any(c not in tables[r.table_name].columns for c in r.columns) else None) for r in listed}
    problems = spark.createDataFrame(list(known.items()), "rule_id string, reason string")
    values = measure_rules(tables, listed, as_of)
    values = values if values is not None else spark.createDataFrame([], "rule_id string, value double")
    base = baselines if baselines is not None else spark.createDataFrame([], "table_name string, value double")
    joined = rules.join(problems, "rule_id").join(values, "rule_id", "left").join(base.select("table_name", F.col("value").alias("baseline")), "table_name", "left")
    drop = F.col("metric") == "row_count_drop"
    value = F.round("value", 6)
    expected = F.when(drop, F.col("baseline") * (1 - F.col("threshold") / 100)).otherwise(F.col("threshold"))
    # Without a baseline nothing is expected; that is no pass.
    passed = F.when(~drop | F.col("baseline").isNotNull(), holds(F.col("value"), F.col("op"), expected, F.col("threshold_high"), F.col("accepted")))
    status = F.when(F.col("reason").isNotNull(), "ERROR").when(passed.isNull(), "SKIPPED").when(passed, "PASS").otherwise("FAIL")
    return joined.select("rule_id", "table_name", "metric", value.alias("observed"), status.alias("status"), F.when(status == "FAIL", F.col("on_fail")).alias("action"), "reason")


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all row checks, and the others with the names of those they break; null breaks a check (Q4)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    marked = df.withColumn("broken_rules", broken)
    return marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), marked.filter(F.size("broken_rules") > 0)
