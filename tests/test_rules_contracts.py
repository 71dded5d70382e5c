"""Contract verdicts, gates, type changes and ledgers on rows made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trustlake.functions import text, types
from trustlake.operators import contracts

FIELD = "contract_id int, field string, type string, required boolean, nullable boolean, semantic string"
META = "contract_id int, version string, primary_key array<string>, quality_rules int, sla string"
ID = ("id", "bigint", True, None, None)


def diff(spark, old, new, old_version="1.2.0", new_version="1.2.0", old_meta=(["id"], 1, "PT24H"), new_meta=(["id"], 1, "PT24H")):
    fields = lambda rows: spark.createDataFrame([(1, *r) for r in rows or []], FIELD)
    meta = lambda version, m: spark.createDataFrame([(1, version, *m)], META)
    before = meta(old_version, old_meta) if old is not None else meta("", old_meta).limit(0)
    args = fields(old), fields(new), before, meta(new_version, new_meta)
    found = {(r.change, r.level) for r in contracts.contract_changes(*args).collect()}
    return contracts.contract_diff(*args).first(), found


def test_first_version_is_initial(spark):
    row, found = diff(spark, None, [ID])
    assert (row.verdict, row.changes, row.bump_sufficient) == ("INITIAL", 0, True) and not found


def test_breaking_changes_block_even_with_a_major_bump(spark):
    row, found = diff(spark, [ID, ("a", "int", None, True, None)], [ID], new_version="2.0.0")
    assert found == {("column_removed", 3)} and row.verdict == "BLOCK" and row.bump_sufficient and row.needed == 3
    row, found = diff(spark, [ID, ("a", "int", None, True, None)], [ID], new_version="1.3.0")
    assert found == {("column_removed", 3), ("version_bump_insufficient", 3)} and not row.bump_sufficient and row.breaking == 2


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (("a", "bigint", None, True, None), ("a", "int", None, True, None), ("type_changed", 3)),
        (("a", "int", None, True, None), ("a", "bigint", None, True, None), ("type_widened", 2)),
        (("a", "date", None, True, None), ("a", "timestamp", None, True, None), ("type_widened", 2)),
        (("a", "text", None, True, None), ("a", "varchar(3)", None, True, None), ("type_widened", 2)),
        (("a", None, None, True, None), ("a", "int", None, True, None), ("type_widened", 2)),
        (("a", "int", False, None, None), ("a", "int", True, None, None), ("nullability_tightened", 3)),
        (("a", "int", None, False, None), ("a", "int", None, True, None), ("nullability_relaxed", 2)),
        (("a", "int", None, True, "gross"), ("a", "int", None, True, "net"), ("semantic_changed", 3)),
        (("a", "int", None, True, "gross"), ("a", "int", None, True, None), ("semantic_changed", 3)),
    ],
)
def test_field_changes(spark, old, new, want):
    row, found = diff(spark, [ID, old], [ID, new], new_version="2.0.0")
    assert found == {want} and row.verdict == ("BLOCK" if want[1] == 3 else "WARN")


def test_new_semantics_keys_and_terms_without_an_old_one_are_no_change(spark):
    row, found = diff(spark, [ID, ("a", "int", None, True, None)], [ID, ("a", "int", None, True, "net")], old_meta=(None, 1, None), new_meta=(["id"], 2, "PT1H"))
    assert not found and row.verdict == "PASS"


def test_added_columns_and_contract_terms(spark):
    row, found = diff(spark, [ID], [ID, ("a", "int", True, None, None), ("b", "int", None, True, None)], new_version="2.0.0")
    assert found == {("column_added", 3), ("column_added", 2)} and row.verdict == "BLOCK"
    row, found = diff(spark, [ID], [ID], new_version="1.3", old_meta=(["id"], 2, "PT24H"), new_meta=(["id"], 1, "PT1H"))
    assert found == {("quality_weakened", 2), ("sla_changed", 2)} and row.verdict == "WARN" and row.bump_sufficient
    assert diff(spark, [ID], [ID], new_version="2.0.0", new_meta=(["id", "x"], 1, "PT24H"))[1] == {("primary_key_changed", 3)}
    assert ("version_bump_insufficient", 3) in diff(spark, [ID], [ID, ("b", "int", None, True, None)], new_version="next")[1]


def gate(spark, breaking=0, enough=True, verdict="WARN", assets=0, owner="o", description="d", level="L2", consumers=0, **policy):
    row = spark.createDataFrame([(1, breaking, enough, verdict)], "contract_id int, breaking int, bump_sufficient boolean, verdict string")
    down = spark.createDataFrame([(1, assets)], "contract_id int, assets int")
    own = spark.createDataFrame([(1, owner, description, level)], "contract_id int, owner string, description string, classification string")
    und = spark.createDataFrame([(1, consumers)], "contract_id int, consumers int")
    r = contracts.gate(row, down, own, und, policy).first()
    return r.gate, r.blocking, r.warnings


def test_gate_defaults_and_options(spark):
    assert gate(spark) == ("PASS", [], [])
    assert gate(spark, owner=None) == ("WARN", [], ["no owner"])
    assert gate(spark, owner=None, require_owner=True) == ("BLOCK", ["no owner"], [])
    assert gate(spark, 1, verdict="BLOCK", assets=7) == ("BLOCK", ["breaking change"], ["downstream bears the change"])
    assert gate(spark, 1, verdict="BLOCK", allow_breaking=True) == ("WARN", [], ["breaking change"])
    assert gate(spark, 1, verdict="BLOCK", assets=7, allow_breaking=True, max_downstream_for_breaking=6)[1] == ["too many downstream for a breaking change"]
    assert gate(spark, 1, False, "BLOCK", allow_breaking=True)[1] == ["version bump insufficient"]
    assert gate(spark, consumers=2) == ("WARN", [], ["consumers not registered"])
    assert gate(spark, consumers=2, verdict="INITIAL", require_no_undetected_consumers=True) == ("PASS", [], [])


def test_ledger_never_closes_and_reopens_what_expired(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("open", "OPEN", 1, t(1), None), ("ack", "ACKNOWLEDGED", 1, t(1), None), ("over", "EXEMPTED", 1, t(1), t(9)), ("held", "EXEMPTED", 1, t(1), t(30)), ("done", "RESOLVED", 4, t(1), None)]
    ledger = spark.createDataFrame(rows, "hash string, status string, occurrences long, last_seen timestamp_ntz, exempted_until timestamp_ntz")
    new = spark.createDataFrame([("done",), ("done",), ("held",), ("fresh",)], "hash string")
    got = {r.hash: (r.status, r.occurrences, r.last_seen.day) for r in contracts.merge_violations(ledger, new, "2024-01-20 00:00:00").collect()}
    assert got == {"open": ("OPEN", 1, 1), "ack": ("ACKNOWLEDGED", 1, 1), "over": ("OPEN", 1, 1), "held": ("EXEMPTED", 2, 20), "done": ("RESOLVED", 6, 20), "fresh": ("OPEN", 1, 20)}


def test_type_capabilities(spark):
    want = {
        "BIGINT": ("numeric", True, True), "numeric(10,2)": ("numeric", True, True), "double precision": ("numeric", True, True), "interval": ("numeric", True, True),
        "timestamp(3) with time zone": ("temporal", True, True), "varchar(20)": ("string", True, True), "text[]": ("string", True, True), "boolean": ("boolean", True, True),
        "uuid": ("uuid", False, True), "jsonb": ("json", False, False), "xml": ("other", False, False), "bytea": ("binary", False, True), "geometry": ("other", False, True), None: ("other", False, True),
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", types.type_caps(F.col("t")).alias("c")).collect()
    assert {r.t: tuple(r.c) for r in df} == want


def test_type_changes_by_family(spark):
    cases = [
        ("int", "bigint", "widened"), ("integer", "int", "narrowed"), ("bigint", "decimal(10,2)", "widened"), ("double", "real", "narrowed"), ("float", "double", "changed"),
        ("text", "char(3)", "widened"), ("bool", "boolean", "widened"), ("date", "timestamp with time zone", "widened"), ("timestamp", "date", "narrowed"), ("time", "timestamp", "narrowed"),
        ("json", "array<int>", "changed"), ("int", "text", "changed"), ("numeric(3)", "NUMERIC(5)", "same"), (None, "int", "widened"), (None, None, "same"), ("geometry", "point", "changed"),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want string").withColumn("got", types.type_change(F.col("a"), F.col("b")))
    assert [(r.a, r.b, r.got) for r in df.collect()] == cases


def test_sensitive_names(spark):
    hit = ["user_phone", "EMAIL", "id_card", "idcard_no", "passwd", "Password1", "api_secret", "token", "ssn", "bank_id", "card_no", "客户姓名", "登录密码", "身份证号"]
    miss = ["salary", "birth", "address", "passport", "idx", "工资", "name"]
    got = spark.createDataFrame([(n,) for n in hit + miss], "n string").filter(text.is_sensitive_name(F.col("n"))).collect()
    assert [r.n for r in got] == hit
