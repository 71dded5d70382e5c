"""Data contracts: diff, validation, violation ledger, gate, consumers, model compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions.types import normal_type, type_change
from trustlake.operators.graph import closure

MAJOR, MINOR, PATCH, NONE = 3, 2, 1, 0
# What a gate asks for, and the most downstream assets that a breaking change may have (0: any number).
GATE_POLICY = {
    "require_owner": False,
    "require_description": False,
    "require_classification": False,
    "require_no_undetected_consumers": False,
    "max_downstream_for_breaking": 0,
    "allow_breaking": False,
}


def version_parts(version: Column) -> Column:
    """(major, minor, patch) of two or three numbers, the patch 0 where it is not there; else null."""
    p = F.split(F.trim(version), r"\.")
    return F.when(F.trim(version).rlike(r"^\d+\.\d+(\.\d+)?$"), F.struct(p[0].try_cast("int").alias("major"), p[1].try_cast("int").alias("minor"), F.coalesce(F.try_element_at(p, F.lit(3)).try_cast("int"), F.lit(0)).alias("patch")))


def bump(old: Column, new: Column) -> Column:
    """The highest part of a version that went up: 3 major, 2 minor, 1 patch, 0 none; null if either is no version."""
    a, b = version_parts(old), version_parts(new)
    up = F.when(b["major"] > a["major"], MAJOR).when(b["minor"] > a["minor"], MINOR).when(b["patch"] > a["patch"], PATCH).otherwise(NONE)
    return F.when(a.isNotNull() & b.isNotNull(), up)


def is_required(required: Column, nullable: Column) -> Column:
    return F.coalesce(required, ~nullable, F.lit(False))


def _change(cond: Column, name: str, level: Column | int) -> Column:
    return F.when(cond, F.struct(F.lit(name).alias("change"), (F.lit(level) if isinstance(level, int) else level).alias("level")))


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of fields between two versions of all contracts: rows (contract_id, field, change, level).

    Fields: contract_id, field, type, required, nullable, semantic.
    """
    mine = lambda df, p: df.select("contract_id", "field", *[F.col(c).alias(f"{p}_{c}") for c in ("type", "required", "nullable", "semantic")], F.lit(True).alias(p))
    both = mine(old, "old").join(mine(new, "new"), ["contract_id", "field"], "full_outer")
    gone, fresh = F.col("new").isNull(), F.col("old").isNull()
    was, now = is_required(F.col("old_required"), F.col("old_nullable")), is_required(F.col("new_required"), F.col("new_nullable"))
    kind, stays = type_change(F.col("old_type"), F.col("new_type")), ~gone & ~fresh
    changes = F.array_compact(
        F.array(
            _change(gone, "column_removed", MAJOR),
            _change(fresh, "column_added", F.when(now, MAJOR).otherwise(MINOR)),
            _change(stays & (kind == "widened"), "type_widened", MINOR),
            _change(stays & kind.isin("narrowed", "changed"), "type_changed", MAJOR),
            _change(stays & ~was & now, "nullability_tightened", MAJOR),
            _change(stays & was & ~now, "nullability_relaxed", MINOR),
            _change(stays & F.col("old_semantic").isNotNull() & ~F.col("old_semantic").eqNullSafe(F.col("new_semantic")), "semantic_changed", MAJOR),
        )
    )
    return both.select("contract_id", "field", F.inline(changes))


def contract_changes(old: DataFrame, new: DataFrame, old_meta: DataFrame, new_meta: DataFrame) -> DataFrame:
    """All changes between two versions of all contracts: rows (contract_id, field, change, level).

    Meta: contract_id, version, primary_key array<string>, quality_rules (a count), sla. A contract without an old
    version has no changes. A version that goes up by less than the changes ask for is a change of its own.
    """
    side = lambda df, p: df.select("contract_id", *[F.col(c).alias(f"{p}_{c}") for c in ("version", "primary_key", "quality_rules", "sla")])
    both = side(old_meta, "old").join(side(new_meta, "new"), "contract_id")
    key = lambda p: F.coalesce(F.col(f"{p}_primary_key"), F.array().cast("array<string>"))
    checks = lambda p: F.coalesce(F.col(f"{p}_quality_rules"), F.lit(0))
    own = F.array_compact(
        F.array(
            _change((F.size(key("old")) > 0) & (key("old") != key("new")), "primary_key_changed", MAJOR),
            _change(checks("new") < checks("old"), "quality_weakened", MINOR),
            _change(F.col("old_sla") != F.col("new_sla"), "sla_changed", MINOR),
        )
    )
    whole = F.lit(None).cast("string").alias("field")
    found = field_changes(old, new).join(both.select("contract_id"), "contract_id", "left_semi").unionByName(both.select("contract_id", whole, F.inline(own)))
    needed = found.groupBy("contract_id").agg(F.max("level").alias("needed"))
    made = F.coalesce(bump(F.col("old_version"), F.col("new_version")), F.lit(NONE))
    short = both.join(needed, "contract_id").filter(made < F.col("needed")).select("contract_id", whole, F.lit("version_bump_insufficient").alias("change"), F.lit(MAJOR).alias("level"))
    return found.unionByName(short)


def contract_diff(old: DataFrame, new: DataFrame, old_meta: DataFrame, new_meta: DataFrame) -> DataFrame:
    """One verdict per contract: INITIAL, PASS, WARN, or BLOCK for any breaking change.

    Columns: contract_id, needed (the bump that the changes ask for), bump_sufficient, changes, breaking (counts, a bump
    that is too small among them), verdict.
    """
    bad = F.col("change") == "version_bump_insufficient"
    found = contract_changes(old, new, old_meta, new_meta)
    sums = found.groupBy("contract_id").agg(F.max(F.when(~bad, F.col("level"))).alias("needed"), F.count_if(bad).alias("short"), F.count("*").alias("changes"), F.count_if(F.col("level") == MAJOR).alias("breaking"))
    out = new_meta.select("contract_id").join(old_meta.select("contract_id", F.lit(True).alias("had")), "contract_id", "left").join(sums, "contract_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = F.when(F.col("had").isNull(), "INITIAL").when(number("breaking") > 0, "BLOCK").when(number("changes") > 0, "WARN").otherwise("PASS")
    return out.select("contract_id", number("needed").alias("needed"), (number("short") == 0).alias("bump_sufficient"), number("changes").alias("changes"), number("breaking").alias("breaking"), verdict.alias("verdict"))


def validate_contracts(fields: DataFrame, actual: DataFrame, freshness: DataFrame | None = None) -> DataFrame:
    """Violations of contracts by actual schemas: rows (contract_id, field, kind, detail).

    ``fields``: contract_id, field, type, required, nullable, sla_seconds. ``actual``: contract_id, field, type,
    nullable. ``freshness``: contract_id, seconds.
    """
    want = fields.select("contract_id", "field", F.col("type").alias("want_type"), is_required(F.col("required"), F.col("nullable")).alias("must"), F.lit(True).alias("wanted"))
    have = actual.select("contract_id", "field", F.col("type").alias("have_type"), F.col("nullable").alias("may_null"), F.lit(True).alias("there"))
    both = want.join(have, ["contract_id", "field"], "full_outer")
    hit = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    on = F.col("wanted").isNotNull() & F.col("there").isNotNull()
    found = F.array_compact(
        F.array(
            hit(F.col("there").isNull(), "missing_column", F.col("want_type")),
            hit(on & (normal_type(F.col("want_type")) != normal_type(F.col("have_type"))), "type_mismatch", F.concat_ws(">", "want_type", "have_type")),
            hit(on & F.col("must") & F.col("may_null"), "nullability", F.col("have_type")),
            hit(F.col("wanted").isNull(), "unexpected_column", F.col("have_type")),
        )
    )
    out = both.select("contract_id", "field", F.inline(found))
    if freshness is None:
        return out
    late = fields.groupBy("contract_id").agg(F.max("sla_seconds").alias("sla")).join(freshness, "contract_id").filter("seconds > sla")
    return out.unionByName(late.select("contract_id", F.lit(None).cast("string").alias("field"), F.lit("sla_breach").alias("kind"), F.col("sla").cast("string").alias("detail")))


def merge_violations(ledger: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """The ledger after a run: one row per content hash, occurrences added up.

    ``ledger``: hash, status (OPEN, ACKNOWLEDGED, EXEMPTED, RESOLVED), occurrences, last_seen, exempted_until. ``new``:
    hash. A run never closes or reopens a row by itself; an exemption whose time is up is OPEN again, seen or not.
    """
    now = F.lit(as_of).cast("timestamp")
    both = ledger.join(new.groupBy("hash").agg(F.count("*").alias("n")), "hash", "full_outer")
    over = (F.col("status") == "EXEMPTED") & (F.col("exempted_until").cast("timestamp") < now)
    status = F.when(F.col("status").isNull() | F.coalesce(over, F.lit(False)), "OPEN").otherwise(F.col("status"))
    again = F.col("n").isNotNull()
    return both.select("hash", status.alias("status"), (F.coalesce("occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"), F.when(again, now.cast("timestamp_ntz")).otherwise(F.col("last_seen").cast("timestamp_ntz")).alias("last_seen"))


def gate(diff: DataFrame, downstream: DataFrame, governance: DataFrame, undetected: DataFrame, policy: dict | None = None) -> DataFrame:
    """BLOCK, WARN or PASS for each contract's change, with what blocks and what warns (C4).

    ``downstream``: contract_id, assets. ``governance``: contract_id, owner, description, classification.
    ``undetected``: contract_id, consumers. ``policy``: what differs from GATE_POLICY.
    """
    p = GATE_POLICY | (policy or {})
    j = diff.join(downstream, "contract_id", "left").join(governance, "contract_id", "left").join(undetected, "contract_id", "left")
    breaking, assets, initial = F.col("breaking") > 0, F.coalesce("assets", F.lit(0)), F.col("verdict") == "INITIAL"
    # Whether it blocks, the condition, and what is said.
    findings = [
        (not p["allow_breaking"], breaking, "breaking change"),
        (True, ~F.col("bump_sufficient"), "version bump insufficient"),
        (False, breaking & (assets > 0), "downstream bears the change"),
        (True, breaking & (assets > p["max_downstream_for_breaking"]) & F.lit(p["max_downstream_for_breaking"] > 0), "too many downstream for a breaking change"),
        (p["require_owner"], F.col("owner").isNull(), "no owner"),
        (p["require_description"], F.col("description").isNull(), "no description"),
        (p["require_classification"], F.col("classification").isNull(), "no classification"),
        (p["require_no_undetected_consumers"], ~initial & (F.coalesce("consumers", F.lit(0)) > 0), "consumers not registered"),
    ]
    said = lambda blocks: F.array_compact(F.array(*[F.when(cond, F.lit(text)) for own, cond, text in findings if own == blocks]))
    block, warn = said(True), said(False)
    return j.select("contract_id", F.when(F.size(block) > 0, "BLOCK").when(F.size(warn) > 0, "WARN").otherwise("PASS").alias("gate"), block.alias("blocking"), warn.alias("warnings"))


def consumer_report(contracts: DataFrame, registered: DataFrame, edge: DataFrame, hops: int = 3, down: DataFrame | None = None) -> DataFrame:
    """Consumers that lineage shows but nobody registered (undetected), and registered ones it does not show (stale).

    ``contracts``: contract_id, dataset_urn. ``registered``: contract_id, consumer. ``down``: the closure of the datasets, if
    it is there already.
    """
    down = down if down is not None else closure(edge, contracts.select(F.col("dataset_urn").alias("root")).distinct(), "down", hops)
    actual = contracts.join(down, F.col("dataset_urn") == F.col("root")).select("contract_id", F.col("urn").alias("consumer")).distinct()
    keys = ["contract_id", "consumer"]
    new = actual.join(registered.select(*keys), keys, "left_anti").withColumn("finding", F.lit("undetected"))
    return new.unionByName(registered.select(*keys).distinct().join(actual, keys, "left_anti").withColumn("finding", F.lit("stale")))


def model_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of a metadata model, breaking or not (C7): definitions (type_name, attribute, kind, required, enum_values)."""
    mine = lambda df, p: df.select("type_name", "attribute", F.col("kind").alias(f"{p}_kind"), F.col("required").alias(f"{p}_required"), F.col("enum_values").alias(f"{p}_enum"), F.lit(True).alias(p))
    both = mine(old, "old").join(mine(new, "new"), ["type_name", "attribute"], "full_outer")
    gone, fresh = F.col("new").isNull(), F.col("old").isNull()
    lost = F.size(F.array_except(F.coalesce("old_enum", F.array().cast("array<string>")), F.coalesce("new_enum", F.array().cast("array<string>"))))
    change = lambda cond, name, breaking: F.when(cond, F.struct(F.lit(name).alias("change"), F.lit(breaking).alias("breaking")))
    found = F.array_compact(
        F.array(
            change(gone, "attribute_removed", True),
            change(fresh & F.col("new_required"), "required_attribute_added", True),
            change(fresh & ~F.col("new_required"), "optional_attribute_added", False),
            change(F.col("old_kind") != F.col("new_kind"), "kind_changed", True),
            change(~F.col("old_required") & F.col("new_required"), "became_required", True),
            change(F.col("old_required") & ~F.col("new_required"), "became_optional", False),
            change(~gone & ~fresh & (lost > 0), "enum_values_removed", True),
        )
    )
    return both.select("type_name", "attribute", F.inline(found))
