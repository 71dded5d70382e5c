"""Policies as DataFrame transforms: visibility, row filters, masks, deny, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels in order, the highest that a role sees, and row-filter operators.
LEVELS = ["L1", "L2", "L3", "L4"]
ROLE_LEVEL = {"ADMIN": "L4", "STEWARD": "L4", "EDITOR": "L3", "READER": "L3"}
OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def visible_levels(roles: list[str]) -> list[str]:
    """Levels up to the highest of the roles, and always L2, which is also what a missing level counts as."""
    top = max([LEVELS.index(ROLE_LEVEL[r]) for r in roles if r in ROLE_LEVEL], default=0)
    return sorted({*LEVELS[: top + 1], "L2"})


def visible(df: DataFrame, roles: list[str], level_col: str = "classification") -> DataFrame:
    """Rows that the roles may see; goes first, so that counts and facets hold nothing else (F1)."""
    return df.filter(F.coalesce(F.col(level_col), F.lit("L2")).isin(visible_levels(roles)))


def row_filter(policy: dict, user: str) -> Column:
    """The condition of a row-filter policy (column, operator, value); unknown operators are refused (F2)."""
    c, op, value = F.col(f"`{policy['column']}`"), policy["operator"], policy.get("value")
    if op in OPERATORS:
        return OPERATORS[op](c, F.lit(value))
    if op == "IN":
        return c.isin(list(value))
    if op == "IS_NULL":
        return c.isNull()
    if op == "IS_NOT_NULL":
        return c.isNotNull()
    if op == "CURRENT_USER":
        return c == F.lit(user)
    raise ValueError(f"unknown row-filter operator {op}")


def mask(c: Column, kind: str, constant: str = "***") -> Column:
    """null, hash, constant, partial (two characters and ****) or year."""
    if kind == "null":
        return F.lit(None)
    if kind == "hash":
        return F.upper(F.sha2(c.cast("string"), 256))
    if kind == "constant":
        return F.lit(constant)
    if kind == "partial":
        return F.concat(F.substring(c.cast("string"), 1, 2), F.lit("****"))
    if kind == "year":
        return F.date_trunc("year", c)
    raise ValueError(f"unknown mask {kind}")


def applies(policy: dict, subject: dict) -> bool:
    """Whether a policy's roles, users or teams name the subject; a policy without any names all."""
    names = [(policy.get(k) or [], subject.get(s)) for k, s in (("roles", "roles"), ("users", "user"), ("teams", "teams"))]
    if not any(own for own, _ in names):
        return True
    return any(set(own) & set([held] if isinstance(held, str) else held or []) for own, held in names)


def apply_policies(df: DataFrame, policies: list[dict], subject: dict) -> DataFrame:
    """Row filters, masks and denials of a subject, by priority; of two masks of a column the first holds."""
    masked: set[str] = set()
    masks: dict[str, Column] = {}
    for p in sorted((p for p in policies if applies(p, subject)), key=lambda p: (-p.get("priority", 0), p["id"])):
        if p["kind"] == "deny":
            df = df.filter(F.lit(False))
        elif p["kind"] == "row_filter":
            df = df.filter(row_filter(p, subject.get("user", "")))
        elif p["kind"] == "mask" and p["column"] not in masked:
            masked.add(p["column"])
            kind = df.schema[p["column"]].dataType
            own = mask(F.col(f"`{p['column']}`"), p["mask"], p.get("constant", "***"))
            masks[p["column"]] = own.cast(kind) if p["mask"] in ("null", "year") else own
    return df.withColumns(masks)


def policy_coverage(assets: DataFrame, policies: DataFrame) -> DataFrame:
    """Each asset with how many policies cover it: all their selectors fit, and one besides the table is there.

    ``assets``: urn, classification (L2 where it is null), domain. ``policies``: policy_id, prefixes array<string>,
    table_name, classifications array<string>, domains array<string>; null or empty where a policy does not select by it.
    Levels and domains compare without case; a table fits a URN that ends in it or in its last part, behind a dot.

    A policy is looked up by one kind of its selectors (prefixes, else levels, else domains), so the join is on equal
    keys; URNs have a key for each length that a prefix has.
    """
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    upper = lambda c: F.transform(c, lambda x: F.upper(x))
    keys = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    p = policies.select("policy_id", "prefixes", "table_name", upper("classifications").alias("levels"), upper("domains").alias("domains"))
    anchor = F.when(some("prefixes"), keys("p:", F.col("prefixes"))).when(some("levels"), keys("l:", F.col("levels"))).when(some("domains"), keys("d:", F.col("domains")))
    looked_up = p.withColumn("key", F.explode(F.array_distinct(anchor)))
    # Distinct lengths of prefixes: no more than a URN has characters.
    lengths = [r[0] for r in policies.select(F.explode("prefixes").alias("x")).select(F.length("x")).distinct().collect() if r[0]]
    level = F.coalesce(F.upper("classification"), F.lit("L2"))
    cut = [F.when(F.length("urn") >= n, F.concat(F.lit("p:"), F.substring("urn", 1, n))) for n in lengths]
    own = assets.select("urn", level.alias("level"), F.upper("domain").alias("domain")).distinct()
    each = own.withColumn("key", F.explode(F.array_compact(F.array(*cut, F.concat(F.lit("l:"), "level"), F.concat(F.lit("d:"), "domain")))))
    ends = lambda name: F.col("urn").endswith(F.concat(F.lit("."), name))
    fits_table = F.col("table_name").isNull() | ends(F.col("table_name")) | ends(F.element_at(F.split("table_name", r"\."), -1))
    fits_level = ~some("levels") | F.array_contains("levels", F.col("level"))
    fits_domain = ~some("p_domains") | F.coalesce(F.array_contains("p_domains", F.col("domain")), F.lit(False))
    met = each.join(looked_up.withColumnRenamed("domains", "p_domains"), "key")
    hits = met.filter(fits_table & fits_level & fits_domain).select("urn", "policy_id").distinct()
    n = hits.groupBy("urn").agg(F.count("*").alias("policies"))
    return assets.join(n, "urn", "left").select("urn", "classification", F.coalesce("policies", F.lit(0)).alias("policies"), F.col("policies").isNotNull().alias("covered"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Per level: assets, covered ones and their share; levels are null where an asset has none."""
    return covered.groupBy("classification").agg(F.count("*").alias("assets"), F.count_if("covered").alias("covered"), F.round(F.count_if("covered") / F.count("*"), 4).alias("ratio"))
