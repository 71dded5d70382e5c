"""Lineage as an edge list: closure, impact, subgraph, paths, statements, reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.functions.storage import discard, written
from trustlake.operators.metadata import EDGE_KEY

# The edge types that are lineage, parse confidence, and the weights of an impact.
LINEAGE_TYPES = ["derivesFrom", "consumedBy"]
CONFIDENCE = {"exact": 0.8, "derived": 0.65, "table_level_only": 0.5, "failed": 0.0}
CLASS_WEIGHT = {"L1": 0.3, "L2": 0.5, "L3": 0.8, "L4": 1.0}
CRITICAL_TAGS = ["critical", "tier1", "tier-1", "p0", "core", "关键", "核心"]
COLUMN_PREFIX = "urn:asset:Column:"
DECAY = 0.7
MAX_IMPACT_DEPTH, MAX_SUBGRAPH_DEPTH = 10, 5


def eligible_edges(edge: DataFrame, min_confidence: float = 0.0, include_control: bool = False, states: tuple = ("ACTIVE",), types: list[str] | None = None) -> DataFrame:
    """Edges that a lineage walk may take."""
    out = edge.filter(F.col("state").isin(*states) & (F.col("confidence") >= min_confidence) & F.col("edge_type").isin(*(types or LINEAGE_TYPES)))
    return out if include_control else out.filter("dependency_kind = 'VALUE'")


#: Roots whose bits share one row of a node, and the most roots that have such rows.
_BITS = 64
_FEW_ROOTS = 1000
#: Rows of a hop that are sent to all edges, and edges or rows of a hop that one task joins or adds up.
_SENT_ROWS = 100_000
_TASK_ROWS = 1_000_000


def _hop(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """A written hop and its rows, which are counted as they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def numbered(roots: DataFrame) -> DataFrame:
    """Few distinct roots as rows (root, block, bit): 64 roots of a block share a number."""
    rows = [(r.root, i // _BITS, 1 << i % _BITS if i % _BITS < 63 else -(1 << 63)) for i, r in enumerate(sorted(roots.collect()))]
    return roots.sparkSession.createDataFrame(rows, f"root {roots.schema['root'].dataType.simpleString()}, block long, bit long")


def closure(edge: DataFrame, roots: DataFrame, direction: str = "down", max_depth: int | None = 10, stored: bool = False) -> DataFrame:
    """Nodes within ``max_depth`` hops of each root, with the least depth: rows (root, urn, depth), roots left out (G1).

    A row of a hop is a node with the bits of up to 64 roots that reach it there for the first time, so a hop does not
    multiply by the roots (if they are few); bits met before are taken out in the same aggregation, so cycles end. Hops are written and
    counted: a small one is sent to the edges, which stay where they are; else both are dealt out in parts that grow in
    number with the edges and the hop, so a task's memory does not grow with them. ``None`` goes on to the end. ``stored``
    says that ``edge`` is a table (with filters at most), which need not be written again.
    """
    near, far = ("from_urn", "to_urn") if direction == "down" else ("to_urn", "from_urn")
    steps = edge.select(F.col(near).alias("urn"), F.col(far).alias("next"))
    steps, edges = (steps, steps.count()) if stored else _hop(steps, "steps")
    own, asked = _hop(roots.select("root").distinct(), "roots")
    if asked > min(_FEW_ROOTS, _SENT_ROWS):
        return _closure_of_many(steps, edges, own, asked, max_depth, stored)
    names = numbered(own)
    start = names.groupBy(F.col("root").alias("urn"), "block").agg(F.bit_or("bit").alias("bits"))
    frontier, n = _hop(start, "hop")
    hops, before, rows = [], frontier, n
    while max_depth is None or len(hops) < max_depth:
        parts = -(-(edges + rows) // _TASK_ROWS)
        dealt = lambda df, *keys: df.repartition(parts, *keys)
        if n <= _SENT_ROWS:
            met = steps.join(F.broadcast(frontier), "urn")
        else:
            met = dealt(frontier, "urn").hint("merge").join(dealt(steps, "urn"), "urn")
        met = met.select(F.col("next").alias("urn"), "block", "bits", F.lit(0).cast("long").alias("old"))
        both = met.unionByName(before.select("urn", "block", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old")))
        # A few rows more may be met than there are edges, if roots of several blocks meet; most edges are not met in one hop.
        both = dealt(both, "urn", "block") if parts > 1 and n > _SENT_ROWS else both
        own = both.groupBy("urn", "block").agg(F.bit_or("bits").bitwiseAND(F.bitwise_not(F.bit_or("old"))).alias("bits")).filter("bits != 0")
        frontier, n = _hop(own, "hop")
        if not n:
            break
        hops.append(frontier.withColumn("depth", F.lit(len(hops) + 1)))
        before, rows = before.unionByName(frontier), rows + n
    if not stored:
        discard(steps)
    if not hops:
        return names.select("root", F.col("root").alias("urn"), F.lit(0).alias("depth")).filter("false")
    found = reduce(DataFrame.unionByName, hops)
    # Few roots have few blocks, so their rows are not dealt out by block.
    return found.join(F.broadcast(names), "block").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("root", "urn", "depth")


def _closure_of_many(steps: DataFrame, edges: int, roots: DataFrame, asked: int, max_depth: int | None, stored: bool) -> DataFrame:
    """``closure`` of many roots, which seldom meet: a row is a root and a node, so nothing is joined to name the roots.

    The last hop has by far the most rows. It is not written, but is the result, with the hops before it: a node's least
    depth is found where its rows are met with those before.
    """
    frontier, n = roots.select("root", F.col("root").alias("urn")), asked
    seen, rows, depth = frontier.withColumn("depth", F.lit(0)), asked, 0
    while max_depth is None or depth < max_depth:
        depth, parts = depth + 1, -(-(edges + rows) // _TASK_ROWS)
        dealt = lambda df, *keys: df.repartition(parts, *keys)
        met = F.broadcast(frontier).join(steps, "urn") if n <= _SENT_ROWS else dealt(frontier, "urn").hint("merge").join(dealt(steps, "urn"), "urn")
        # More rows are met than there are edges, if roots meet.
        both = met.select("root", F.col("next").alias("urn"), F.lit(depth).alias("depth")).unionByName(seen).repartition(2 * parts, "root", "urn")
        least = both.groupBy("root", "urn").agg(F.min("depth").alias("depth"))
        if depth == max_depth:
            seen = least
            break
        new, n = _hop(least.filter(F.col("depth") == depth), "hop")
        if not n:
            if not stored:
                discard(steps)
            break
        frontier, seen, rows = new.select("root", "urn"), seen.unionByName(new), rows + n
    return seen.filter("depth > 0").select("root", "urn", "depth")


def edges_in(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges with both ends among ``urn`` of nodes."""
    n = nodes.select("urn").distinct()
    return edge.join(n, F.col("from_urn") == F.col("urn"), "left_semi").join(n, F.col("to_urn") == F.col("urn"), "left_semi")


def impact_weight(level: Column, critical: Column, owner: Column, out_degree: Column) -> Column:
    """.40 class (L2 where it is not known) + .25 (1 if critical, else .4) + .15 (.9 without an owner) + .20 min(1, log10(1 + n) / 2)."""
    grade = F.lit(CLASS_WEIGHT["L2"])
    for k, v in CLASS_WEIGHT.items():
        grade = F.when(F.upper(level) == k, v).otherwise(grade)
    spread = F.least(F.lit(1.0), F.log10(1 + F.coalesce(out_degree, F.lit(0))) / 2)
    return 0.40 * grade + 0.25 * F.when(critical, 1.0).otherwise(0.4) + 0.15 * F.when(owner.isNull(), 0.9).otherwise(1.0) + 0.20 * spread


def impact(edge: DataFrame, asset: DataFrame, roots: DataFrame, depth: int = 3, min_confidence: float = 0.0, direction: str = "down", include_columns: bool = False, stored: bool = False) -> DataFrame:
    """Assets that depend on each root (or, with ``direction="up"``, that it depends on), with a score that falls by 0.7 a hop.

    Columns: root, urn, depth, entity_type (Unknown where there is no such asset), downstream (active edges out of the
    node, of any kind), score, reasons, critical (class L4 or a critical tag), boundary (at the last depth with more
    beyond). ``asset``: urn, entity_type, classification, owner, tag.
    """
    depth = max(1, min(depth, MAX_IMPACT_DEPTH))
    reached = closure(eligible_edges(edge, min_confidence), roots, direction, depth, stored)
    if not include_columns:
        reached = reached.filter(~F.col("urn").startswith(COLUMN_PREFIX))
    degree = edge.filter("state = 'ACTIVE'").groupBy(F.col("from_urn").alias("urn")).agg(F.count("*").alias("downstream"))
    own = asset.select("urn", "entity_type", "classification", "owner", "tag").dropDuplicates(["urn"])
    out = reached.join(own, "urn", "left").join(degree, "urn", "left").withColumn("downstream", F.coalesce("downstream", F.lit(0)))
    tagged = F.coalesce(F.lower("tag").isin(CRITICAL_TAGS), F.lit(False))
    score = F.round(impact_weight(F.col("classification"), tagged, F.col("owner"), F.col("downstream")) * F.pow(F.lit(DECAY), F.col("depth")), 3)
    says = F.array_compact(
        F.array(
            F.concat(F.lit("level "), F.col("classification")),
            F.when(tagged, F.lit("critical tag")),
            F.when(F.col("owner").isNull(), F.lit("no owner")),
            F.when(F.col("downstream") > 0, F.concat(F.lit("downstream "), F.col("downstream"))),
        )
    )
    critical = tagged | F.coalesce(F.upper("classification") == "L4", F.lit(False))
    boundary = (F.col("depth") == depth) & (F.col("downstream") > 0)
    return out.select("root", "urn", "depth", F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"), "downstream", score.alias("score"), says.alias("reasons"), critical.alias("critical"), boundary.alias("boundary"))


def impact_summary(found: DataFrame) -> DataFrame:
    """Per root and entity type: assets, critical ones, boundary ones and the highest score."""
    return found.groupBy("root", "entity_type").agg(F.count("*").alias("assets"), F.count_if("critical").alias("critical"), F.count_if("boundary").alias("boundary"), F.max("score").alias("highest"))


def subgraph(edge: DataFrame, focus: DataFrame, depth: int = 2, node_limit: int = 200, include_control: bool = False, include_columns: bool = True, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes around each focus (both directions, capped by depth and URN, the focus first), their edges, and counts.

    Without columns, a walk goes over them but they are not among the nodes, unless one is the focus itself.
    """
    depth = max(1, min(depth, MAX_SUBGRAPH_DEPTH))
    walk = eligible_edges(edge, 0.0, include_control, ("ACTIVE", "STALE"))
    both = closure(walk, focus, "down", depth, stored).unionByName(closure(walk, focus, "up", depth, stored))
    nodes = both.groupBy("root", "urn").agg(F.min("depth").alias("depth")).filter("urn != root")
    nodes = nodes if include_columns else nodes.filter(~F.col("urn").startswith(COLUMN_PREFIX))
    nodes = nodes.unionByName(focus.select("root", F.col("root").alias("urn"), F.lit(0).alias("depth")).distinct())
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("depth", "urn")))
    kept = ranked.filter(F.col("rank") <= node_limit)
    counts = ranked.groupBy("root").agg(F.count("*").alias("found"), F.least(F.count("*"), F.lit(node_limit)).alias("kept"), (F.count("*") > node_limit).alias("truncated"))
    ends = kept.select("root", "urn")
    inner = walk.join(ends.withColumnRenamed("urn", "from_urn"), "from_urn").join(ends.withColumnRenamed("urn", "to_urn"), ["root", "to_urn"])
    return kept.select("root", "urn", "depth", (F.col("depth") == depth).alias("boundary")), inner.select("root", "from_urn", "to_urn", "edge_type", "confidence", "state", "dependency_kind").distinct(), counts


def shortest_paths(edge: DataFrame, pairs: DataFrame, max_depth: int = 12, min_confidence: float = 0.0) -> DataFrame:
    """A shortest path by hops for each (source, target): hops, path, weakest confidence; found is false without one.

    All pairs are searched at once from both ends, each time from the side with fewer nodes at its edge; a pair is done
    when a node has been reached from both. From the nodes where they met the way to the target is marked over the levels
    of the other side. Of equal paths, at each node the one from the least parent is kept, with the strongest edge between
    the two.
    """
    keys = ["source", "target"]
    steps = written(edge.filter((F.col("state") == "ACTIVE") & (F.col("confidence") >= min_confidence)).groupBy("from_urn", "to_urn").agg(F.max("confidence").alias("c")), "steps")
    asked = written(pairs.select(*keys).distinct(), "pairs")
    # Levels of either side: (source, target, at, parent), the parent only on the way from the source.
    ends = {"down": F.col("source"), "up": F.col("target")}
    levels = {side: [_hop(asked.select(*keys, end.alias("at"), F.lit(None).cast("string").alias("parent")), "hop")] for side, end in ends.items()}
    seen = {side: own[0][0].select(*keys, "at") for side, own in levels.items()}
    met = [asked.filter("source = target").select(*keys, F.col("source").alias("at"), F.lit(0).alias("i"), F.lit(0).alias("j"))]
    while True:
        done = reduce(DataFrame.unionByName, met).select(*keys).distinct()
        i, j = (len(levels[side]) - 1 for side in ("down", "up"))
        if i + j >= max_depth or not (levels["down"][-1][1] and levels["up"][-1][1]):
            break
        side = min(levels, key=lambda s: levels[s][-1][1])
        other = "up" if side == "down" else "down"
        near, far = ("from_urn", "to_urn") if side == "down" else ("to_urn", "from_urn")
        going = levels[side][-1][0].join(done, keys, "left_anti").select(*keys, F.col("at").alias("parent"))
        step = going.join(steps, F.col("parent") == F.col(near)).groupBy(*keys, F.col(far).alias("at")).agg(F.min("parent").alias("parent"))
        new, n = _hop(step.join(seen[side], [*keys, "at"], "left_anti"), "hop")
        levels[side].append((new, n))
        seen[side] = seen[side].unionByName(new.select(*keys, "at"))
        i, j = (len(levels[s]) - 1 for s in ("down", "up"))
        # Nodes that were met from the other side before its last level would have been met before.
        meeting, n = _hop(new.select(*keys, "at").join(levels[other][-1][0].select(*keys, "at"), [*keys, "at"], "left_semi").withColumns({"i": F.lit(i), "j": F.lit(j)}), "met")
        if n:
            met.append(meeting)
    found = reduce(DataFrame.unionByName, met)
    # The way from where they met to the target: level by level, least parents first.
    marked, parents = found, []
    for left in range(len(levels["up"]) - 1, 0, -1):
        # What has ``left`` levels to go, or more, waits for its turn.
        turn = marked.filter(F.col("j") == left)
        level = levels["up"][left - 1][0].select(*keys, "at")
        step = turn.select(*keys, F.col("at").alias("parent"), "i", "j").join(steps, F.col("parent") == F.col("from_urn")).join(level.withColumnRenamed("at", "to_urn"), [*keys, "to_urn"])
        own = written(step.groupBy(*keys, F.col("to_urn").alias("at")).agg(F.min("parent").alias("parent"), (F.first("i") + 1).alias("i"), (F.first("j") - 1).alias("j")), "marked")
        parents.append(own.select(*keys, "at", "parent", F.col("i").alias("k")))
        marked = marked.filter(F.col("j") < left).unionByName(own.select(*keys, "at", "i", "j"))
    parents += [own.select(*keys, "at", "parent").withColumn("k", F.lit(k)) for k, (own, _) in enumerate(levels["down"]) if k]
    hops = found.groupBy(*keys).agg(F.max(F.col("i") + F.col("j")).alias("hops"))
    path = written(hops.select(*keys, "hops", F.col("hops").alias("k"), F.col("target").alias("at"), F.array("target").alias("path")), "paths")
    if parents:
        # Beyond the node where they met, marked parents stand for those of a search from the source alone.
        up = written(reduce(DataFrame.unionByName, parents).join(hops.select(*keys), keys, "left_semi"), "parents")
        for _ in range(len(levels["down"]) + len(levels["up"]) - 2):
            path = path.join(up, [*keys, "at", "k"], "left").select(*keys, "hops", (F.col("k") - 1).alias("k"), F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path"))
    path = written(path.select(*keys, "hops", "path"), "paths")
    each = path.filter("hops > 0").select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.col("hops")), lambda n: F.struct(F.get("path", n - 1).alias("from_urn"), F.get("path", n).alias("to_urn")))).alias("e"))
    weakest = each.select(*keys, "e.*").join(steps, ["from_urn", "to_urn"]).groupBy(*keys).agg(F.min("c").alias("c"))
    out = asked.join(path, keys, "left").join(weakest, keys, "left")
    confidence = F.when(F.col("hops") == 0, 1.0).otherwise(F.col("c"))
    return out.select(*keys, F.col("hops").isNotNull().alias("found"), "hops", "path", confidence.alias("confidence"))


def cascade_delete(edge: DataFrame, entity: DataFrame, roots: DataFrame) -> DataFrame:
    """``entity`` (urn, lifecycle) with the roots and all that they contain tombstoned."""
    parts = closure(edge.filter("edge_type = 'contains'"), roots, "down", None).select("urn").union(roots.select("root")).distinct().withColumn("gone", F.lit(True))
    return entity.join(parts, "urn", "left").withColumn("lifecycle", F.when(F.col("gone"), "TOMBSTONE").otherwise(F.col("lifecycle"))).drop("gone")


def transform_kind(expression: Column) -> Column:
    """MASKED, AGGREGATED, INDIRECT or DIRECT, from an expression's text."""
    x = F.lower(expression)
    return (
        F.when(x.rlike(r"\b(mask|sha1|sha2|sha256|md5|hash|encrypt|redact)\w*\s*\("), "MASKED")
        .when(x.rlike(r"\b(sum|count|avg|min|max|stddev|variance|percentile|array_agg|collect_list|collect_set)\w*\s*\("), "AGGREGATED")
        .when(x.rlike(r"[-+*/|(]|\bcase\b"), "INDIRECT")
        .otherwise("DIRECT")
    )


def parse_confidence(level: Column) -> Column:
    """Confidence by how far a statement could be parsed."""
    out = F.lit(0.0)
    for k, v in CONFIDENCE.items():
        out = F.when(level == k, v).otherwise(out)
    return out


def expand_star(stmts: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SELECT * over sources of known columns as column edges of confidence .65; sources without columns as findings.

    ``stmts``: stmt_id, target, sources. ``columns``: table_name, column_name.
    """
    each = stmts.select("stmt_id", "target", F.explode("sources").alias("table_name"))
    edges = each.join(columns, "table_name").select("stmt_id", F.concat_ws(".", "table_name", "column_name").alias("from_column"), F.concat_ws(".", "target", "column_name").alias("to_column"), F.lit(0.65).alias("confidence"))
    return edges, each.join(columns.select("table_name").distinct(), "table_name", "left_anti").select("stmt_id", "table_name", F.lit("missing_schema").alias("finding"))


def disambiguate(refs: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unqualified columns: an edge of confidence .6 if exactly one source has it, else a finding with the candidates.

    ``refs``: stmt_id, target, column_name, sources.
    """
    each = refs.select("stmt_id", "target", "column_name", F.explode("sources").alias("table_name"))
    hits = each.join(columns, ["table_name", "column_name"]).groupBy("stmt_id", "target", "column_name").agg(F.sort_array(F.collect_set("table_name")).alias("candidates"))
    all_refs = refs.select("stmt_id", "target", "column_name").distinct().join(hits, ["stmt_id", "target", "column_name"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    one = F.size("candidates") == 1
    edges = all_refs.filter(one).select("stmt_id", F.concat_ws(".", F.col("candidates")[0], "column_name").alias("from_column"), F.concat_ws(".", "target", "column_name").alias("to_column"), F.lit(0.6).alias("confidence"))
    return edges, all_refs.filter(~one).select("stmt_id", "column_name", "candidates", F.when(F.size("candidates") == 0, "unknown_column").otherwise("ambiguous_column").alias("finding"))


def apply_reviews(edge: DataFrame, actions: DataFrame, keys: list[str] = EDGE_KEY, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges after their reviews, and the reviews that were refused, with the reason.

    CONFIRM makes an edge ACTIVE at a confidence of .99 or more and notes who confirmed it. REJECT keeps it as REJECTED, with
    who rejected it and why; without a reason it is refused, as is a review of an edge that is not there. An edge is what
    ``keys`` name, its two ends first. Confidence stays raised after a later rejection. ``actions``: keys, action, reason,
    actor, seq. ``dealt`` says that both tables have been dealt out alike by the two ends, so that they meet where they are.
    """
    ends, rest = keys[:2], keys[2:]
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    wrong = F.when(~F.col("action").isin("CONFIRM", "REJECT"), "unknown action").when((F.col("action") == "REJECT") & blank, "a rejection needs a reason")
    if not dealt:
        parts = max(1, -(-edge.count() // _TASK_ROWS))
        edge, actions = edge.repartition(parts, *ends), actions.repartition(parts, *ends)
    # Few edges have the same ends, so those that are known, and the reviews, come as one array for two ends.
    same = lambda r: reduce(Column.__and__, [r[c] == F.col(c) for c in rest])
    known = edge.groupBy(*ends).agg(F.collect_set(F.struct(*rest)).alias("__known"))
    there = F.coalesce(F.exists("__known", same), F.lit(False))
    judged = actions.join(known, ends, "left").withColumn("problem", F.when(~there, "no such edge").otherwise(wrong)).drop("__known")
    # Whether there is such an edge shows when edges are joined, so edges are dealt out once, and the few reviewed ones meet them unsorted.
    valid = actions.filter(wrong.isNull())
    by = lambda c, action: F.max_by(c, F.when(F.col("action") == action, F.col("seq")))
    notes = {"confirmed_by": by("actor", "CONFIRM"), "rejected_by": by("actor", "REJECT"), "reject_reason": by("reason", "REJECT")}
    last = valid.groupBy(*keys).agg(F.max_by("action", "seq").alias("action"), F.bool_or(F.col("action") == "CONFIRM").alias("confirmed"), *[c.alias(name) for name, c in notes.items()])
    reviews = last.groupBy(*ends).agg(F.collect_list(F.struct(*rest, "action", "confirmed", *notes)).alias("__reviews"))
    out = edge.join(reviews.hint("shuffle_hash"), ends, "left").withColumn("__own", F.get(F.filter("__reviews", same), F.lit(0)))
    action = F.col("__own.action")
    raised = F.when(F.col("__own.confirmed"), F.greatest("confidence", F.lit(0.99))).otherwise(F.col("confidence"))
    out = out.withColumn("state", F.when(action == "CONFIRM", "ACTIVE").when(action == "REJECT", "REJECTED").otherwise(F.col("state"))).withColumn("confidence", raised)
    out = out.withColumns({name: F.coalesce(f"__own.{name}", name) if name in edge.columns else F.col(f"__own.{name}") for name in notes})
    return out.select(*keys, *[c for c in edge.columns if c not in keys], *[c for c in notes if c not in edge.columns]), judged.filter("problem IS NOT NULL")


def retire_edges(edge: DataFrame, edge_type: str, reason: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges after all of a type (and source) that are not rejected yet have been retired to REJECTED, with the reason, and how many were."""
    if not (edge_type or "").strip() or not (reason or "").strip():
        raise ValueError("retiring edges needs a type and a reason")
    hit = (F.col("edge_type") == edge_type) & (F.col("state") != "REJECTED")
    hit = hit if source is None else hit & (F.col("source") == source)
    before = F.col("retire_reason") if "retire_reason" in edge.columns else F.lit(None).cast("string")
    return edge.withColumn("retire_reason", F.when(hit, F.lit(reason)).otherwise(before)).withColumn("state", F.when(hit, "REJECTED").otherwise(F.col("state"))), edge.agg(F.count_if(hit).alias("retired"))


LOW_CONFIDENCE = 0.7


def waits_for_review(edge: DataFrame) -> Column:
    """Whether an edge is pending, or active, under the confidence of 0.7, not made by hand and not confirmed by anyone."""
    confirmed = F.coalesce(F.col("confirmed_by"), F.lit("")) if "confirmed_by" in edge.columns else F.lit("")
    low = (F.col("state") == "ACTIVE") & (F.col("confidence") < LOW_CONFIDENCE) & (F.col("source") != "manual") & (confirmed == "")
    return (F.col("state") == "PENDING_REVIEW") | low


def review_health(edge: DataFrame, findings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row: edges, pending ones, unconfirmed ones of low confidence, the days that the oldest has waited, and findings of the last days.

    ``edge`` has first_seen and, if anyone confirms, confirmed_by. ``findings``: occurred_at.
    """
    now = F.lit(as_of).cast("timestamp")
    waits = waits_for_review(edge)
    oldest = F.min(F.when(waits, F.col("first_seen").cast("timestamp")))
    counts = edge.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("state") == "PENDING_REVIEW").alias("pending_review"),
        F.count_if(waits & (F.col("state") == "ACTIVE")).alias("low_confidence_unconfirmed"),
        F.round((F.unix_timestamp(now) - F.unix_timestamp(oldest)) / 86400, 1).alias("oldest_waiting_days"),
    )
    window = max(1, min(days, 3650))
    # Both sides are one row.
    return counts.crossJoin(findings.filter(F.col("occurred_at").cast("timestamp") >= now - F.expr(f"INTERVAL {window} DAYS")).agg(F.count("*").alias("open_findings")))


def review_queue(edge: DataFrame, limit: int = 50) -> DataFrame:
    """What to review next: pending first, then the least confident, then the oldest."""
    pending = F.when(F.col("state") == "PENDING_REVIEW", 0).otherwise(1)
    return edge.filter("state != 'REJECTED'").orderBy(pending, "confidence", "k", "from_urn", "to_urn").limit(max(1, min(limit, 500)))


def lineage_health(edge: DataFrame) -> DataFrame:
    """Edge counts by state, source, parse level and pair of types, in one pass."""
    kind = lambda c: F.split(F.col(c), ":")[0]
    own = edge.select("state", "source", "parse_level", F.concat_ws(">", kind("from_urn"), kind("to_urn")).alias("pair"))
    dims = ["state", "source", "parse_level", "pair"]
    counted = own.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.coalesce(*[F.when(F.col("g") == (15 ^ (8 >> i)), d) for i, d in enumerate(dims)])
    return counted.select(name.alias("dimension"), F.coalesce(*dims).alias("value"), "n")


def statement_edges(stmts: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of statements that are parsed already, and the names that could not be resolved.

    ``stmts``: stmt_id, target, sources array<string>, controls array<string>, parse_level, columns
    array<struct<source,source_column,target_column,expression>>. ``resolved``: name, urn (null where not unique). Table
    edges have the confidence of the parse level; what only steers a statement is a CONTROL dependency.
    """
    named = lambda kind, c: stmts.select("stmt_id", "target", "parse_level", F.explode_outer(c).alias("name"), F.lit(kind).alias("dependency_kind")).filter("name IS NOT NULL")
    tables = named("VALUE", "sources").unionByName(named("CONTROL", "controls"))
    to = resolved.select(F.col("name").alias("target"), F.col("urn").alias("to_urn"))
    frm = resolved.select("name", F.col("urn").alias("from_urn"))
    joined = tables.join(to, "target", "left").join(frm, "name", "left")
    both = F.col("to_urn").isNotNull() & F.col("from_urn").isNotNull()
    edges = joined.filter(both & (F.col("parse_level") != "failed")).select("stmt_id", "from_urn", "to_urn", "dependency_kind", F.lit("DIRECT").alias("transform"), parse_confidence(F.col("parse_level")).alias("confidence"))
    cols = stmts.select("stmt_id", "target", "parse_level", F.inline("columns")).withColumnRenamed("source", "name").join(to, "target").join(frm, "name").filter(both)
    column = lambda urn, c: F.concat(F.lit("urn:asset:Column:"), F.split_part(F.col(urn), F.lit(":"), F.lit(4)), F.lit("."), F.col(c))
    edges = edges.unionByName(cols.select("stmt_id", column("from_urn", "source_column").alias("from_urn"), column("to_urn", "target_column").alias("to_urn"), F.lit("VALUE").alias("dependency_kind"), transform_kind(F.col("expression")).alias("transform"), parse_confidence(F.col("parse_level")).alias("confidence")))
    missing = joined.filter("from_urn IS NULL").select("stmt_id", "name").union(joined.filter("to_urn IS NULL").select("stmt_id", F.col("target").alias("name"))).distinct()
    return edges.distinct(), missing


def findings_summary(findings: DataFrame) -> DataFrame:
    """Findings by kind: those that a schema or an owner can settle, and those whose SQL must change."""
    fixable = F.col("finding").isin("missing_schema", "unknown_column")
    return findings.groupBy("finding").agg(F.count("*").alias("n"), F.count_if(fixable).alias("actionable"), F.count_if(~fixable).alias("needs_sql_fix"))


def overview(df: DataFrame, *dimensions: str, top: int | None = None) -> DataFrame:
    """Counts by each dimension in one pass, the ``top`` most frequent of each if given."""
    full = (1 << len(dimensions)) - 1
    counted = df.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.coalesce(*[F.when(F.col("g") == (full ^ (1 << (len(dimensions) - 1 - i))), d) for i, d in enumerate(dimensions)])
    out = counted.select(name.alias("dimension"), F.coalesce(*[F.col(d).cast("string") for d in dimensions]).alias("value"), "n")
    if top is None:
        return out
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank")
