"""Anomalies, propagation, service levels, incidents and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.functions.storage import written
from trustlake.operators.graph import closure
from trustlake.operators.metadata import latest_by

SERIES = ["dataset_urn", "column_name", "metric"]
Z_LIMIT = 3.0
MIN_POINTS = 7
MIN_STATS = 4
# Severity by score, its order, and the factor that makes a MAD comparable to a standard deviation.
SEVERITY = [(8.0, "CRITICAL"), (6.0, "HIGH"), (4.5, "MEDIUM")]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "WARNING": 2, "LOW": 1}
MAD_SCALE = 1.4826
FLAT_SCORE = 9.9
EPSILON = 1e-9


def severity_of(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(SEVERITY):
        out = F.when(F.abs(score) >= least, name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    out = F.lit(0)
    for k, v in SEVERITY_RANK.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    """(x - median) / (1.4826 MAD); for a MAD of zero the relative distance times three, or +-9.9 from zero (X11)."""
    flat = F.when(F.abs(value - median) < EPSILON, F.lit(0.0)).when(F.abs(median) < EPSILON, F.signum(value - median) * FLAT_SCORE).otherwise((value - median) / F.abs(median) * 3)
    return F.when(mad < EPSILON, flat).otherwise((value - median) / (MAD_SCALE * mad))


def _middle(column: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def anomalies(series: DataFrame, as_of: str, z: float = Z_LIMIT, lookback_days: int = 90, period: int | None = None) -> DataFrame:
    """The latest point of each series against the median of the others (O1), or of those at its place in a period (O2).

    Rows: series, window_start, value, method, score, flagged, severity, skipped (why a series was not judged).
    A series needs seven points; a seasonal judgement needs four points at its place, else all are taken.
    """
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback_days} DAYS")
    own = series.filter(F.col("value_num").isNotNull() & (F.col("window_start").cast("timestamp") >= since) & (F.col("window_start").cast("timestamp") <= F.lit(as_of).cast("timestamp")))
    forward = Window.partitionBy(*SERIES).orderBy("window_start")
    whole = Window.partitionBy(*SERIES)
    own = own.withColumn("i", F.row_number().over(forward)).withColumn("n", F.count("*").over(whole)).withColumn("last", F.col("i") == F.col("n"))
    if period:
        place = (F.col("i") % period == F.col("n") % period) & ~F.col("last")
        own = own.withColumn("places", F.count_if(place).over(whole))
        own = own.withColumn("used", F.when(F.col("places") >= MIN_STATS, place).otherwise(~F.col("last")))
        method = F.when(F.col("places") >= MIN_STATS, "seasonal_mad").otherwise("mad")
    else:
        own = own.withColumn("used", ~F.col("last"))
        method = F.lit("mad")
    own = own.withColumn("method", method)
    key = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in SERIES]
    named = lambda df: df.select(*[F.col(c).alias(f"h_{c}") for c in SERIES], *[c for c in df.columns if c not in SERIES])
    history = own.filter("used")
    medians = named(history.groupBy(*SERIES).agg(_middle("value_num").alias("median"), F.count("*").alias("points")))
    apart = history.join(medians, key).select(*SERIES, F.abs(F.col("value_num") - F.col("median")).alias("away"), "median", "points")
    stats = named(apart.groupBy(*SERIES).agg(_middle("away").alias("mad"), F.first("median").alias("median"), F.first("points").alias("points")))
    latest = own.filter("last").join(stats, key, "left")
    why = F.when(F.col("n") < MIN_POINTS, "too few points").when(F.coalesce(F.col("points"), F.lit(0)) < MIN_STATS, "too little history")
    score = F.when(why.isNull(), F.round(robust_z(F.col("value_num"), F.col("median"), F.col("mad")), 6))
    out = latest.select(*SERIES, "window_start", "value_num", "method", score.alias("score"), why.alias("skipped"))
    return out.withColumn("flagged", F.coalesce(F.abs("score") > z, F.lit(False))).withColumn("severity", F.when(F.col("flagged"), severity_of(F.col("score"))))


def classify_propagation(found: DataFrame, edge: DataFrame, hops: int = 3, days: int = 1) -> DataFrame:
    """ISOLATED (no upstream), SOURCE (none of it anomalous) or PROPAGATED, with the least anomalous upstream (O3).

    Only points that are flagged as anomalies are judged, and only they make an upstream anomalous; ``anomalies`` gives
    all points that it has looked at.
    """
    found = found.filter("flagged")
    up = closure(edge, found.select(F.col("dataset_urn").alias("root")).distinct(), "up", hops).select(F.col("root").alias("dataset_urn"), F.col("urn").alias("upstream"))
    other = found.select(F.col("dataset_urn").alias("upstream"), F.col("metric").alias("o_metric"), F.col("window_start").alias("o_start"))
    hit = found.join(up, "dataset_urn").join(other, "upstream").filter((F.col("metric") == F.col("o_metric")) & (F.col("o_start") >= F.col("window_start") - F.expr(f"INTERVAL {days} DAYS")))
    hit = hit.groupBy("dataset_urn", "metric", "window_start").agg(F.min("upstream").alias("caused_by"))
    any_up = up.select("dataset_urn").distinct().withColumn("has_upstream", F.lit(True))
    out = found.join(any_up, "dataset_urn", "left").join(hit, ["dataset_urn", "metric", "window_start"], "left")
    kind = F.when(F.col("has_upstream").isNull(), "ISOLATED").when(F.col("caused_by").isNull(), "SOURCE").otherwise("PROPAGATED")
    return out.withColumn("propagation", kind).withColumn("suppressed", kind == "PROPAGATED").drop("has_upstream")


def attainment(measured: DataFrame) -> DataFrame:
    """Adds attainment, met, error_budget and no_data to rows (slo_name, target, good, total)."""
    share = F.when(F.col("total") > 0, F.round(F.col("good") / F.col("total"), 4))
    budget = F.round((1 - F.col("target")) - (1 - share), 4)
    return measured.select("slo_name", "kind", "target", "good", "total", share.alias("attainment"), F.coalesce(share >= F.col("target"), F.lit(False)).alias("met"), budget.alias("error_budget"), (F.coalesce(F.col("total"), F.lit(0)) == 0).alias("no_data"))


def measure_slo(slo: DataFrame, metrics: DataFrame, rule_runs: DataFrame, collect_runs: DataFrame, schema_events: DataFrame, as_of: str) -> DataFrame:
    """All service levels at once.

    ``slo``: slo_name, kind (freshness, pass_rate, availability, schema_stability), scope (URN prefix), target,
    threshold, days. ``metrics``: dataset_urn, value_num, window_start of freshness. ``rule_runs``: dataset_urn, status,
    started_at. ``collect_runs``: status, started_at. ``schema_events``: changed_at.
    """
    now = F.lit(as_of).cast("timestamp")
    inside = lambda c: (F.col(c).cast("timestamp") >= now - F.make_dt_interval(F.col("days"))) & (F.col(c).cast("timestamp") <= now)
    defs = lambda kind: slo.filter(F.col("kind") == kind).select("slo_name", F.coalesce("scope", F.lit("")).alias("scope"), "threshold", "days")
    sums = lambda df, good, total: df.groupBy("slo_name").agg(F.count_if(good).alias("good"), F.count_if(total).alias("total"))
    # Distinct lengths of scopes: no more than a URN has characters. They make the prefix an equal key.
    lengths = [r[0] for r in slo.select(F.length(F.coalesce("scope", F.lit("")))).distinct().collect()]

    def scoped(df: DataFrame, kind: str, time_col: str) -> DataFrame:
        keys = F.array_compact(F.array(*[F.when(F.length("dataset_urn") >= n, F.substring("dataset_urn", 1, n)) for n in lengths]))
        return df.withColumn("scope", F.explode(F.array_distinct(keys))).join(defs(kind), "scope").filter(inside(time_col))

    fresh = scoped(metrics, "freshness", "window_start")
    passed = scoped(rule_runs, "pass_rate", "started_at")
    yes = F.lit(True)

    def by_age(df: DataFrame, time_col: str, good: Column) -> DataFrame:
        """Rows (age, good, total) by whole days, rounded up, before now; at most one for each day there has been."""
        day = 86_400_000_000
        age = F.unix_micros(now) - F.unix_micros(F.col(time_col).cast("timestamp"))
        own = df.filter(age >= 0).select(F.floor((age + (day - 1)) / day).cast("long").alias("age"), good.alias("good"))
        return own.groupBy("age").agg(F.count_if("good").alias("good"), F.count("*").alias("total"))

    def within(kind: str, counts: DataFrame) -> DataFrame:
        """Each definition with the sums of the days that its window holds. Definitions and days stand in one order, and sums run over it."""
        own = defs(kind).select(F.col("days").cast("long").alias("age"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("total"), "slo_name", "days")
        both = counts.select("age", "good", "total", F.lit(None).cast("string").alias("slo_name"), F.lit(None).cast("int").alias("days")).unionByName(own)
        upto = Window.orderBy("age", F.col("slo_name").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.select("slo_name", "days", F.sum("good").over(upto).alias("good"), F.sum("total").over(upto).alias("total")).filter("slo_name IS NOT NULL")

    parts = sums(fresh, (F.col("value_num") >= 0) & (F.col("value_num") <= F.col("threshold")), yes)
    parts = parts.unionByName(sums(passed, F.col("status") == "PASS", F.col("status") != "SKIPPED"))
    runs = within("availability", by_age(collect_runs, "started_at", F.col("status") == "SUCCEEDED"))
    parts = parts.unionByName(runs.filter("total > 0").drop("days"))
    stable = within("schema_stability", by_age(schema_events.filter("changed_at IS NOT NULL"), "changed_at", yes))
    parts = parts.unionByName(stable.select("slo_name", F.greatest(F.lit(0), F.col("days") - F.col("total")).cast("long").alias("good"), F.col("days").cast("long").alias("total")))
    return attainment(slo.join(parts, "slo_name", "left"))


def open_incidents(found: DataFrame, incidents: DataFrame, edge: DataFrame, hops: int = 3, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """One new incident per anomalous dataset without an open one, with its worst severity; and the assets affected.

    The dataset itself is affected too, at depth 0. Affected assets are rows (dataset_urn, urn, depth), since a hub may
    have any number of them. URNs may be numbers in all three tables; ``stored`` is as in ``closure``.
    """
    held = incidents.filter(F.col("status").isin("OPEN", "MITIGATING")).select("dataset_urn")
    new = found.filter("flagged").join(held, "dataset_urn", "left_anti")
    worst = new.groupBy("dataset_urn").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("anomalies"))
    worst = written(worst, "incidents")
    roots = worst.select(F.col("dataset_urn").alias("root"))
    down = closure(edge, roots, "down", hops, stored).unionByName(roots.select("root", F.col("root").alias("urn"), F.lit(0).alias("depth")))
    affected = down.select(F.col("root").alias("dataset_urn"), "urn", "depth")
    counted = affected.groupBy("dataset_urn").agg(F.count("*").alias("affected"))
    return worst.join(counted, "dataset_urn").select("dataset_urn", "severity", "anomalies", "affected", F.lit("OPEN").alias("status")), affected


def incident_overview(incidents: DataFrame) -> DataFrame:
    """Per severity: counts, hours to resolve, and resolved incidents that no rule closed."""
    hours = (F.unix_timestamp(F.col("resolved_at").cast("timestamp")) - F.unix_timestamp(F.col("opened_at").cast("timestamp"))) / 3600
    done = F.col("resolved_at").isNotNull()
    without = done & (F.coalesce(F.col("closing_rule"), F.lit("")) == "")
    return incidents.groupBy("severity").agg(F.count("*").alias("incidents"), F.count_if(~done).alias("open"), F.round(F.avg(hours), 3).alias("mttr_hours"), F.round(F.max(hours), 3).alias("longest_hours"), F.count_if(without).alias("without_rule"))


def resolve_incidents(incidents: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidents after actions, and the actions that are refused, with the reason.

    ``incidents``: incident_id, status, resolved_at, closing_rule. ``actions``: incident_id, event_type (RESOLVED or any
    other, which only goes into the timeline), occurred_at, closing_rule, no_rule_reason. A resolution needs a rule that
    came out of the incident or a reason why none is needed; the last legal one holds.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    resolves = F.col("event_type") == "RESOLVED"
    known = incidents.select("incident_id", F.lit(True).alias("known"))
    why = F.when(F.col("known").isNull(), "no such incident").when(resolves & blank("closing_rule") & blank("no_rule_reason"), "a rule or a reason is needed")
    judged = actions.join(known, "incident_id", "left").withColumn("reason", why)
    last = judged.filter(resolves & F.col("reason").isNull()).groupBy("incident_id").agg(F.max_by(F.struct("occurred_at", "closing_rule"), "occurred_at").alias("last"))
    out = incidents.join(last, "incident_id", "left")
    done = F.col("last").isNotNull()
    out = out.withColumns({"status": F.when(done, "RESOLVED").otherwise(F.col("status")), "resolved_at": F.when(done, F.col("last.occurred_at")).otherwise(F.col("resolved_at")), "closing_rule": F.when(done, F.col("last.closing_rule")).otherwise(F.col("closing_rule"))})
    return out.drop("last"), judged.filter("reason IS NOT NULL").select("incident_id", "event_type", "occurred_at", "reason")


def incident_timeline(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each incident in order, with the hours since it began: rows (incident_id, place, event_type, occurred_at, hours).

    ``incidents``: incident_id, opened_at. ``events``: incident_id, event_type, occurred_at.
    """
    order = Window.partitionBy("incident_id").orderBy("occurred_at", "event_type")
    hours = (F.unix_timestamp(F.col("occurred_at").cast("timestamp")) - F.unix_timestamp(F.col("opened_at").cast("timestamp"))) / 3600
    own = events.join(incidents.select("incident_id", "opened_at"), "incident_id")
    return own.select("incident_id", F.row_number().over(order).alias("place"), "event_type", "occurred_at", F.round(hours, 3).alias("hours"))


def alert_candidates(state: DataFrame, schedules: DataFrame, as_of: str, failures: int = 3, stale_hours: int = 48) -> DataFrame:
    """Conditions that call for an alert (O7): rows (dedup_key, source, kind, severity).

    ``state``: source, namespace, consecutive_failures, last_status, last_success_at. ``schedules``: source, namespace,
    enabled, last_status; one that is enabled and has no last status has never succeeded.
    """
    row = lambda df, kind, severity: df.select(F.concat_ws(":", F.lit(kind), "namespace", "source").alias("dedup_key"), "source", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    stale = F.col("last_success_at").cast("timestamp") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {stale_hours} HOURS")
    parts = [
        row(state.filter(F.col("consecutive_failures") >= failures), "failing", "CRITICAL"),
        row(state.filter("last_status = 'BLOCKED'"), "blocked", "WARNING"),
        row(state.filter(stale), "stale", "WARNING"),
        row(schedules.filter("enabled AND last_status IS NULL"), "never_succeeded", "WARNING"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile_alerts(candidates: DataFrame, alerts: DataFrame, as_of: str, remind_seconds: float = 12 * 3600, cooldown_seconds: float = 300) -> DataFrame:
    """What an evaluation does to each alert: FIRED, UPDATED, REMINDED or RESOLVED.

    ``alerts``: dedup_key, severity, state (FIRING or RESOLVED), first_fired_at, notified_at, resolved_at, fire_count;
    of a key at most one row is FIRING. Each evaluation of a firing alert counts. It is reminded of when the last
    notification (else the first firing) is ``remind_seconds`` old. A key that resolved less than ``cooldown_seconds``
    ago is only UPDATED, marked as flapping.
    """
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    firing = F.col("state") == "FIRING"
    new = candidates.groupBy("dedup_key").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))
    old = alerts.groupBy("dedup_key").agg(
        F.max(F.when(firing, F.struct(F.lit(True).alias("is"), F.col("severity").alias("severity"), F.coalesce(seconds("notified_at"), seconds("first_fired_at")).alias("told"), F.col("fire_count").alias("n")))).alias("live"),
        F.max(F.when(~firing, seconds("resolved_at"))).alias("resolved"),
        F.max_by("fire_count", F.when(~firing, seconds("resolved_at"))).alias("last_count"),
    )
    j = new.join(old, "dedup_key", "full_outer")
    live, called = F.col("live").isNotNull(), F.col("severity").isNotNull()
    flapping = called & ~live & F.coalesce(now - F.col("resolved") < cooldown_seconds, F.lit(False))
    due = F.coalesce(now - F.col("live.told") >= remind_seconds, F.lit(True))
    action = F.when(~called, F.when(live, "RESOLVED")).when(flapping, "UPDATED").when(~live, "FIRED").when(due, "REMINDED").otherwise("UPDATED")
    count = F.when(~called, F.col("live.n")).when(live, F.col("live.n") + 1).when(flapping, F.col("last_count")).otherwise(1)
    out = j.select("dedup_key", F.coalesce("severity", "live.severity").alias("severity"), action.alias("action"), count.alias("fire_count"), flapping.alias("flapping"))
    return out.filter("action IS NOT NULL")


def route_alerts(actions: DataFrame, channels: DataFrame) -> DataFrame:
    """Alerts to the channels whose least severity they reach.

    Channels are joined by the ranks that they take, so that the join is on equal keys.
    """
    taken = channels.withColumn("rank", F.explode(F.sequence(severity_rank(F.col("min_severity")), F.lit(max(SEVERITY_RANK.values()))))).select("channel", "rank")
    return actions.withColumn("rank", severity_rank(F.col("severity"))).join(taken, "rank").select("channel", "dedup_key", "severity", "action")


def latest_metric(metrics: DataFrame) -> DataFrame:
    """The latest value of each series."""
    return latest_by(metrics, SERIES, "window_start")
