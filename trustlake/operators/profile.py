"""Table profiles: one pass for all columns (A1 to A5)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trustlake.functions import types as kinds

SENSITIVE = ("L3", "L4")
TOP = 5
PERCENTILES = (0.5, 0.95)


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def distinct_counts(df: DataFrame, fields: list[tuple[int, str]]) -> DataFrame:
    """Rows (i, d): the exact number of distinct values of each column, by its place. Each column is read and grouped for itself, and nothing but a number leaves the groups."""
    each = [df.select(F.col(f"`{name}`").alias("v")).filter("v IS NOT NULL").distinct().agg(F.count("*").alias("d")).select(F.lit(i).alias("i"), "d") for i, name in fields]
    return reduce(DataFrame.unionByName, each)


#: Size of a KLL sketch (ranks within about 0.2 %), how far beside a rank its bracket reaches, and distinct values in a bracket that are put in order.
_SKETCH, _MARGIN, _BRACKET = 2000, 0.005, 1_000_000


def exact_percentiles(df: DataFrame, wanted: list[tuple[str, float]]) -> dict[tuple[str, float], float | None]:
    """Percentiles of number columns: rank p * (count - 1), between neighbours in proportion.

    A sketch brackets each rank; one pass counts what lies below and inside of the brackets; brackets of more than a million
    values are narrowed by sketches of what is inside; then only values inside are grouped and ordered. So no task holds a
    column's values, and a column is shuffled for none of its percentiles. None for a column without values.
    """
    keys = list(dict.fromkeys(wanted))
    value = lambda name: (F.col(f"`{name}`") + F.lit(0)).cast("double")
    count = dict(zip(keys, df.agg(*[F.count(value(n)).alias(f"k{i}") for i, (n, _) in enumerate(keys)]).first()))
    at = {k: k[1] * (count[k] - 1) for k in keys if count[k]}
    bracket: dict = {k: (-math.inf, math.inf, 0, count[k]) for k in at}
    margin = dict.fromkeys(at, _MARGIN)
    while wide := [k for k, (low, high, _, inside) in bracket.items() if low < high and inside > _BRACKET // 1000 and (inside > _BRACKET or low == -math.inf)]:
        # Percentiles of one column that have the same bracket so far, at first all, share a sketch.
        groups: dict = {}
        for k in wide:
            below, inside = bracket[k][2:]
            place = [min(1.0, max(0.0, (r(at[k]) - below) / inside + m)) for r, m in ((math.floor, -margin[k]), (math.ceil, margin[k]))]
            groups.setdefault((k[0], bracket[k]), []).append((k, place))
        aggs = []
        for (name, (low, high, _, _)), own in groups.items():
            v = value(name)
            inner = v if low == -math.inf else F.when((v >= low) & (v <= high), v)
            sketch = F.kll_sketch_agg_double(inner, _SKETCH)
            aggs.append(F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(p)) for _, place in own for p in place]))
        ends = {}
        for own, got in zip(groups.values(), df.agg(*[a.alias(f"k{i}") for i, a in enumerate(aggs)]).first()):
            ends |= {k: tuple(got[2 * n : 2 * n + 2]) for n, (k, _) in enumerate(own)}
        counts = []
        for k in wide:
            v, (low, high) = value(k[0]), ends[k]
            counts += [F.count_if(v < low), F.count_if((v >= low) & (v <= high))]
        found = list(df.agg(*[c.alias(f"k{i}") for i, c in enumerate(counts)]).first())
        for k, below, inside in zip(wide, found[::2], found[1::2]):
            if below <= math.floor(at[k]) and math.ceil(at[k]) < below + inside:
                narrower = inside < bracket[k][3]
                bracket[k] = (*ends[k], below, inside if narrower or ends[k][0] == ends[k][1] else min(inside, _BRACKET))
            else:
                # The sketch was further off than it says.
                margin[k] = min(1.0, margin[k] * 10)
    out: dict = {k: bracket[k][0] if k in bracket and bracket[k][0] == bracket[k][1] else None for k in keys}
    left = [k for k in at if out[k] is None]
    if left:
        cells = F.array(*[F.when((value(k[0]) >= bracket[k][0]) & (value(k[0]) <= bracket[k][1]), F.struct(F.lit(i).alias("i"), value(k[0]).alias("v"))) for i, k in enumerate(left)])
        inside = df.select(F.inline(F.array_compact(cells))).groupBy("i", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
        asked = [(i, bracket[k][2], math.floor(at[k]), math.ceil(at[k])) for i, k in enumerate(left)]
        places = df.sparkSession.createDataFrame(asked, "i int, below long, f long, c long")
        each = inside.withColumn("upto", upto).join(F.broadcast(places), "i").withColumns({"last": F.col("below") + F.col("upto") - 1, "first": F.col("below") + F.col("upto") - F.col("n")})
        here = lambda c: F.max(F.when((F.col("first") <= F.col(c)) & (F.col(c) <= F.col("last")), F.col("v"))).alias(c)
        for r in each.groupBy("i").agg(here("f"), here("c")).collect():
            k = left[r.i]
            out[k] = r.f + (r.c - r.f) * (at[k] - math.floor(at[k]))
    return out


def profile(df: DataFrame, classification: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """Long rows (column_name, metric, value_num, value_text, precision) of all columns.

    Counts, extremes and lengths take one aggregation of one row. Distinct counts are exact and take a grouping of each
    column more, percentiles some passes without a shuffle of values (``exact_percentiles``); with ``exact=False`` both
    are sketches in the same one pass, marked ESTIMATED. Minimum and maximum of sensitive columns are left out.
    """
    classification = classification or {}
    aggs, rows, fields = [F.count(F.lit(1)).alias("__total")], [], []
    numbers = [f.name for f in df.schema.fields if kinds.is_numeric(f.dataType)]
    places = exact_percentiles(df, [(n, p) for n in numbers for p in PERCENTILES]) if exact and numbers else {}
    how = "EXACT" if exact else "ESTIMATED"
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        n = f"__{i}"
        aggs.append(F.count(c).alias(f"{n}_n"))
        total, n_col = F.col("__total"), F.col(f"{n}_n")
        num = lambda metric, v, p="EXACT": rows.append((f.name, metric, rounded(v), F.lit(None).cast("string"), p))  # noqa: B023, E731
        text = lambda metric, v: rows.append((f.name, metric, F.lit(None).cast("double"), v, "EXACT"))  # noqa: B023, E731
        num("total", total)
        num("non_null", n_col)
        num("null_count", total - n_col)
        num("null_ratio", F.when(total > 0, (total - n_col) / total).otherwise(0.0))
        if kinds.equatable(f.dataType):
            fields.append((i, f.name))
            if not exact:
                aggs.append(F.hll_sketch_estimate(F.hll_sketch_agg(c.cast("string"), F.lit(14))).alias(f"{n}_d"))
            num("distinct_count", F.try_element_at("__distinct", F.lit(i)) if exact else F.col(f"{n}_d"), how)
        if kinds.orderable(f.dataType) and classification.get(f.name, "L2") not in SENSITIVE:
            # Adding zero makes a negative zero a plain one, so that the text does not depend on the order of rows.
            value = c + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
            aggs += [F.min(value).cast("string").alias(f"{n}_min"), F.max(value).cast("string").alias(f"{n}_max")]
            text("min", F.col(f"{n}_min"))
            text("max", F.col(f"{n}_max"))
        if f.dataType.typeName() == "string":
            aggs += [F.min(F.length(c)).alias(f"{n}_short"), F.max(F.length(c)).alias(f"{n}_long")]
            num("min_length", F.col(f"{n}_short"))
            num("max_length", F.col(f"{n}_long"))
        if kinds.is_numeric(f.dataType):
            for p in PERCENTILES:
                name = f"p{int(p * 100)}"
                if not exact:
                    aggs.append(F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double((c + F.lit(0)).cast("double"), _SKETCH), F.lit(p)).alias(f"{n}_{name}"))
                num(name, F.lit(places.get((f.name, p))) if exact else F.col(f"{n}_{name}"), how)
    struct = [F.struct(F.lit(a).alias("column_name"), F.lit(m).alias("metric"), v.alias("value_num"), t.alias("value_text"), F.lit(p).alias("precision")) for a, m, v, t, p in rows]
    wide = df.agg(*aggs)
    if exact and fields:
        distinct = distinct_counts(df, fields).agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("__distinct"))
        # Both sides are one row.
        wide = wide.crossJoin(distinct)
    return wide.select(F.inline(F.array(*struct)))


def row_counts(df: DataFrame, estimate: int | None = None) -> DataFrame:
    """The exact row count and, if a catalog has one, its estimate, in rows of their own (A2)."""
    out = df.agg(F.count(F.lit(1)).cast("double").alias("value_num")).select(F.lit("row_count").alias("metric"), "value_num", F.lit("EXACT").alias("precision"))
    if estimate is not None:
        out = out.union(df.sparkSession.createDataFrame([("row_count_estimate", float(estimate), "ESTIMATED")], out.schema))
    return out


def top_values(df: DataFrame, k: int = TOP, classification: dict[str, str] | None = None) -> DataFrame:
    """The k most frequent non-null values of each column that is not sensitive, ties by value (A3)."""
    classification = classification or {}
    names = [c for c in df.columns if classification.get(c, "L2") not in SENSITIVE]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    counted = df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def freshness(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """Seconds from the latest value to ``as_of``; -1 for an empty table (A4)."""
    lag = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.max(F.col(column)).cast("timestamp"))
    return df.agg(F.coalesce(lag, F.lit(-1)).cast("double").alias("freshness_seconds"))


def sample_for_profile(df: DataFrame, percent: float, key: str | None = None, seed: int = 17) -> tuple[DataFrame, str]:
    """A sample and its precision: all rows at 100, else by the hash of a key (repeatable) or by chance (A5)."""
    if percent >= 100:
        return df, "EXACT"
    if key is not None:
        # A hash that other engines have too, so that they take the same rows.
        place = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
        return df.filter(place < percent * 100), "ESTIMATED"
    return df.sample(fraction=percent / 100, seed=seed), "ESTIMATED"


def day_sketches(df: DataFrame, day: Column, columns: list[str] | None = None) -> DataFrame:
    """Profiles that merge: for each day and column, rows (day, column_name, total, non_null, distinct, quantiles, top) with counts and sketches.

    ``distinct`` is an HLL sketch, ``quantiles`` a KLL sketch of numbers, ``top`` counts each day's most frequent values.
    A table's profile over any days comes from these rows alone (``merged_profile``).
    """
    parts = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns or not kinds.equatable(f.dataType):
            continue
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        quantiles = F.kll_sketch_agg_double((c + F.lit(0)).cast("double"), _SKETCH) if kinds.is_numeric(f.dataType) else F.lit(None).cast("binary")
        parts.append(df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count(c).alias("non_null"), F.hll_sketch_agg(text, F.lit(12)).alias("distinct"), quantiles.alias("quantiles"), F.min(text).alias("min"), F.max(text).alias("max")).withColumn("column_name", F.lit(f.name)))
    return reduce(DataFrame.unionByName, parts)


def merged_profile(sketches: DataFrame) -> DataFrame:
    """One row for each column over all days of ``day_sketches``: total, non_null, distinct_count, p50, p95, the last three ESTIMATED (A1)."""
    own = sketches.groupBy("column_name").agg(F.sum("total").alias("total"), F.sum("non_null").alias("non_null"), F.hll_union_agg("distinct").alias("d"), F.count("quantiles").alias("numbers"), F.kll_merge_agg_double("quantiles").alias("q"))
    at = lambda p: F.when((F.col("numbers") > 0) & (F.col("non_null") > 0), F.kll_sketch_get_quantile_double("q", F.lit(p)))
    return own.select("column_name", "total", "non_null", F.hll_sketch_estimate("d").alias("distinct_count"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.lit("ESTIMATED").alias("precision"))
