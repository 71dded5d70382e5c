"""Percentiles by brackets and sketches that merge, on rows made by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.operators import profile


@pytest.mark.parametrize("bracket", [1_000_000, 2000])
def test_percentiles_are_exact_for_any_values(spark, monkeypatch, bracket):
    monkeypatch.setattr(profile, "_BRACKET", bracket)
    rng = np.random.default_rng(3)
    n = 60_000
    columns = {"uniform": rng.random(n), "ties": rng.integers(0, 5, n).astype(float), "one": np.full(n, 7.0), "heavy": np.where(rng.random(n) < 0.5, 1.0, rng.lognormal(0, 3, n)), "few": np.where(np.arange(n) < 3, np.arange(n), np.nan)}
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in zip(*columns.values())], ", ".join(f"{c} double" for c in columns) + "").repartition(4).withColumn("none", F.lit(None).cast("int"))
    wanted = [(c, p) for c in columns for p in (0.0, 0.05, 0.5, 0.95, 1.0)] + [("none", 0.5)]
    got = profile.exact_percentiles(df, wanted)
    for c, p in wanted[:-1]:
        assert got[c, p] == pytest.approx(np.percentile(columns[c][~np.isnan(columns[c])], 100 * p), rel=1e-12), (c, p)
    assert got["none", 0.5] is None


def test_sketches_of_parts_merge_to_the_whole(spark):
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), (F.col("id") % 4).alias("day"), F.when(F.col("id") % 10 != 0, F.lit("x")).alias("s"))
    whole = {r.column_name: r for r in profile.merged_profile(profile.day_sketches(df, F.col("day"), ["v", "s"])).collect()}
    assert (whole["v"].total, whole["v"].non_null, whole["s"].non_null, whole["s"].distinct_count) == (40_000, 40_000, 36_000, 1)
    assert abs(whole["v"].distinct_count - 1000) < 50 and abs(whole["v"].p50 - 500) < 20 and abs(whole["v"].p95 - 950) < 20
    assert whole["s"].p50 is None
