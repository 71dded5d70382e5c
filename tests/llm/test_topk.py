"""Rounds of multi-index hashing meet each code once, and stop only when the nearest are proven."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.llm import topk


def test_rings_hold_all_numbers_of_so_many_bits():
    for width in (1, 5, 11):
        for radius in range(width + 2):
            own = topk.ring(width, radius)
            assert len(set(own.tolist())) == len(own) == math.comb(width, radius) and (np.bitwise_count(own) == radius).all()


@pytest.mark.parametrize("everything", [False, True])
def test_buckets_of_all_rounds_meet_each_code_once(everything):
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 32, 400, dtype=np.uint64))
    queries = rng.integers(0, 1 << 32, 9, dtype=np.uint64)
    plan = topk.Plan(len(codes), 32, 64)
    assert plan.prefix == 3 and plan.m == 4
    seen = []
    rounds = [(range(0, 2), False), (range(2, 3), False), (range(3, plan.width + 1), everything)]
    for radii, whole in rounds:
        for s, (_, high) in enumerate(plan.cuts[:1] if whole else plan.cuts):
            first = codes >> np.uint64(high - plan.prefix) & np.uint64(7)
            for p in range(8):
                bucket = topk.Bucket(plan, s, p, codes[first == p])
                for i, j, d in zip(*bucket.nearest(queries, np.full(9, 32), radii, 10_000, whole)):
                    assert d == (int(queries[i]) ^ int(bucket.codes[j])).bit_count()
                    seen.append((i, int(bucket.codes[j])))
    assert len(seen) == len(set(seen)) == 9 * len(codes)


def test_search_by_radii_equals_brute_force(spark):
    """Few segments and clustered codes, so that most queries are done before all codes are read."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 64))
    vectors = np.repeat(centres, 100, axis=0) * np.where(rng.random((4000, 64)) < 0.05, -1, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    codes = [sum(1 << b for b, x in enumerate(v) if x > 0) for v in vectors]
    got = {}
    for r in topk.search(df, F.col("id") % 200 == 0, k=5, block_codes=256, block_queries=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    assert set(got) == set(range(0, 4000, 200))
    for q, found in got.items():
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:5]
        assert sorted(found) == [(n + 1, *w) for n, w in enumerate(want)]
