"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become codes by the signs of their elements. Equal codes are one entry with the ``k + 1`` smallest ids of their
rows (ties of equal distance go to the smaller id, so no more of them can be among the k nearest), and queries with
equal codes search once.

The codes are cut into m segments, as many as make a segment about as long as the number of codes has bits. One index
over all codes has a row for each code and segment; it is dealt out by segment and the first bits of the segment's value,
so that a bucket holds about ``block_codes`` codes. (A bucket of far more is cut into slices.)

Search goes in rounds of growing segment radius. In the round of radius r a query is sent, for each segment, to the
buckets whose first bits differ from its own in at most r places, together with the distance of the worst of the k + 1
entries that it has so far. There the values at distance r from the query's are looked up (or, where they are more than
the bucket has codes, the bucket is read through) and what is met is verified by the whole distance. A code is met once:
in the round of its nearest segment, under the first segment that is as near. After radius r every code within
m * (r + 1) - 1 bits has been met, so a query is done when the worst of its k + 1 entries is at most that far away; only
the others go on. When the look-ups of a radius would cost as much as reading all codes, one last round reads them.

So rows are shuffled in proportion to codes, queries and the buckets near them, and not to codes times queries.

Defined cases: a null vector has no code, is no result and, as a query, has none; elements that are null or NaN count as
not positive; vectors of other lengths than ``bits`` fail; rows without an id are left out; a query's own row is not
among its results; rows that share id and code count once; other columns are ignored; an empty table gives an empty
result; fewer than k rows give as many results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.llm.common import column, materialize

K = 10
BITS = 64
#: Codes of a bucket, and queries that one group of a bucket takes.
BLOCK_CODES = 16_384
BLOCK_QUERIES = 32_768
#: Pairs that are looked at together, and codes that are read in the time of one look-up.
_PAIRS = 1 << 20
_LOOKUP = 8


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """Rows (id, code): bit i is set if element i is positive."""
    bit = lambda x, i: F.when(~F.isnan(x) & (x > 0), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    # A null element makes the condition null, and so no bit.
    code = F.aggregate(F.transform(F.col(vector_col), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    checked = F.when(F.size(vector_col) != bits, F.raise_error(F.lit(f"a vector has not {bits} elements")).cast("long")).otherwise(code)
    return vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), checked.alias("code"))


@cache
def ring(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` of them set."""
    out = np.zeros(1, np.uint64)
    for _ in range(radius):
        # Only bits above the highest set one are added, so each number comes once.
        parts = [out[out < np.uint64(1 << i)] | np.uint64(1 << i) for i in range(width)]
        out = np.concatenate(parts)
    return out if radius <= width else out[:0]


class Plan:
    """How codes are cut: the segments' places, and the first bits that name a bucket."""

    def __init__(self, codes: int, bits: int = BITS, block_codes: int = BLOCK_CODES):
        size = max(1.0, math.log2(max(codes, 2)))
        self.codes, self.bits, self.m = codes, bits, max(1, min(bits, round(bits / size)))
        self.cuts = [(i * bits // self.m, (i + 1) * bits // self.m) for i in range(self.m)]
        self.width = max(high - low for low, high in self.cuts)
        least = min(high - low for low, high in self.cuts)
        self.prefix = min(least, max(0, math.ceil(math.log2(max(1.0, codes / block_codes)))))

    def covered(self, radius: int) -> int:
        """Every code within so many bits has been met after this radius."""
        return self.m * (radius + 1) - 1

    def rounds(self) -> Iterator[tuple[range, bool]]:
        """Radii of each round: 0 and 1, then one by one. Once looking up the next costs as much as reading all codes, one
        round reads them (marked True), in the buckets of one segment."""
        first, last = 0, 1
        while first <= self.width:
            everything = _LOOKUP * self.m * math.comb(self.width, last) >= self.codes
            yield range(first, self.width + 1 if everything else last + 1), everything
            if everything:
                return
            first = last = last + 1

    def buckets(self, code: F.Column, segments: int | None = None) -> F.Column:
        """(segment, first bits) of a code for every segment, or for the first few."""
        first = lambda high: F.shiftrightunsigned(code, high - self.prefix).bitwiseAND(F.lit((1 << self.prefix) - 1).cast("long")) if self.prefix else F.lit(0).cast("long")
        return F.array(*[F.struct(F.lit(s).alias("s"), first(high).alias("p")) for s, (_, high) in enumerate(self.cuts[:segments])])


class Bucket:
    """The codes of a bucket, sorted by what their segment has behind the first bits. Places are in the order of least ids."""

    def __init__(self, plan: Plan, segment: int, prefix: int, codes: np.ndarray):
        self.plan, self.segment, self.prefix, self.codes = plan, segment, prefix, codes
        low, high = plan.cuts[segment]
        self.low, self.width = np.uint64(low), high - low - plan.prefix
        self.mask = np.uint64((1 << self.width) - 1)
        own = codes >> self.low & self.mask
        self.order = np.argsort(own, kind="stable")
        self.values = own[self.order]

    def pairs(self, q: np.ndarray, apart: np.ndarray, radii: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) of codes whose segment is at one of the radii; ``apart``: by how many of the first bits a query differs."""
        own = q >> self.low & self.mask
        for a in np.unique(apart):
            left = [r - int(a) for r in radii if 0 <= r - int(a) <= self.width]
            rows = np.flatnonzero(apart == a)
            # All but the last round have few radii, so the rings are small.
            asked = sum(math.comb(self.width, n) for n in left)
            looks = asked < len(self.codes)
            step = max(1, _PAIRS // max(1, min(asked, len(self.codes))))
            for at in range(0, len(rows) if left else 0, step):
                part = rows[at : at + step]
                if looks:
                    wanted = (own[part, None] ^ np.concatenate([ring(self.width, n) for n in left])[None, :]).ravel()
                    start, end = np.searchsorted(self.values, wanted, "left"), np.searchsorted(self.values, wanted, "right")
                    n = end - start
                    met = np.flatnonzero(n)
                    i = np.repeat(part[met // asked], n[met])
                    skip = np.repeat(np.cumsum(n[met]) - n[met], n[met])
                    yield i, self.order[np.repeat(start[met], n[met]) + np.arange(len(i)) - skip]
                else:
                    near = np.isin(np.bitwise_count(own[part, None] ^ self.values[None, :]), left)
                    i, j = np.nonzero(near)
                    yield part[i], self.order[j]

    def nearest(self, q: np.ndarray, bound: np.ndarray, radii: range, keep: int, everything: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance): of each query, the ``keep`` nearest codes within its bound that are met here and now for the first time.

        With ``everything``, all codes of the bucket are read, and those met in rounds before are left out.
        """
        low, high = self.plan.cuts[self.segment]
        first = (q >> np.uint64(high - self.plan.prefix) if self.plan.prefix else np.zeros_like(q)) & np.uint64((1 << self.plan.prefix) - 1)
        found = []
        apart = np.bitwise_count(first ^ np.uint64(self.prefix))
        for i, j in self.pairs(q, apart * 0, range(self.width + 1)) if everything else self.pairs(q, apart, radii):
            differ = q[i] ^ self.codes[j]
            d = np.bitwise_count(differ).astype(np.int32)
            ok = d <= bound[i]
            i, j, d, differ = i[ok], j[ok], d[ok], differ[ok]
            in_segment = lambda t: np.bitwise_count(differ >> np.uint64(self.plan.cuts[t][0]) & np.uint64((1 << self.plan.cuts[t][1] - self.plan.cuts[t][0]) - 1))  # noqa: E731, B023
            own = in_segment(self.segment)
            for t in range(self.plan.m):
                if everything:
                    ok = in_segment(t) >= radii[0]
                    i, j, d, differ = i[ok], j[ok], d[ok], differ[ok]
                elif t != self.segment:
                    other = in_segment(t)
                    ok = other > own if t < self.segment else other >= own
                    i, j, d, differ, own = i[ok], j[ok], d[ok], differ[ok], own[ok]
            found.append(self.best(i, j, d, keep))
        return self.best(*map(np.concatenate, zip(*found)), keep) if found else (np.empty(0, int), np.empty(0, int), np.empty(0, np.int32))

    @staticmethod
    def best(i: np.ndarray, j: np.ndarray, d: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        return i[place < keep], j[place < keep], d[place < keep]


def met(index: DataFrame, active: DataFrame, plan: Plan, radii: range, everything: bool, keep: int, block_codes: int, block_queries: int) -> DataFrame:
    """Rows (q, code, d, least) that the queries (q, bound) meet in a round. ``index``: s, p, code, least."""
    near = [int(x) for r in range(min(plan.prefix, radii[-1]) + 1) for x in ring(plan.prefix, r)]
    index = index.filter("s = 0") if everything else index
    # Read from text, the masks are one literal.
    masks = F.from_json(F.lit(json.dumps(near)), "array<long>")
    asked = active.select("q", "bound", F.explode(plan.buckets(F.col("q"), 1 if everything else None)).alias("b")).select("q", "bound", "b.s", F.explode(F.transform(masks, lambda x: F.col("b.p").bitwiseXOR(x))).alias("p"))
    # Buckets of far more codes or queries than others; there are few.
    slices = index.groupBy("s", "p").count().filter(F.col("count") > 2 * block_codes).select("s", "p", F.ceil(F.col("count") / block_codes).cast("int").alias("n"))
    groups = asked.groupBy("s", "p").count().filter(F.col("count") > block_queries).select("s", "p", F.ceil(F.col("count") / block_queries).cast("int").alias("m"))
    cut = lambda df: df.join(slices, ["s", "p"], "left").join(groups, ["s", "p"], "left").fillna(1, ["n", "m"])
    mine = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    kind = index.schema["least"].dataType.simpleString()
    left = cut(index).select("s", "p", mine("code", "n").alias("x"), each("m").alias("y"), F.lit(False).alias("query"), "code", "least", F.lit(0).alias("bound"))
    right = cut(asked).select("s", "p", each("n").alias("x"), mine("q", "m").alias("y"), F.lit(True).alias("query"), F.col("q").alias("code"), F.lit(None).cast(kind).alias("least"), "bound")
    keys = ["s", "p", "x", "y"]
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "query", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, leasts, bucket, least = None, [], [], None, None
        for batch in batches:
            key = np.stack([column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "query")], 1)
            code, bound = column(batch, "code").to_numpy(zero_copy_only=False).view(np.uint64), column(batch, "bound").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1)]) if len(key) else []
            for a, b in zip(starts, [*starts[1:], len(key)]):
                own = tuple(key[a, :4].tolist())
                if own != now:
                    now, codes, leasts, bucket = own, [], [], None
                if not key[a, 4]:
                    codes.append(code[a:b].copy())
                    leasts.append(column(batch, "least").slice(a, b - a))
                elif codes:
                    if bucket is None:
                        bucket, least = Bucket(plan, own[0], own[1], np.concatenate(codes)), pa.concat_arrays(leasts)
                    i, j, d = bucket.nearest(code[a:b], bound[a:b], radii, keep, everything)
                    yield pa.RecordBatch.from_arrays([pa.array(code[a:b][i].view(np.int64)), pa.array(bucket.codes[j].view(np.int64)), pa.array(d, pa.int32()), least.take(pa.array(j))], ["q", "code", "d", "least"])

    return dealt.mapInArrow(run, f"q long, code long, d int, least {kind}")


def search(vectors: DataFrame, queries: F.Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Rows (query_id, rank, id, distance): the k nearest rows by Hamming distance, then id, of each row that ``queries`` selects.

    ``queries`` is a condition on ``id``.
    """
    codes = materialize(binary_codes(vectors, id_col, vector_col, bits), "codes").filter("id IS NOT NULL")
    order = Window.partitionBy("code").orderBy("id")
    few = codes.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    distinct = materialize(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-codes")
    wanted = materialize(codes.filter(queries).distinct(), "queries")
    plan = Plan(distinct.count(), bits, block_codes)
    entries = distinct.select("code", F.col("ids")[0].alias("least"))
    index = materialize(entries.select(F.explode(plan.buckets(F.col("code"))).alias("b"), "code", "least").select("b.s", "b.p", "code", "least"), "code-index")
    active = wanted.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(bits))
    near = Window.partitionBy("q").orderBy("d", "least")
    done, best = None, None
    for radii, everything in plan.rounds():
        found = met(index, active, plan, radii, everything, k + 1, block_codes, block_queries)
        found = found if best is None else found.unionByName(best)
        kept = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1)
        # The worst of k + 1 entries, or all bits while there are fewer; a query that has met nothing stays active.
        worst = kept.groupBy("q").agg(F.max("d").alias("d"), F.count("*").alias("n")).select("q", F.when(F.col("n") > k, F.col("d")).otherwise(bits).alias("worst"))
        covered = bits if everything else plan.covered(radii[-1])
        bounds = materialize(active.select("q").join(worst, "q", "left").select("q", F.coalesce("worst", F.lit(bits)).alias("bound")), "bounds")
        state = materialize(kept.drop("n").join(bounds, "q"), "nearest")
        over = state.filter(F.col("bound") <= covered).drop("bound")
        done = over if done is None else done.unionByName(over)
        active = bounds.filter(F.col("bound") > covered)
        best = state.filter(F.col("bound") > covered).drop("bound")
        if everything or active.isEmpty():
            break
    done = done.unionByName(best).join(distinct, "code")
    each = wanted.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(done, "q").select("query_id", "d", F.explode("ids").alias("id"))
    rank = Window.partitionBy("query_id").orderBy("d", "id")
    ranked = each.filter("id != query_id").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", F.col("d").alias("distance"))
