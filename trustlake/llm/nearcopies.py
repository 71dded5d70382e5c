"""Near copies by the similarity that SimHash estimates, worked out from the word shingles themselves, for stages that no
fingerprint's contract binds.

Two documents link when the cosine of their sets of five-word shingles is 0.8 or more: the share of common shingles in the
geometric mean of the two sizes. SimHash bits are signs of random projections and estimate this cosine.

1. Equal sets are one node, so exact copies cost one row however many there are.
2. Candidates by pivot tables. Sets whose SimHash fingerprints differ in 4 bits or fewer meet, as in ``simhash``. A pair at
   0.8 differs in 13 of 64 bits on average, up to 24 to miss few, which chance meets everywhere; so fingerprints find near
   pairs and miss most of those close to 0.8.
3. Candidates by bands, for the rest. Sets that share one of 64 bands of four MinHashes meet. A pair at 0.8 has a Jaccard
   similarity of 0.667 if both are of a size, of 0.64 at least; it shares no band with a chance of one in a million, of
   nine at most. Components of both kinds of candidates hold all links that were met.
4. Within such a component the links are verified by the sets themselves, breadth first: a set that is reached is not
   compared again. A component with more than ``slice_shingles`` shingles is cut into slices, and each pair of slices is
   a group of its own, so that no task holds more than two slices.
5. Components of the verified links are the groups.

Shingles are told apart by 32 bits of their hashes. Defined cases: a text of fewer than five words is one shingle, texts
without words have equal, empty sets; rows whose id is null take no part; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm import simhash
from trustlake.llm.common import column, discard, in_small_batches, materialize, utf8

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 64, 4
SLICE_SHINGLES = 1 << 19
_CHUNK = 2048
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 11) | 1 for i in range(BANDS * ROWS)], np.uint64)[:, None]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band: the hash of its place and its MinHashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, (shingles[None, at : at + _CHUNK] * _FACTORS).min(1), out=least)
    return np.array([xxhash.xxh3_64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, node, fp, keys, n, shingles): node names the set, fp is its fingerprint, n its size; an empty set has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts may be long, so a few rows at a time.
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [np.unique(simhash.shingle_hashes(t, size)) for t in utf8(part)]
                keys = [band_keys(s).view(np.int64) if len(s) else [] for s in sets]
                nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
                sets = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(nodes), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int32()))],
                    ["doc_id", "node", "fp", "keys", "n", "shingles"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(own).mapInArrow(run, f"doc_id {kind}, node long, fp long, keys array<long>, n long, shingles array<int>")


def pivot_candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join every two sets whose fingerprints pivot tables link. ``nodes``: node, fp, n; a node stands there once."""
    own = nodes.filter("n > 0").select("node", "fp")
    least = materialize(own.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = own.join(least, "fp").filter("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"n{c}")) for c in "ab"]
    near = simhash.links(least.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return same.union(near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of each set to the least one that it shares a band with. ``nodes``: node, keys; a node stands there once."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("key", "a")
    return keyed.join(shared, "key").filter("a < node").select("a", F.col("node").alias("b")).distinct()


def near_forest(values: np.ndarray, starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets: set i is ``values[starts[i]:starts[i + 1]]``, none is empty."""
    ids = np.unique(values, return_inverse=True)[1]
    sizes = np.diff(starts)
    mark = np.zeros(len(values), np.uint8)
    left, flat, at = np.arange(len(sizes)), ids, starts[:-1]
    a, b = [], []

    def keep(which: np.ndarray) -> None:
        nonlocal left, flat, at
        flat = flat[np.repeat(which, sizes[left])]
        left = left[which]
        at = np.r_[0, np.cumsum(sizes[left])[:-1]] if len(left) else left

    while len(left):
        reached = [int(left[0])]
        keep(np.arange(len(left)) > 0)
        while reached and len(left):
            one = reached.pop()
            own = ids[starts[one] : starts[one + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[own] = 0
            near = both + 1e-9 >= similarity * np.sqrt(float(sizes[one]) * sizes[left])
            if near.any():
                new = left[near].tolist()
                a += [one] * len(new)
                b += new
                reached += new
                keep(~near)
    return np.array(a, int), np.array(b, int)


def verified(members: DataFrame, similarity: float = SIMILARITY, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """Links (a, b), a < b, that join every two sets of a component within the similarity. ``members``: root, node, n, shingles."""
    weights = members.groupBy("root").agg(F.ceil(F.sum("n") / slice_shingles).cast("int").alias("slices"))
    mine = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    own = F.when(F.col("slices") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.struct(F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y")))
    )
    groups = (
        members.join(weights, "root")
        .select("root", "node", "shingles", F.explode(own).alias("s"))
        .select("root", "s.x", "s.y", "node", "shingles")
        .repartition("root", "x", "y")
        .sortWithinPartitions("root", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            nodes = np.array([r[0] for r in rows], np.int64)
            starts = np.r_[0, np.cumsum([len(r[1]) for r in rows])]
            a, b = near_forest(np.concatenate([r[1] for r in rows]), starts, similarity)
            a, b = nodes[a], nodes[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        key, rows = None, []
        for batch in batches:
            keys = list(zip(*[column(batch, c).to_pylist() for c in ("root", "x", "y")]))
            nodes, lists = column(batch, "node").to_pylist(), column(batch, "shingles")
            for i, now in enumerate(keys):
                if now != key and rows:
                    yield solved(rows)
                    rows = []
                key = now
                # A copy, so that no batch is held.
                rows.append((nodes[i], lists[i].values.to_numpy().copy()))
        if rows:
            yield solved(rows)

    return in_small_batches(groups).mapInArrow(run, "a long, b long").filter("a < b").distinct()


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """One row per input row with an id: doc_id and component_id (smallest id reachable over links)."""
    sets = materialize(shingle_sets(docs, id_col, text_col, size), "shingle-sets")
    of = materialize(sets.select("doc_id", "node"), "nodes-of-documents")
    distinct = materialize(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "distinct-sets")
    met = materialize(simhash.stars(pivot_candidates(distinct).union(candidates(distinct)).distinct()), "met")
    met = met.union(met.select("root", F.col("root").alias("node")).distinct())
    # The set comes from the row with the smallest id; an id that stands there twice with one text gives it twice, which changes nothing.
    wanted = distinct.join(met, "node").select(F.col("least").alias("doc_id"), "node", "root", "n")
    members = materialize(wanted.join(sets.select("doc_id", "node", "shingles"), ["doc_id", "node"]).select("root", "node", "n", "shingles"), "members")
    discard(sets)
    found = simhash.stars(verified(members, similarity, slice_shingles))
    discard(members)
    rooted = distinct.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(rooted.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row of ``docs`` for each group of near copies, as ``simhash.keep_representatives`` gives it."""
    return simhash.representatives(docs, near_copy_groups(docs, id_col, text_col, **options), id_col, text_col)
