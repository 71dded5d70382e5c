"""SimHash near-duplicate groups by pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link when at most ``max_bits`` bits differ.
Links are searched among distinct fingerprints only, so exact copies cost one row however many there are.

1. Blocks. The bits are cut into ``max_bits + 1`` blocks and what is left of each into ``max_bits + 1`` again. Two
   linked fingerprints agree on a block and on a part of the rest, so the pair meets under at least one of
   (max_bits + 1)^2 keys: no link is missed, and fingerprints that share no key never meet.
2. Pivot tables. Within a key, each fingerprint has its Hamming distances to ``pivots`` reference fingerprints. By the
   triangle inequality a pair whose coordinates differ by more than ``max_bits`` anywhere is discarded: the rows are
   sorted by the first coordinate and only a window of ``max_bits`` is opened, the other coordinates thin it out, and
   survivors are verified by their Hamming distance. (For random fingerprints one pivot passes 57 % of the pairs, so
   pivots alone cannot deal out the rows; the blocks do that.)
3. A key with more than ``slice_rows`` fingerprints is cut into slices, and each pair of slices is a group of its own.
4. Each task sends on a spanning forest of the links it found; components come from large-star and small-star rounds
   over DataFrames, with a written table after each round.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; equal
rows are kept; null ids stay and never name a component unless all its ids are null; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, discard, in_small_batches, materialize, utf8

SHINGLE = 4
MAX_BITS = 4
PIVOTS = 32
SLICE_ROWS = 4096
#: Ids that may be sent to all tasks, about 8 MB.
BROADCAST_IDS = 1_000_000
_CHUNK = 32_768


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a UTF-8 text, A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [s - 1 for s in starts[size:]] + [len(line)]
    return np.fromiter((hashed(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash as an unsigned integer: a bit is 1 if it is set in over half the shingle hashes."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes; of none it is zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, size) for t in utf8(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(own).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """(max_bits + 1)^2 masks such that two fingerprints at ``max_bits`` or fewer differing bits agree under one."""
    parts = max_bits + 1
    cut = lambda bits: [bits[i * len(bits) // parts : (i + 1) * len(bits) // parts] for i in range(parts)]
    out = []
    for block in cut(list(range(64))):
        for rest in cut([b for b in range(64) if b not in block]):
            out.append(sum(1 << b for b in block + rest))
    return out


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The pivots: hashes of 0 to n - 1, so that every task has the same ones."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)], np.uint64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_groups(fps: np.ndarray, group: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within groups. Rows are sorted by group, then by distance to the first pivot."""
    n = len(fps)
    table = np.stack([np.bitwise_count(fps ^ p) for p in pivots]).astype(np.int16)
    ends = np.r_[np.flatnonzero(np.diff(group)) + 1, n]
    left = ends[np.searchsorted(ends, np.arange(n), side="right")]
    active, step, found, held = np.arange(n), 1, [], 0
    while len(active):
        active = active[active + step < left[active]]
        active = active[table[0, active + step] - table[0, active] <= max_bits]
        i, j = active, active + step
        for coordinate in table[1:]:
            near = np.abs(coordinate[i] - coordinate[j]) <= max_bits
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        found.append((i[near], j[near]))
        held += int(near.sum())
        if held > 1_000_000:
            label = forest(*map(np.concatenate, zip(*found)), n)
            own = np.flatnonzero(label != np.arange(n))
            found, held = [(label[own], own)], len(own)
        step += 1
    a, b = map(np.concatenate, zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
    label = forest(a, b, n)
    own = np.flatnonzero(label != np.arange(n))
    return fps[label[own]], fps[own]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Links (a, b), a < b, that join every two of the distinct fingerprints ``fp`` within ``max_bits``, directly or over others."""
    masks, refs = block_masks(max_bits), reference_fingerprints(pivots)
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for t, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.t", "k.v")
    shared = keyed.groupBy("t", "v").count().filter("count > 1")
    slices = F.ceil(F.col("count") / slice_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), slices).cast("int")
    each = F.sequence(F.lit(0), slices - 1)
    own = F.when(slices == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(each, lambda o: F.struct(F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y")))
    )
    groups = (
        keyed.join(shared, ["t", "v"])
        .select("t", "v", "fp", F.explode(own).alias("s"))
        .withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(refs[0]))).cast("long"))))
        .select("t", "v", "s.x", "s.y", "near", "fp")
        .repartition("t", "v", "x", "y")
        .sortWithinPartitions("t", "v", "x", "y", "near", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            group = np.r_[0, np.cumsum(np.any(key[1:] != key[:-1], axis=1))]
            a, b = link_groups(fps, group, refs, max_bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        key, fps = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "tvxy"], 1)])
            fps = np.concatenate([fps, column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            last = np.flatnonzero(np.any(key != key[-1], axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield solved(key[:whole], fps[:whole])
                key, fps = key[whole:], fps[whole:]
        if len(fps):
            yield solved(key, fps)

    return in_small_batches(groups).mapInArrow(run, "a long, b long").distinct()


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b), a < b. The least neighbour is an aggregate, so a hub is never gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.filter("a < b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """Links (root, node) of each component's smallest node to its others."""
    edges = materialize(edges, "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("root"), F.col("b").alias("node"))
        state, before = now, edges
        edges = materialize(star(star(edges, True), False), "links")
        discard(before)


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS, pivots: int = PIVOTS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links), root (the component's key)."""
    fps = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = stars(links(distinct.select("fp"), max_bits, pivots, slice_rows))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that with the smallest id, all its columns unchanged.

    Rows whose id is null all stay, since nothing names them. Of rows that share an id and a text, one stays.
    """
    return representatives(docs, near_duplicate_groups(docs, id_col, text_col, **options), id_col, text_col)


def representatives(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their group, and those without an id. ``groups``: doc_id, component_id.

    What goes is taken out by its ids. Up to BROADCAST_IDS of them are sent to the texts, so that these stay where they
    are; more are joined by shuffle.
    """
    named = groups.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("__n"))
    named = materialize(named.filter("__n != 1"), "representatives")
    gone, again = named.filter("__n = 0").select("__id"), named.filter("__n > 1").select("__id")
    sent = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    here = F.col(id_col) == F.col("__id")
    out = docs.join(sent(gone), here, "left_anti")
    if again.isEmpty():
        return out
    more = sent(again)
    return out.join(more, here, "left_anti").unionByName(out.join(more, here, "left_semi").dropDuplicates([id_col, text_col]))
