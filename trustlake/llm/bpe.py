"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash, displace) over the vocabulary's byte strings resolves every pre-token that is a
vocabulary entry with one probe and one comparison. Tier two: other pre-tokens are merged by a heap of (rank, place)
over a doubly linked list of bytes, so a pre-token of n bytes takes O(n log n) however long it is.

In front of both stands a memo of chunks. Text is cut at single spaces that stand between two characters that are not
white space; a pre-token never reaches over such a place, so a chunk has the same ids wherever it occurs. Texts with
other white space next to a space are taken whole. The memo is emptied when it is full, which changes no result.

Defined cases: a null or empty text has no ids; ids of rows may be null or repeat; other columns are ignored; an empty
table gives an empty result; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, texts

Coder = Callable[[list[str]], list[bytes]]

#: Chunks in a worker's memo, about 200 bytes each.
MEMO = 450_000
#: Stands in the memo for a chunk with white space at an edge, or for none between two spaces.
UNSOUND = 0
#: Marks that may end a chunk, and the end of the letters that all Unicode versions know alike.
MARKS = ".,;:!?"
LAST_LATIN = "\u0250"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of n distinct byte strings onto 0 to n - 1, with their values in slot order.

    Keys fall into n / 4 buckets. From the largest bucket on, a displacement is searched that sends all its keys to free
    slots; buckets of one key take the free slots left and store them as they are.
    """

    def __init__(self, table: dict[bytes, int]):
        keys = sorted(table)
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        hashes = self.hashes(keys)
        order: dict[int, list[int]] = {}
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            order.setdefault(b, []).append(i)
        self.displace = np.zeros(self.buckets, np.int64)
        taken, slot_of = np.zeros(n, bool), np.zeros(len(keys), np.int64)
        for b, own in sorted(order.items(), key=lambda x: (-len(x[1]), x[0])):
            first, step = 1, 32
            while len(own) > 1:
                slots = self.slot(hashes[own][:, None], np.arange(first, first + step, dtype=np.uint64))
                spread = np.sort(slots, axis=0)
                good = ~taken[slots].any(0) & (spread[1:] != spread[:-1]).all(0)
                at = int(np.argmax(good))
                if good[at]:
                    self.displace[b] = first + at
                    taken[slots[:, at]] = True
                    slot_of[own] = slots[:, at]
                    break
                first, step = first + step, step * 4
        free = iter(np.flatnonzero(~taken).tolist())
        for b, own in order.items():
            if len(own) == 1:
                slot_of[own[0]] = at = next(free)
                self.displace[b] = -1 - at
        self.keys: list[bytes] = [b""] * n
        self.values = np.full(n, -1, np.int64)
        for i, key in enumerate(keys):
            self.keys[slot_of[i]], self.values[slot_of[i]] = key, table[key]

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64)

    def slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 for those outside the table."""
        h = self.hashes(keys)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(d < 0, -1 - d, self.slot(h, np.abs(d).astype(np.uint64)))
        own = np.fromiter((self.keys[i] == k for i, k in zip(at.tolist(), keys)), bool, len(keys))
        return np.where(own, self.values[at], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair is merged first, the leftmost of equals."""
    n, rank = len(piece), ranks.get
    # A heap entry is one number: rank, begin and stop of a pair, so the lowest rank, then the leftmost comes first.
    bits = n.bit_length()
    high, low = 2 * bits, (1 << bits) - 1
    # end[i]: where the part that begins at i ends, 0 once it has been merged into the part before it.
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [r << high | i << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, stop = entry >> bits & low, entry & low
        middle = end[i]
        if not middle or middle == n or end[middle] != stop:
            continue
        end[middle], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            r = rank(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, r << high | i << bits | end[stop])
        p = before[i]
        if p >= 0:
            r = rank(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, r << high | p << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ChunkMemo:
    """Ids of texts as little-endian 32-bit bytes, by chunks.

    ``of_words`` encodes strings of a space and a chunk with no space in it nor white space at its end; ``of_texts``
    encodes any strings. ``uncut(text)`` names texts that must not be cut.
    """

    def __init__(self, of_words: Coder, of_texts: Coder, uncut: Callable[[str], bool] = lambda _: False, most: int = MEMO):
        self.of_words, self.of_texts, self.uncut, self.most, self.memo = of_words, of_texts, uncut, most, {}
        self.marks = dict(zip(MARKS, of_texts(list(MARKS))))

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo = {}
        known, cuts, new = self.memo.get, [], {}
        for text in batch:
            first, *rest = (text,) if self.uncut(text) else text.split(" ")
            parts = list(map(known, rest))
            try:
                ids = b"".join(parts)
            except TypeError:  # None or UNSOUND is among the parts
                new.update((c, None) for c, p in zip(rest, parts) if p is None)
                ids = None
            cuts.append((first, rest, ids))
        sound = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        self.memo.update(dict.fromkeys(new, UNSOUND))
        # A mark after a letter is a pre-token of its own, so a word is encoded once for all marks after it.
        bare = {c: c[:-1] for c in sound if c[-1] in MARKS and len(c) > 1 and c[-2].isalpha() and c[-2] < LAST_LATIN}
        words = list(dict.fromkeys(w for c in sound if (w := bare.get(c, c)) in new or known(w) is None))
        self.memo.update(zip(words, self.of_words([" " + w for w in words])))
        self.memo.update((c, self.memo[w] + self.marks[c[-1]]) for c, w in bare.items())
        out: list[bytes] = []
        heads: dict[str, list[int]] = {}
        for i, (text, (first, rest, ids)) in enumerate(zip(batch, cuts)):
            try:
                ids = b"".join(map(known, rest)) if ids is None else ids
            except TypeError:
                ids = None
            if ids is None or rest and (not first or first[-1].isspace()):
                first, ids = text, b""
            heads.setdefault(first, []).append(i)
            out.append(ids)
        for at, ids in zip(heads.values(), self.of_texts(list(heads))):
            for i in at:
                out[i] = ids + out[i]
        return out


class Encoder:
    """Encodes strings by a rank table and a splitting pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str, memo: int = MEMO):
        self.ranks, self.table, self.most, self.pieces = ranks, table, memo, {}
        self.split = regex.compile(pattern).findall
        self.chunks = ChunkMemo(self.coded, self.coded, most=memo)

    def coded(self, chunks: list[str]) -> list[bytes]:
        split = [self.split(c) for c in chunks]
        if len(self.pieces) > self.most:
            self.pieces = {}
        own = self.pieces
        new = list(dict.fromkeys(t for s in split for t in s if t not in own))
        if new:
            raw = [t.encode() for t in new]
            for text, piece, rank in zip(new, raw, self.table.find(raw).tolist()):
                ids = (rank,) if rank >= 0 else merge(piece, self.ranks)
                own[text] = struct.pack(f"<{len(ids)}i", *ids)
        return [own[s[0]] if len(s) == 1 else b"".join([own[t] for t in s]) for s in split]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """Rows (doc_id, ids): the token ids of each whole text. ``rank_path`` is a file that the driver can read."""
    spark = docs.sparkSession
    ranks = read_ranks(rank_path)
    # Of a size that the vocabulary fixes, whatever the corpus.
    shared = spark.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, pattern, memo)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                coded = encoder.chunks.encode(list(texts(part)))
                offsets = np.r_[0, np.cumsum([len(c) // 4 for c in coded])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), ids], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(own).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, rank_path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with one more column, decoded: the bytes that the ids of a row stand for; null ids have no bytes."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(rank_path).items()})
    names = coded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            ids = column(batch, ids_col)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            out = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return in_small_batches(coded).mapInArrow(run, schema)
