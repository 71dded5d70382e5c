"""Removal of long word sequences that a document with a smaller id has too, by recompression.

A window is ``size`` consecutive words of one document. A window is removed if its words also start somewhere in a
document with a smaller id; windows are judged on the input. Words are split at ASCII white space and are not changed.

1. Recompression. A document is a sequence of symbols, at first its words' hashes. A round names each maximal run of one
   symbol, and then each pair of neighbours of which the first falls to the left and the second to the right half of the
   alphabet; a name is a hash of what it stands for and the halves are bits of the symbols, so the names are global though
   no worker asks another. Symbols of ``grown`` words take part no more. For each symbol the rounds carry along the words
   that decide it: where these words stand, there stands the symbol. So equal windows hold the same symbols inside.
2. A window that decides no symbol, as in a long run of one word, counts as a symbol itself, so each window has one.
   Symbols that only one document has are found by one count over all symbols. A window with such a symbol stands in no
   other document; the rest, the windows all of whose symbols are shared, are candidates.
3. Candidates are verified by two 64-bit hashes of their words, one row for each of a document's different windows: the
   smallest document of each is an aggregate, and no group is ever gathered.
4. Documents that lose words are read once more, to cut these.

Documents with equal words are settled by the hash of their words alone: all but those with the smallest id lose all
words, if these fill a window. Documents are told apart by id only where a window's documents are compared.

Defined cases: a null or empty text has no words; rows without an id are returned, lose nothing and take nothing from
others; rows that share an id are documents of one id, so none takes words from another; repeated rows are all returned;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, materialize, utf8
from trustlake.llm.simhash import BROADCAST_IDS

WINDOW = 50
#: Words from which a symbol grows no more, and rounds after which few shorter ones can still grow.
GROWN = 6
ROUNDS = 6
#: Odd numbers whose powers make the hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_FAR = np.int32(1 << 30)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words:
    """The words of some texts, as places in their bytes: ``start``, ``end`` and ``doc`` of each word, ``n`` words of each text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.space = _SPACE[self.data]
        after = np.r_[True, self.space[:-1]]
        self.start, self.end = np.flatnonzero(~self.space & after), np.flatnonzero(self.space & ~after)
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right").astype(np.int32)
        self.n = np.bincount(self.doc, minlength=len(texts))

    def numbers(self, which: int = 0) -> np.ndarray:
        """A hash of each word's bytes; there are two kinds."""
        power, inverse = powers(which, len(self.data))
        sums = np.cumsum((self.data + np.uint64(1)) * power, dtype=np.uint64)
        # The byte at the end is a space, so its own share goes as well.
        own = sums[self.end - 1] - np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
        return mixed(own * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def both(self) -> np.ndarray:
        return np.stack([self.numbers(0), self.numbers(1)], 1)

    def joined(self) -> list[memoryview]:
        """The words of each text, joined by one space."""
        keep, data = ~self.space, self.data.copy()
        keep[self.end], data[self.end] = True, 32
        size = np.bincount(self.doc, self.end - self.start + 1, len(self.n)).astype(np.int64)
        ends, out = np.cumsum(size), memoryview(data[keep])
        return [out[e - k : max(e - 1, e - k)] for k, e in zip(size.tolist(), ends.tolist())]


@cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))


def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base, modulo 2 to the 64th, and of its inverse."""
    known = _powers(which, 1 << 20) if size <= 1 << 20 else _powers.__wrapped__(which, size)
    return known[0][:size], known[1][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def neighbours(low: np.ndarray, high: np.ndarray, inside: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(low, high) of what stands before and behind each symbol; at the ends of a document something far away."""
    has_before, has_after = np.r_[False, inside], np.r_[inside, False]
    before = np.where(has_before, np.r_[0, low[:-1]], -_FAR), np.where(has_before, np.r_[0, high[:-1]], -_FAR)
    after = np.where(has_after, np.r_[low[1:], 0], _FAR), np.where(has_after, np.r_[high[1:], 0], _FAR)
    return before, after


def recompress(symbols: np.ndarray, doc: np.ndarray, grown: int = GROWN, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, doc, words, from, to) of the symbols after the rounds.

    ``symbols`` are the words' hashes, those of document 0 first, and ``doc`` their documents. The words from ``from`` to
    ``to`` (exclusive) decide the symbol; beyond the ends of a document nothing is known, so a symbol that an end decides
    reaches far beyond it.
    """
    n = len(symbols)
    words, low, high = np.ones(n, np.int32), np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    for r in range(rounds if n else 0):
        # Runs. A symbol stands alone only where its neighbours are known to differ.
        inside = doc[1:] == doc[:-1]
        first = np.flatnonzero(np.r_[True, ~(inside & (symbols[1:] == symbols[:-1]) & (words[1:] < grown))])
        last = np.r_[first[1:], len(symbols)] - 1
        grows, times = words[first] < grown, (last - first + 1).astype(np.int32)
        before, after = neighbours(low, high, inside)
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        low = np.where(grows, np.minimum(low, np.minimum(before[0][first], after[0][last])), low)
        high = np.where(grows, np.maximum(high, np.maximum(before[1][first], after[1][last])), high)
        symbols, doc, words = symbols[first], doc[first], words[first] * times
        symbols = np.where(times > 1, mixed(symbols ^ mixed(times.astype(np.uint64) + np.uint64(1 << 40))), symbols)
        # Pairs. A left symbol never joins what stands before it, nor a right one what stands behind it.
        inside = doc[1:] == doc[:-1]
        half = (mixed(symbols + np.uint64(r)) >> np.uint64(63)).astype(bool)
        left, right = half & (words < grown), ~half & (words < grown)
        joins = left[:-1] & right[1:] & inside
        head, tail = np.r_[joins, False], np.r_[False, joins]
        before, after = neighbours(low, high, inside)
        low = np.where(left, np.minimum(low, after[0]), np.where(right & ~tail, np.minimum(low, before[0]), low))
        high = np.where(left, np.maximum(high, after[1]), np.where(right & ~tail, np.maximum(high, before[1]), high))
        symbols = np.where(head, mixed(symbols + np.uint64(_BASES[0]) * mixed(np.r_[symbols[1:], np.uint64(0)])), symbols)
        words = np.where(head, words + np.r_[words[1:], 0], words)
        symbols, doc, words, low, high = symbols[~tail], doc[~tail], words[~tail], low[~tail], high[~tail]
    return symbols, doc, words, low, high


def covering(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges, ends included, hold each of 0 to n - 1. Ranges may begin before 0."""
    own = last >= np.maximum(first, 0)
    steps = np.bincount(np.clip(first[own], 0, n), minlength=n + 1) - np.bincount(np.minimum(last[own] + 1, n), minlength=n + 1)
    return np.cumsum(steps[:n])


def deciding(symbols: np.ndarray, doc: np.ndarray, size: int, grown: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, doc, from, to) of the grown symbols that a window of ``size`` words can decide, each window having one at least.

    A window that decides no symbol, as in a long run, is a symbol itself. Documents have ``size`` words or more.
    """
    name, of, words, low, high = recompress(symbols, doc, grown, rounds)
    own = (words >= grown) & (high - low <= size)
    name, of, low, high = name[own], of[own], low[own], high[own]
    n = len(symbols)
    bare = covering(high - size, low, n) == 0
    bare[max(0, n - size + 1) :] = False
    bare[np.flatnonzero(np.diff(doc)) + 1 - size + np.arange(1, size)[:, None]] = False
    at = np.flatnonzero(bare)
    if not len(at):
        return name, of, low, high
    own = mixed(window_hashes(symbols[:, None], size)[at, 0])
    return np.r_[name, own], np.r_[of, doc[at]], np.r_[low, at], np.r_[high, at + size]


def parse(docs: DataFrame, id_col: str, text_col: str, size: int, grown: int, rounds: int) -> DataFrame:
    """Rows (doc_id, n_words, words_sha256, symbols): symbols are the different names that windows of the document decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts may be long, so a few rows at a time.
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                words = Words(list(utf8(part)))
                long = words.n[words.doc] >= size
                name, of, _, _ = deciding(words.numbers()[long], words.doc[long], size, grown, rounds)
                order = np.argsort(of, kind="stable")
                name, cuts = name[order], np.searchsorted(of[order], np.arange(part.num_rows + 1))
                found = [np.unique(name[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(words.n, pa.int64()), pa.array([hashlib.sha256(w).hexdigest() for w in words.joined()]), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_words", "words_sha256", "symbols"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(named(docs, id_col, text_col)).mapInArrow(run, f"doc_id {kind}, n_words long, words_sha256 string, symbols array<long>")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def window_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A row of numbers for each window of a document's words, from a row a word: sums of the words' numbers times powers of an odd base."""
    n = len(numbers)
    if n < size:
        return np.empty((0, numbers.shape[1]), np.uint64)
    power, back = powers(0, n)
    sums = np.concatenate([np.zeros((1, numbers.shape[1]), np.uint64), np.cumsum(numbers * power[:, None], axis=0, dtype=np.uint64)])
    return (sums[size:] - sums[: n - size + 1]) * back[: n - size + 1, None]


def candidate_windows(numbers: np.ndarray, doc: np.ndarray, shared: np.ndarray, size: int, grown: int, rounds: int) -> np.ndarray:
    """First words of the windows that decide no symbol but shared ones. ``shared`` is sorted and has all shared symbols of the documents."""
    n = max(0, len(numbers) - size + 1)
    name, _, low, high = deciding(numbers[:, 0], doc, size, grown, rounds)
    place = np.minimum(np.searchsorted(shared, name), max(len(shared) - 1, 0))
    alone = shared[place] != name if len(shared) else np.ones(len(name), bool)
    # The windows from high - size to low hold the words low to high.
    free = covering(high[alone] - size, low[alone], len(numbers)) == 0
    return np.flatnonzero(free[:n] & (doc[:n] == doc[size - 1 :])) if n else np.empty(0, int)


def windows(texts: DataFrame, size: int, grown: int, rounds: int) -> DataFrame:
    """Rows (doc_id, windows): the hashes of a document's different candidate windows. ``texts``: doc_id, text, shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                words = Words(list(utf8(part)))
                shared = np.unique(column(part, "shared").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                long = words.n[words.doc] >= size
                numbers, doc = words.both()[long], words.doc[long]
                starts = candidate_windows(numbers, doc, shared, size, grown, rounds)
                a, b = window_hashes(numbers, size)[starts].T
                of = doc[starts]
                order = np.lexsort((b, a, of))
                a, b, of = a[order], b[order], of[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])] if len(a) else np.empty(0, bool)
                a, b, of = a[new].view(np.int64), b[new].view(np.int64), of[new]
                # A document with very many windows has some rows of them.
                cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, int)
                cuts = np.unique(np.r_[cuts, np.arange(0, len(of), 1 << 16)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, np.int32(len(of))], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(pa.array(of[cuts])), lists], ["doc_id", "windows"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return in_small_batches(texts).mapInArrow(run, f"doc_id {kind}, windows array<struct<a: long, b: long>>")


def cut(texts: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, words_sha256, n_removed, kept): what is left without the words of removable windows. ``texts``: doc_id, text, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = column(batch, "windows"), []
            for i, text in enumerate(utf8(batch)):
                words = text.split()
                gone = lists[i].values
                gone = np.stack([gone.field(f).to_numpy(zero_copy_only=False).view(np.uint64) for f in (0, 1)], 1)
                starts = np.flatnonzero(among(window_hashes(Words([text]).both(), size), gone))
                stays = covering(starts, starts + size - 1, len(words)) == 0
                kept = b" ".join(w for w, stay in zip(words, stays.tolist()) if stay)
                out.append((hashlib.sha256(b" ".join(words)).hexdigest(), int((~stays).sum()), kept))
            shas, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(shas, pa.string()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "words_sha256", "n_removed", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return in_small_batches(texts).mapInArrow(run, f"doc_id {kind}, words_sha256 string, n_removed long, kept string")


def among(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which rows of two numbers are among the wanted ones."""
    wanted = wanted[np.lexsort(wanted.T[::-1])]
    left, right = (np.searchsorted(wanted[:, 0], rows[:, 0], side) for side in ("left", "right"))
    found = left < right
    found[found] = wanted[left[found], 1] == rows[found, 1]
    for i in np.flatnonzero(right - left > 1):
        found[i] = rows[i, 1] in wanted[left[i] : right[i], 1]
    return found


def with_words(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The texts of the documents in ``marks``, beside its columns. Up to BROADCAST_IDS ids are sent ahead, so that other texts stay where they are."""
    if marks.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    return docs.join(marks.hint("merge"), "doc_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, grown: int = GROWN, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words left, joined by one space; null where nothing is removed), words_sha256 (of all words), copy (all words are gone as a copy)."""
    own = named(docs, id_col, text_col)
    parsed = materialize(parse(docs, id_col, text_col, size, grown, rounds), "parsed")
    long = parsed.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    # Equal documents: all but those with the smallest id.
    least = long.groupBy("words_sha256").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    least = materialize(least, "repeated-texts")
    # A text that very many documents share is sent to these, and not they to it.
    sent = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS // 8 else df
    copies = materialize(long.select("doc_id", "words_sha256").join(sent(least), "words_sha256").filter("doc_id > least").select("doc_id", "words_sha256").distinct(), "copies")
    heads = long.join(sent(copies), ["doc_id", "words_sha256"], "left_anti")
    # Symbols, and which of them more than one document has.
    symbols = heads.select("doc_id", F.explode("symbols").alias("symbol"))
    several = symbols.groupBy("symbol").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("symbol")
    marks = materialize(symbols.join(several, "symbol").groupBy("doc_id").agg(F.collect_set("symbol").alias("shared")), "marks")
    found = materialize(windows(with_words(own, marks), size, grown, rounds), "windows").select("doc_id", F.explode("windows").alias("w"))
    first = found.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    gone = materialize(found.join(first, "w").filter("least < doc_id").groupBy("doc_id").agg(F.collect_set("w").alias("windows")), "gone")
    left = materialize(cut(with_words(own, gone), size).dropDuplicates(["doc_id", "words_sha256"]), "left")
    whole = parsed.drop("symbols").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "words_sha256"], "left").join(left, ["doc_id", "words_sha256"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return whole.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        "words_sha256",
    )
