"""Spelling variants: words that differ by one edit, and for each word the far more frequent one it is a variant of.

Words are runs of letters, A-Z lower-cased, some of them damaged as ``words`` says. Two words are near if exactly one code
point is inserted, deleted or replaced between them. The near pairs are what is accepted by the composition of the vocabulary's
acceptor, a transducer that makes one edit, and the acceptor again.

1. Initial states. Of a near pair let l be the length of the shorter word. Where the edit stands behind its first l div 2
   code points, both words begin with the same so many; else they end with the same l - l div 2. So each word is dealt out
   four times, as the shorter or the longer word of a pair, by its beginning or by its end, with l; a group is the words
   that have read such a beginning (or, backwards, such an end): one initial state of the composition. A group holds words
   of two lengths only. One with more than SLICE_WORDS words is cut into slices, and each pair of slices is a group.
2. A task takes some groups at a time, makes one minimal acceptor of what is left of their words (states with equal
   languages are one), and follows the composition from the groups' initial states, all states of a step at once. A pair of
   states goes on while both accept words of the length that is left; skip counts at the transitions give the words' numbers.
3. Each task sends, for each word, the number of near words and the best one that it met; a pair is met in one group only,
   so these are summed up and compared.
4. Forms are followed by joins that double the way; a form is ten times as frequent, so the ways are short.

Defined cases: a null or empty text has no words; in rows without an id nothing is damaged; repeated rows count again;
words may be of any length; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, discard, materialize
from trustlake.llm.substrings import mixed

MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times as frequent a form is.
TIMES = 10
#: One in so many runs of a document is damaged.
DAMAGED = 31
SLICE_WORDS = 1 << 16
#: Code points that a task turns into one acceptor, and pairs of states that it follows at once.
_CHUNK_CODES = 1 << 22
_PAIRS = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (word, n): the words with their occurrences.

    Let h be the CRC-32 of "id:run". Where DAMAGED divides h, the run loses its code point h modulo its length, from 0.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    run = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


class Acceptor:
    """The minimal acceptor of the strings of some groups, with a trie of them.

    Strings are rows of code points, sorted by group and then by themselves. A node of the trie is a beginning of some rows,
    ``first`` the first of these, ``state`` what may follow it; its children are the nodes from ``child[i]`` to
    ``child[i + 1]``. A state's transitions are those from ``begin[q]`` to ``begin[q + 1]``: ``char``, ``target``, and
    ``skip``, the number of its words before them. ``short`` and ``long``: lengths of the words that a state accepts.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, group: np.ndarray):
        rows, width = codes.shape
        same = np.zeros(rows, np.int32)
        differ = codes[1:] != codes[:-1]
        same[1:] = np.where(differ.any(1), differ.argmax(1), width)
        same[np.r_[True, group[1:] != group[:-1]]] = -1
        parts, before, firsts = [], 0, None
        for depth in range(width + 1):
            cuts = np.flatnonzero(same < depth)
            least, most = np.minimum.reduceat(lengths, cuts), np.maximum.reduceat(lengths, cuts)
            own = least >= depth
            first, least, most = cuts[own], least[own], most[own]
            if not len(first):
                break
            parent = before + np.searchsorted(firsts, first, "right") - 1 if depth else np.full(len(first), -1)
            char = codes[first, depth - 1] if depth else np.zeros(len(first), np.uint16)
            parts.append((first, np.full(len(first), depth), least - depth, most - depth, parent, char))
            before, firsts = before + (len(firsts) if depth else 0), first
        self.first, self.depth, self.node_short, self.node_long, parent, self.node_char = (np.concatenate(p) for p in zip(*parts))
        nodes, roots = len(self.first), len(parts[0][0])
        # Children stand in the order of their parents, behind the roots.
        self.child = roots + np.searchsorted(parent[roots:], np.arange(nodes + 1))
        self.group = group[self.first]
        self.state = self.minimised()
        one = np.zeros(self.state.max() + 1, np.int64)
        one[self.state] = np.arange(nodes)
        n = self.child[one + 1] - self.child[one]
        self.begin = np.r_[0, np.cumsum(n)]
        edge = ranges(self.child[one], n)
        self.char, self.target = self.node_char[edge].astype(np.int64), self.state[edge]
        self.skip = self.first[edge] - np.repeat(self.first[one], n)
        self.short, self.long = self.node_short[one], self.node_long[one]
        self.keys = np.repeat(np.arange(len(one)), n) << 16 | self.char

    def minimised(self) -> np.ndarray:
        """The number of each node's state; nodes with equal languages have one. From the leaves up, by the longest word left."""
        state, known = np.zeros(len(self.first), np.int64), 0
        order = np.argsort(self.node_long, kind="stable")
        cuts = np.searchsorted(self.node_long[order], np.arange(self.node_long.max() + 2))
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            if not len(own):
                continue
            n = self.child[own + 1] - self.child[own]
            edge = ranges(self.child[own], n)
            starts = np.r_[0, np.cumsum(n)[:-1]]
            for seed in count():
                name = mixed((self.node_char[edge].astype(np.uint64) << np.uint64(40) | state[edge].astype(np.uint64)) + np.uint64(seed << 60))
                name = np.add.reduceat(np.r_[name, np.uint64(0)], starts) * (n > 0) + (self.node_short[own] == 0)
                _, one, place = np.unique(name, return_index=True, return_inverse=True)
                # Equal names must stand for equal transitions.
                if (n == n[one[place]]).all():
                    like = ranges(self.child[own[one[place]]], n)
                    if (self.node_char[edge] == self.node_char[like]).all() and (state[edge] == state[like]).all() and ((self.node_short[own] == 0) == (self.node_short[own[one[place]]] == 0)).all():
                        break
            state[own] = known + place
            known += len(one)
        return state

    def accepts(self, state: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Whether a state accepts words of so many code points. (All its words are of two neighbouring lengths.)"""
        return (self.short[state] == left) | (self.long[state] == left)

    def near(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one group that one edit makes equal: a row of the group's ``low`` length and one as long or longer by one."""
        n = self.child[1:] - self.child[:-1]
        left = low[self.group] - self.depth
        cost = np.cumsum(n * (n + 1) // 2)
        found = [np.empty((2, 0), np.int64)]
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + _PAIRS, "right")))
            found += self.follow(*self.edits(np.arange(at, end), n[at:end], left[at:end]))
            at = end
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return a, b

    def edits(self, node: np.ndarray, n: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(state, state, length left, row, row) after the edit, for each place where the two words may part."""
        edge, of = ranges(self.child[node], n), np.repeat(np.arange(len(node)), n)
        # Inserted: the second word reads one code point, the first none.
        inserted = self.state[node][of], self.state[edge], left[of], self.first[node][of], self.first[edge]
        # Replaced: each child beside those behind it.
        rest = np.repeat(np.cumsum(n), n) - np.arange(len(edge)) - 1
        a, b = np.repeat(edge, rest), ranges(edge + 1, rest)
        replaced = self.state[a], self.state[b], np.repeat(left[of] - 1, rest), self.first[a], self.first[b]
        return tuple(map(np.concatenate, zip(inserted, replaced)))

    def follow(self, p: np.ndarray, q: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """What both states of a pair accept, code point by code point."""
        while True:
            own = (left >= 0) & self.accepts(p, left) & self.accepts(q, left)
            p, q, left, a, b = p[own], q[own], left[own], a[own], b[own]
            over = left == 0
            yield np.stack([a[over], b[over]])
            p, q, left, a, b = p[~over], q[~over], left[~over], a[~over], b[~over]
            if not len(p):
                return
            n = self.begin[p + 1] - self.begin[p]
            edge, of = ranges(self.begin[p], n), np.repeat(np.arange(len(p)), n)
            wanted = q[of] << 16 | self.char[edge]
            other = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            both = self.keys[other] == wanted
            edge, other, of = edge[both], other[both], of[both]
            p, q, left, a, b = self.target[edge], self.target[other], left[of] - 1, a[of] + self.skip[edge], b[of] + self.skip[other]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from start to start + n of each range, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n)


def dealt(vocabulary: DataFrame, min_length: int, slice_words: int) -> DataFrame:
    """Rows (back, l, key, x, y, mine, tail, n), whole groups in a partition and sorted.

    A word is the key and then the tail, or both the other way round and backwards where ``back``.
    """
    shorter = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("l")
    both = vocabulary.select("word", "n", shorter).filter(F.col("l") >= min_length)
    half, size = F.floor(F.col("l") / 2).cast("int"), F.length("word")
    ends = F.col("l") - half
    side = lambda back, key, tail: F.struct(F.lit(back).alias("back"), key.alias("key"), tail.alias("tail"))
    sides = F.array(side(False, F.substr("word", F.lit(1), half), F.substr("word", half + 1)), side(True, F.reverse(F.substr("word", size - ends + 1)), F.reverse(F.substr("word", F.lit(1), size - ends))))
    keyed = both.select("l", "n", F.explode(sides).alias("s")).select("s.back", "l", "s.key", "s.tail", "n")
    large = keyed.groupBy("back", "l", "key").count().filter(F.col("count") > slice_words).select("back", "l", "key", F.ceil(F.col("count") / slice_words).cast("int").alias("slices"))
    cut = keyed.join(materialize(large, "large-groups"), ["back", "l", "key"], "left").fillna(1, ["slices"])
    mine = F.pmod(F.xxhash64("tail"), F.col("slices")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda o: F.struct(F.least("mine", o).alias("x"), F.greatest("mine", o).alias("y")))
    sliced = cut.withColumn("mine", mine).select("back", "l", "key", F.explode(pair).alias("p"), "mine", "tail", "n").select("back", "l", "key", "p.x", "p.y", "mine", "tail", "n")
    keys = ["back", "l", "key", "x", "y"]
    return sliced.repartition(*keys).sortWithinPartitions(*keys, "tail")


def best_near(batch: pa.Table) -> pa.RecordBatch:
    """Rows (word, n_near, form_n, form) of the words that have near ones in these groups."""
    take = lambda name: batch.column(name).to_numpy()
    back, l, x, y, mine, n = (take(c) for c in ("back", "l", "x", "y", "mine", "n"))
    key, tail = batch.column("key").combine_chunks(), batch.column("tail").combine_chunks()
    new = np.r_[True, (back[1:] != back[:-1]) | (l[1:] != l[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    numbers = key.dictionary_encode().indices.to_numpy()
    new[1:] |= numbers[1:] != numbers[:-1]
    group = np.cumsum(new) - 1
    tails = tail.to_pylist()
    lengths = np.fromiter(map(len, tails), np.int64, len(tails))
    codes = np.zeros((len(tails), lengths.max()), np.uint16)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(tails).encode("utf-16-le"), np.uint16)
    # What the shorter word has behind the key.
    low = np.where(back, l // 2, l - l // 2)[new]
    a, b = Acceptor(codes, lengths, group).near(low)
    own = (x[a] == y[a]) | (mine[a] != mine[b])
    # Pairs that agree on the first half as well are met there: backwards, the longer word then has one code point before the shorter one.
    again = back[a] & (lengths[b] > lengths[a])
    if again.any():
        again[again] = (codes[b[again], 1:] == codes[a[again], :-1]).all(1) & (codes[a[again], -1] == 0)
    own &= ~again
    a, b = a[own], b[own]
    rows, place = np.unique(np.r_[a, b], return_inverse=True)
    if not len(rows):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), *[pa.array([], pa.int64())] * 2, pa.array([], pa.string())], ["word", "n_near", "form_n", "form"])
    text = [(k + t)[::-1] if r else k + t for k, t, r in zip(key.take(pa.array(rows)).to_pylist(), (tails[i] for i in rows.tolist()), back[rows])]
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=text.__getitem__)] = np.arange(len(rows))
    one, other = place, np.r_[place[len(a) :], place[: len(a)]]
    order = np.lexsort((rank[other], -n[rows[other]], one))
    first = order[np.r_[True, np.diff(one[order]) > 0]]
    best = other[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(text), pa.array(np.bincount(one, minlength=len(rows)), pa.int64()), pa.array(n[rows[best]], pa.int64()), pa.array([text[i] for i in best.tolist()])], ["word", "n_near", "form_n", "form"]
    )


def near_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, slice_words: int = SLICE_WORDS, chunk_codes: int = _CHUNK_CODES) -> DataFrame:
    """Rows (word, n_near, form_n, form) of the words that have near ones: how many, and the most frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cost = [], 0
        for batch in batches:
            held.append(batch)
            cost += int(column(batch, "l").to_numpy().sum())
            if cost >= chunk_codes:
                table = pa.Table.from_batches(held)
                last = table.num_rows - 1
                same = np.ones(table.num_rows, bool)
                for name in ("back", "l", "key", "x", "y"):
                    values = table.column(name)
                    same &= pa.compute.equal(values, values[last]).to_numpy()
                whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if whole:
                    yield best_near(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                cost = int(table.column("l").slice(whole).to_numpy().sum())
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield best_near(table)

    met = dealt(vocabulary, min_length, slice_words).mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from (word, root) of one step: the last word on the way. Each round doubles the way."""
    state = materialize(forms, "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = materialize(state.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(state)
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        state = now.drop("moved")


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of all words."""
    vocabulary = materialize(words(docs, id_col, text_col, min_length, min_count), "vocabulary")
    near = near_words(vocabulary, min_length, slice_words)
    known = materialize(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form_n") >= times * F.col("n"), F.struct("form", "form_n")).alias("f")), "near-words")
    root = roots(known.filter("f IS NOT NULL").select("word", F.col("f.form").alias("root")))
    return known.join(root, "word", "left").select("word", "f.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "f.form_n")
