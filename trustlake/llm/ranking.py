"""Ranked lexical search of a stated set of items over all documents, by presence masks.

A term's weight grows with its rarity, its share of a document's score with its occurrences there, against the document's
length; a score is a sum of whole numbers (``score`` has the formula).

1. Each document is cut into terms once; what is kept of it is its length and the occurrences of the items' terms, in a
   written table. The numbers of documents and terms and the documents of each term are counts over that table.
2. Documents are taken in blocks. In a block each term has a bitmap of the documents that hold it. An item's bitmaps, turned
   round, give each document's mask: which of the item's terms it holds. Documents are grouped by mask.
3. A mask's highest possible score is the sum, over its terms, of the highest share that any document of the block has. Masks
   are evaluated by descending highest score, until the next one is below the worst of the item's best k; these are
   carried on from block to block.
4. Each task sends the best k of each item; the best of these come from windows, first by a part of the ids and then by item.

Items are taken in blocks of BLOCK_TERMS different terms and BLOCK_ITEMS items (one pass over the documents for each block),
whose terms and weights go to all tasks; nothing else does.

Defined cases: a null or empty text, or one without letters and digits, has no terms, counts in nothing and is never a
result; documents without an id count in all numbers and are never results; rows that share an id are documents of
their own; of items that share an id (null is an id, too) the terms are put together; an item without terms, or none of whose
terms has a weight, has no results; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.llm.common import column, in_small_batches, materialize, utf8

K = 50
BLOCK_DOCS = 8192
BLOCK_ITEMS = 4096
BLOCK_TERMS = 1 << 15
#: Parts into which an item's results are dealt before they meet.
SALTS = 64
_TERM = [(48 <= c < 58) or (65 <= c < 91) or (97 <= c < 123) or c > 127 for c in range(256)]
_TABLE = bytes((c + 32 if 65 <= c < 91 else c) if own else 32 for c, own in enumerate(_TERM))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of letters, digits and all that is not ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight, of so many documents and documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_share(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m from its length: half of it is 50, half is its length against the mean."""
    return 100 - 50 + (50 * n * documents) // total


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with weight 1 and so many occurrences adds to a document's score."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_items: int, block_terms: int) -> Iterator[list[tuple[object, frozenset[bytes]]]]:
    """Items (id, terms) in blocks of a bounded size. An item with more terms than a block has is a block of its own."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct().orderBy("id")
    block, known, last = [], set(), None
    for row in rows.toLocalIterator():
        found = frozenset(terms((row.text or "").encode()))
        if block and row.id == last:
            block[-1] = (last, block[-1][1] | found)
        else:
            if block and (len(block) >= block_items or len(known | found) > block_terms):
                yield block
                block, known = [], set()
            block.append((row.id, found))
        known |= found
        last = row.id
    if block:
        yield block


def counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, terms, tf): the length, and the vocabulary's numbers with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own, tf = [], [], []
            for text in utf8(batch):
                words = terms(text)
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                n.append(len(words))
                own.append(list(found))
                tf.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tf"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(own).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Block:
    """Some documents and their terms: a row of ``terms`` and ``shares`` between two of ``starts`` for each document."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, shares: np.ndarray):
        self.ids, self.starts, self.terms, self.shares = ids, starts, terms, shares
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        self.present, place = np.unique(terms, return_inverse=True)
        self.highest = np.zeros(len(self.present), np.int64)
        np.maximum.at(self.highest, place, shares)
        parts = []
        order = np.argsort(place, kind="stable")
        for at in range(0, len(self.present), 1024):
            some = order[slice(*np.searchsorted(place[order], [at, at + 1024]))]
            dense = np.zeros((min(1024, len(self.present) - at), len(ids)), bool)
            dense[place[some] - at, doc[some]] = True
            parts.append(np.packbits(dense, axis=1))
        self.bitmaps = np.concatenate(parts) if parts else np.empty((0, (len(ids) + 7) // 8), np.uint8)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(masks as rows of bits over the bitmaps ``rows``, place of each document's mask)."""
        turned = np.packbits(np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.ids)), axis=0)
        wide = np.zeros((len(self.ids), -(-len(turned) // 8) * 8), np.uint8)
        wide[:, : len(turned)] = turned.T
        keys = wide.view(np.uint64)
        place = np.unique(keys[:, 0], return_inverse=True)[1]
        for k in range(1, keys.shape[1]):
            place = np.unique(place * len(self.ids) + np.unique(keys[:, k], return_inverse=True)[1], return_inverse=True)[1]
        one = np.zeros(place.max() + 1, np.int64)
        one[place] = np.arange(len(place))
        return np.unpackbits(wide[one], axis=1, count=len(rows)), place

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of some documents. ``weights``: of each term that is present, zero for those the item has not."""
        n = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - ends + n, n)
        sums = np.r_[0, np.cumsum(weights[np.searchsorted(self.present, self.terms[at])] * self.shares[at])]
        return sums[ends] - sums[ends - n]

    def best(self, terms: np.ndarray, weights: np.ndarray, known: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k (score, id) of an item, of this block and of those that are known."""
        rows = np.searchsorted(self.present, terms)
        own = (rows < len(self.present)) & (weights > 0)
        own[own] = self.present[rows[own]] == terms[own]
        rows, weights = rows[own], weights[own]
        if not len(rows):
            return known
        bits, place = self.masks(rows)
        highest = bits @ (weights * self.highest[rows])
        by_mask = np.argsort(place, kind="stable")
        begin = np.searchsorted(place[by_mask], np.arange(len(highest) + 1))
        order = np.argsort(-highest, kind="stable")
        order = order[: np.searchsorted(-highest[order], 0)]
        of_term = np.zeros(len(self.present), np.int64)
        of_term[rows] = weights
        score, ids = known
        at, step = 0, 1
        while at < len(order):
            least = score[-1] if len(score) == k else 0
            group = order[at : at + step]
            group = group[highest[group] >= least]
            if not len(group):
                break
            docs = np.concatenate([by_mask[begin[g] : begin[g + 1]] for g in group])
            new = self.scores(docs, of_term)
            own = new >= max(least, 1)
            score, ids = np.r_[score, new[own]], np.r_[ids, self.ids[docs[own]]]
            first = np.lexsort((ids, -score))[:k]
            score, ids = score[first], ids[first]
            at, step = at + step, min(step * 2, 256)
        return score, ids


def best_of_tasks(known: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], documents: int, total: int, k: int, block_docs: int) -> DataFrame:
    """Rows (item, doc_id, score): the best k of each item in each task. ``queries``: an item's terms, sorted, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)

        def take(parts: list[pa.RecordBatch]) -> None:
            held = pa.Table.from_batches(parts).combine_chunks()
            lists = held.column("terms").combine_chunks()
            lists, tf = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (lists, held.column("tf").combine_chunks()))
            n = held.column("n").to_numpy()
            starts = lists.offsets.to_numpy().astype(np.int64)
            tf = tf.flatten().to_numpy().astype(np.int64)
            shares = share(tf, np.repeat(length_share(n, documents, total), np.diff(starts)))
            block = Block(held.column("doc_id").to_numpy(), starts - starts[0], lists.flatten().to_numpy(), shares)
            for i, (own, weights) in enumerate(queries):
                best[i] = block.best(own, weights, best[i], k)

        parts, rows = [], 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= block_docs:
                take(parts)
                parts, rows = [], 0
        if rows:
            take(parts)
        for i, (score, ids) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids), pa.array(score)], ["item", "doc_id", "score"])

    return in_small_batches(known).mapInArrow(run, "item int, doc_id long, score long")


def rank(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_docs: int = BLOCK_DOCS, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending id. Ids of documents are whole numbers."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items, item_col, item_text_col, block_items, block_terms):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
        known = materialize(counts(docs, vocabulary, id_col, text_col), "term-counts")
        documents, total = known.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not documents:
            break
        holding = dict(known.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        queries = []
        for _, own in block:
            numbers = sorted(vocabulary[t] for t in own)
            queries.append((np.array(numbers, np.int32), np.array([weight(documents, holding.get(t, 0)) for t in numbers], np.int64)))
        found = best_of_tasks(known.filter("doc_id IS NOT NULL AND size(terms) > 0"), queries, documents, total, k, block_docs)
        order = [F.desc("score"), F.asc("doc_id")]
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
