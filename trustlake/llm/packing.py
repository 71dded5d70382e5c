"""Harmonic packing of tokenized documents into sequences.

Lengths fall into reciprocal-capacity classes: a length of over capacity / (j + 1) and at most capacity / j is of class j,
and each bin of that class takes exactly j documents. A task has one open bin for each class that it has met (at most
twice the capacity's square root) and never talks to another.

Harmonic bins leave room, and documents may be cut, so that room is filled: a bin that has its j documents is closed
as soon as the next document gives it the tokens that it lacks. What is left of that document goes on as any other
does: whole sequences first, then its rest into the bin of the rest's class. A document is thus cut into at most two
pieces beside whole sequences, and a bin that has waited for one document has no padding.

When a task's rows end, the documents of its open bins are laid end to end, largest first, into further sequences; here a document is cut wherever a sequence ends. The last of these sequences is dealt into sequences
of power-of-two length, which take no padding. Such further cuts number at most one for each class, and one for each bit
of the capacity, in a task, however many documents it has.

Defined cases: a null or empty text has the end token alone; ids may be null or repeat, each row is a document of its
own; ties do not arise, since rows are taken in their order; other columns are ignored; an empty table makes no piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.bpe import ChunkMemo
from trustlake.llm.common import column, in_small_batches, texts

CAPACITY = 1024
END_ID = 0
#: Documents tokenized at a time, and new words in one call of the tokenizer.
BATCH = 256
CALL_WORDS = 512
MEMO = 1_000_000

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer(path: str) -> ChunkMemo:
    """Ids of texts by the tokenizers library, without adding special tokens, as little-endian 32-bit bytes.

    The tokenizer is byte-level, so its words never reach over a single space; the memo hands it each new word once.
    Words are sent many to a call, joined, and an id whose token begins with a space begins the next word. A text that
    holds one of the tokenizer's special tokens is sent whole.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    tokens = [own.id_to_token(i) or "" for i in range(own.get_vocab_size(with_added_tokens=True))]
    opens = np.array([t.startswith("\u0120") for t in tokens])
    # In the byte alphabet of the vocabulary a letter is a byte.
    sizes = np.array(list(map(len, tokens)))
    special = [t.content for t in own.get_added_tokens_decoder().values()]

    def of_texts(whole: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in own.encode_batch_fast(whole, add_special_tokens=False)]

    def of_words(words: list[str]) -> list[bytes]:
        calls = [words[at : at + CALL_WORDS] for at in range(0, len(words), CALL_WORDS)]
        out = []
        for call, coded in zip(calls, own.encode_batch_fast(list(map("".join, calls)), add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            starts = np.flatnonzero(opens[ids])
            if len(starts) != len(call) or starts[0] or np.add.reduceat(sizes[ids], starts).tolist() != list(map(len, map(str.encode, call))):
                # The runs of ids are not the words: each word is sent alone.
                out += of_texts(call)
                continue
            cuts = [*(starts * 4).tolist(), len(ids) * 4]
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    return ChunkMemo(of_words, of_texts, lambda text: any(s in text for s in special), most=MEMO)


class Bins:
    """The open bins of one task. ``placed`` has (id, tokens of the document, start, ids, sequence, offset) of each piece that has its place."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity = first, capacity
        #: Pieces are (id, tokens of the document, start, ids). Class: the documents of its open bin; then the one bin
        #: that has its number of documents and room left.
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple] = []
        self.room = 0
        self.placed: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.placed.append((*piece, self.next, offset))
            offset += len(piece[3])
        self.next += 1

    def put(self, doc_id, tokens: np.ndarray) -> None:
        n, start = len(tokens), 0
        if self.room:
            start = min(n, self.room)
            self.waiting.append((doc_id, n, 0, tokens[:start].copy()))
            self.room -= start
            if not self.room:
                self.close(self.waiting)
                self.waiting = []
        while n - start >= self.capacity:
            self.close([(doc_id, n, start, tokens[start : start + self.capacity])])
            start += self.capacity
        if start == n:
            return
        kind = self.capacity // (n - start)
        held = self.open.setdefault(kind, [])
        # A copy, so that no long document is held.
        held.append((doc_id, n, start, tokens[start:].copy()))
        if len(held) < kind:
            return
        self.open[kind] = []
        room = self.capacity - sum(len(piece[3]) for piece in held)
        if room:
            # The bin that waited before was filled by this document.
            self.waiting, self.room = held, room
        else:
            self.close(held)

    def end(self) -> None:
        """Places what is left: full sequences, then sequences of power-of-two length."""
        left = self.waiting + [piece for kind in sorted(self.open) for piece in self.open[kind]]
        total = sum(len(piece[3]) for piece in left)
        goal, own = 0, []
        for doc_id, n, start, ids in left:
            while len(ids):
                goal = goal or min(self.capacity, 1 << total.bit_length() - 1)
                take = min(len(ids), goal)
                own.append((doc_id, n, start, ids[:take]))
                start, ids, goal, total = start + take, ids[take:], goal - take, total - take
                if not goal:
                    self.close(own)
                    own = []
        self.open, self.waiting, self.room = {}, [], 0

    def taken(self) -> list[tuple]:
        out, self.placed = self.placed, []
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if ``with_ids``, ids.

    ``capacity`` is a power of two. ``tokenizer_path`` is a file of the tokenizers library that every worker can read.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = tokenizer(tokenizer_path).encode
        bins = Bins(TaskContext.get().partitionId() << 40, capacity)
        end = np.array(end_id, "<u4").tobytes()
        id_kind = None

        def made() -> pa.RecordBatch:
            rows = bins.taken()
            cols = list(zip(*((i, start, len(own), zlib.crc32(own), n, at, offset) for i, n, start, own, at, offset in rows))) or [()] * 7
            arrays = [pa.array(cols[0], id_kind), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([row[3].astype(np.int32) for row in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            ids = column(batch, "doc_id")
            id_kind = ids.type
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                for doc_id, coded in zip(ids.slice(at, BATCH).to_pylist(), encode(list(texts(part)))):
                    bins.put(doc_id, np.frombuffer(coded + end, "<u4"))
                yield made()
        if id_kind is not None:
            bins.end()
            yield made()

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(own).mapInArrow(run, f"doc_id {kind}, {SCHEMA}" + ", ids array<int>" * with_ids)
