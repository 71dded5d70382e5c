"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Kernel: the normalised subsequence kernel of order 3 (every common subsequence of three characters counts, each skipped
character costs a factor), between a word and a landmark. Long words are taken in overlapping windows, words with
characters that are no letters or digits also without them, and runs of single characters as one word, so an insult
with inserted or spaced-out characters stays near its plain form. A sentence has, for each landmark, the kernel's
largest value over its words; ``K(L, L)^(-1/2)`` maps these to features.

Training takes a bounded sample of labelled rows (``sample_toxic`` and ``sample_clean`` documents, by the hash of their
ids). Landmarks are word beginnings that cover many toxic and few clean documents, and some frequent clean words. The
machine is trained on labelled sentences: all of a clean document's that come near a landmark, and of a toxic document
those that all but hold a toxic landmark and the one that is most toxic so far (three rounds), and toxic landmarks with
a character put in. A document's margin is its most toxic sentence's; a logistic
curve, fitted on the sample, turns it into a score from 0 to 1. Scoring is one pass over whole texts.

Defined cases: a null or empty text has the margin of a sentence that is near no landmark; labels that are null are no
labels, and an id with several labels is toxic if one of them is; without labels of both kinds every score is 0; repeated
rows have equal scores; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, texts

DECAY = 0.6
WINDOW, STRIDE = 9, 3
LANDMARKS, NEUTRAL = 48, 4
#: Kernel values under this are taken as none.
FLOOR = 0.35
#: A sentence of a toxic document that comes this near a toxic landmark is taken as toxic from the start.
SURE = 0.8
#: Characters put into toxic landmarks to make further training sentences.
INSERTED = "xz"
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 3000
#: Chance that any beginning is taken for a toxic one though it is not.
CHANCE = 0.01
MEMO = 400_000
THRESHOLD = 0.7
_PLAIN = re.compile(r"[\W_]+")


def codes(strings: list[str], width: int) -> np.ndarray:
    """Characters as numbers, 0 after the end."""
    return np.array(strings, f"<U{width}").view(np.uint32).reshape(-1, width).astype(np.int32)


def subsequences(a: np.ndarray, b: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """The kernel of order 3 of each row of ``a`` with the row of ``b`` beside it."""
    rows, width = b.shape
    powers = np.arange(width)
    lower = np.where(powers[:, None] <= powers[None, :], decay ** np.abs(powers[None, :] - powers[:, None]).astype(np.float32), 0).astype(np.float32)
    b = np.where(b == 0, -1, b)
    # Entry j of these stands for the part of b before character j.
    one, two = (np.zeros((rows, width + 1), np.float32) for _ in range(2))
    total = np.zeros(rows, np.float32)
    for k in range(a.shape[1]):
        same = (a[:, k, None] == b).astype(np.float32) * np.float32(decay * decay)
        total += (same * two[:, :-1]).sum(1)
        two *= decay
        two[:, 1:] += (same * one[:, :-1]) @ lower
        one *= decay
        one[:, 1:] += same @ lower
    return total


def masks(coded: np.ndarray) -> np.ndarray:
    """The set of a string's characters, in 61 bits."""
    bits = np.where(coded > 0, np.uint64(1) << (coded % 61).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


class Kernel:
    """Kernel values of words with a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = codes(landmarks, WINDOW)
        self.own = np.sqrt(np.maximum(subsequences(self.codes, self.codes), 1e-12))
        self.masks = masks(self.codes)
        distinct = np.bitwise_count(self.masks)
        self.least = distinct - (distinct >= 6)

    def of_windows(self, windows: list[str]) -> np.ndarray:
        """Normalised values, 0 where too few of a landmark's characters are there at all."""
        out = np.zeros((len(windows), len(self.landmarks)), np.float32)
        coded = codes(windows, WINDOW)
        shared = np.bitwise_count(masks(coded)[:, None] & self.masks[None, :])
        near = np.flatnonzero((shared >= self.least).any(1))
        if not len(near):
            return out
        coded = coded[near]
        own = np.sqrt(np.maximum(subsequences(coded, coded), 1e-12))
        i, j = np.nonzero(shared[near] >= self.least)
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            out[near[x], y] = subsequences(coded[x], self.codes[y]) / (own[x] * self.own[y])
        return out

    def of_words(self, words: list[str]) -> np.ndarray:
        """Largest value over a word's windows; values under FLOOR are 0."""
        windows: dict[str, int] = {}
        at, to = [], []
        for i, word in enumerate(words):
            form = word.strip(".,;:!?\"'()[]")
            for form in (form,) if form.isalnum() else (form, _PLAIN.sub("", form)):
                for k in range(0, max(1, len(form) - WINDOW + STRIDE), STRIDE):
                    at.append(i)
                    to.append(windows.setdefault(form[k : k + WINDOW], len(windows)))
        values = self.of_windows(list(windows))[to]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        np.maximum.at(out, at, values)
        out[out < FLOOR] = 0
        return out


class Sentences:
    """Kernel values of the sentences of texts that come near a landmark, with a memo of words."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.memo, self.rows = kernel, {}, []

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            values = self.kernel.of_words(part)
            for word, near, row in zip(part, values.any(1).tolist(), values):
                code = 0
                if len(word) == 1:
                    code = -1
                elif near:
                    # A copy, since a view would keep the whole array.
                    self.rows.append(row.copy())
                    code = len(self.rows)
                self.memo[word] = code

    def of(self, batch: list[str]) -> list[np.ndarray]:
        """For each text, a row of values for each such sentence."""
        if len(self.memo) > MEMO:
            self.memo, self.rows = {}, []
        split, new = [], {}
        for text in batch:
            words = text.lower().split()
            found = list(map(self.memo.get, words))
            if None in found:
                new.update((w, None) for w, c in zip(words, found) if c is None)
                found = None
            split.append((words, found))
        self.learn(list(new))
        out = []
        for words, found in split:
            code = np.array(list(map(self.memo.get, words)) if found is None else found, np.int64)
            spots = [(int(i), self.rows[code[i] - 1]) for i in np.flatnonzero(code > 0)]
            single = np.flatnonzero(code < 0)
            if len(single) >= 3:
                for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1):
                    if len(run) >= 3:
                        value = self.kernel.of_words(["".join(words[i] for i in run)])[0]
                        if value.any():
                            spots.append((int(run[0]), value))
            if not spots:
                out.append(np.empty((0, len(self.kernel.landmarks)), np.float32))
                continue
            ends = np.cumsum([w[-1] in ".!?" for w in words])
            sentence: dict[int, np.ndarray] = {}
            for i, value in spots:
                k = int(ends[i - 1]) if i else 0
                sentence[k] = np.maximum(sentence[k], value) if k in sentence else value
            out.append(np.stack(list(sentence.values())))
        return out


def choose_landmarks(toxic: list[str], clean: list[str]) -> list[str]:
    """Word beginnings that tell toxic documents from clean ones, and the most frequent clean words.

    A greedy cover of the toxic documents by beginnings; when all that can be are covered, another cover begins with
    beginnings that neither begin nor continue a chosen one, until no more are left. Whole words fill up the list.
    """

    def words(text: str) -> set[str]:
        return {w.strip(".,;:!?\"'()[]") for w in text.lower().split()}

    def starts(own: set[str]) -> set[str]:
        return {w[:n] for w in own for n in range(4, min(len(w), WINDOW) + 1)}

    bags = [words(text) for text in toxic]
    hits = Counter(s for own in bags for s in starts(own))
    # So many that chance would hardly put them into toxic documents alone for any of the beginnings that there are.
    share, tried = len(toxic) / (len(toxic) + len(clean)), sum(n > 1 for n in hits.values())
    floor = max(3, len(toxic) // 33, math.ceil(math.log(CHANCE / max(1, tried)) / math.log(share)))
    hits = {s: n for s, n in hits.items() if n >= floor}
    seen, common = Counter(), Counter()
    for text in clean:
        own = words(text)
        seen.update(s for s in starts(own) if s in hits)
        common.update(w for w in own if 4 <= len(w) <= WINDOW)
    good = {s for s, n in hits.items() if n / len(toxic) >= 15 * (seen[s] + 0.5) / len(clean)}
    bags = [(starts(own) & good, {w for w in own if len(w) <= WINDOW and starts({w}) & good}) for own in bags]
    out: list[str] = []
    for _ in range(LANDMARKS):
        left = [{s for s in own if not any(s.startswith(o) or o.startswith(s) for o in out)} for own, _ in bags]
        weight, before = Counter(s for own in left for s in own), len(out)
        while weight and len(out) < LANDMARKS:
            # Of beginnings that cover the same documents, the longest.
            best = max(weight, key=lambda s: (weight[s], len(s), s))
            if weight[best] < floor:
                break
            out.append(best)
            for own in left:
                if best in own:
                    weight.subtract(own)
                    own.clear()
            weight = +weight
        if len(out) in (before, LANDMARKS):
            break
    full = Counter(w for _, own in bags for w in own if w not in out and any(w.startswith(s) for s in out))
    out += [w for w, _ in sorted(full.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS - len(out)]]
    return out + [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if w not in out][:NEUTRAL]


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 50) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted alike, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * len(y)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xa, ya, sa = x[inside], y[inside], share[inside]
        new = np.linalg.solve(ridge + (xa * sa[:, None]).T @ xa, xa.T @ (sa * ya))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve with Platt's targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w, z = np.array([1.0, 0.0]), np.c_[x, np.ones(len(x))]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - goal))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """Landmarks, the weights of their kernel values, and the logistic curve."""

    def __init__(self, toxic: list[str], clean: list[str]):
        self.kernel = Kernel(choose_landmarks(toxic, clean))
        gram = self.kernel.of_windows(self.kernel.landmarks).astype(float)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        sentences = Sentences(self.kernel)
        near = [sentences.of(part) for part in (toxic, clean)]
        bags, none = [[v @ root for v in part] for part in near], np.zeros((1, len(root)))
        bags = [[b if len(b) else none for b in part] for part in bags]
        marked = len(self.kernel.landmarks) - NEUTRAL
        worst = [b[np.argmax(v.max(1))][None] if len(v) else none for b, v in zip(bags[0], near[0])]
        sure = [b[v[:, :marked].max(1, initial=0) >= SURE] for b, v in zip(bags[0], near[0]) if len(v)]
        gapped = [w[:i] + c + w[i:] for w in self.kernel.landmarks[:marked] for i in range(2, len(w) - 1) for c in INSERTED if len(w) < WINDOW]
        sure.append(self.kernel.of_words(gapped) @ root if gapped else none[:0])
        negative = np.concatenate([*bags[1], none])
        for _ in range(3):
            positive = np.concatenate([*worst, *sure])
            w = svm(np.concatenate([positive, negative]), np.r_[np.ones(len(positive)), -np.ones(len(negative))])
            worst = [b[np.argmax(b @ w[:-1])][None] for b in bags[0]]
        self.weights, self.bias = root @ w[:-1], float(w[-1])
        margins = np.array([(b @ w[:-1]).max() + self.bias for part in bags for b in part])
        self.slope, self.offset = logistic(margins, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])

    def scores(self, near: list[np.ndarray]) -> list[float]:
        out = []
        for values in near:
            margin = self.bias + (float((values @ self.weights).max()) if len(values) else 0.0)
            out.append(float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))))
        return out


def learnable(id_col: F.Column) -> F.Column:
    """Whether the labels of an id may be learned from; the others are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model | None:
    """A model of the learnable labels; None without labels of both kinds."""
    own = labels.filter(F.col(label_col).isNotNull() & learnable(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    first = lambda label, n: own.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    # At most sample_toxic + sample_clean ids: bounded, whatever the tables.
    chosen = first(1, sample_toxic).union(first(0, sample_clean))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("label", "text").dropDuplicates().collect()
    toxic, clean = (sorted(r.text for r in rows if r.label == k and r.text) for k in (1, 0))
    return Model(toxic, clean) if toxic and clean else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score)."""
    kind = docs.schema[id_col].dataType.simpleString()
    # Of a size that the landmarks fix.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sentences = Sentences(own.kernel) if own else None
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                scores = own.scores(sentences.of(list(texts(part)))) if own else [0.0] * part.num_rows
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return in_small_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sentences = Sentences(own.kernel) if own else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if own:
                    part = part.filter(pa.array([s < threshold for s in own.scores(sentences.of(list(texts(part, text_col))))], pa.bool_()))
                yield part

    return in_small_batches(docs).mapInArrow(run, docs.schema)
