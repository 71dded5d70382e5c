"""Harmonic classes, cuts and the ids of joined words."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustlake.llm import packing

P = pytest.importorskip("public_tokenizers")


def placed(lengths, capacity=1024):
    bins = packing.Bins(0, capacity)
    for i, n in enumerate(lengths):
        bins.put(i, np.arange(n, dtype="<u4"))
    before = len(bins.placed)
    bins.end()
    return [(i, n, start, len(ids), at, offset) for i, n, start, ids, at, offset in bins.taken()], before


@pytest.mark.parametrize("lengths", [[1] * 3000, [600] * 50, [342] * 40, [1023, 1] * 20, [1024] * 3, [5000, 7], [513, 511, 1, 2, 3], [random.Random(8).randint(1, 3000) for _ in range(4000)]])
def test_every_token_once_and_no_padding(lengths):
    rows, before = placed(lengths)
    for i, n in enumerate(lengths):
        own = sorted((s, k) for d, _, s, k, _, _ in rows if d == i)
        assert [s for s, _ in own] == [sum(k for _, k in own[:m]) for m in range(len(own))] and sum(k for _, k in own) == n
    bins = defaultdict(list)
    for *_, k, at, offset in rows:
        bins[at].append((offset, k))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(k for _, k in own[:m]) for m in range(len(own))]
        total = sum(k for _, k in own)
        assert total <= 1024 and total & total - 1 == 0
    # Two pieces at most beside whole sequences, but for what the end of the rows leaves.
    pieces = Counter(d for d, _, _, k, _, _ in rows[:before] if k < 1024)
    assert max(pieces.values(), default=0) <= 2
    assert len(rows) - before <= 2 * 64 + 1024


def test_bins_hold_their_class_number_of_documents():
    rows, before = placed([random.Random(5).randint(1, 1023) for _ in range(5000)])
    by_bin = defaultdict(list)
    for _, n, start, k, at, offset in rows[:before]:
        by_bin[at].append((offset, k, start + k == n))
    full = [sorted(own) for own in by_bin.values() if sum(k for _, k, _ in own) == 1024]
    assert len(full) > 1000
    for own in full:
        kind = 1024 // own[0][1]
        assert all(1024 // k == kind and last for _, k, last in own[:kind])


def test_words_that_do_not_split_are_sent_alone(monkeypatch):
    coder = packing.tokenizer(P.path("byte_bpe_50k.json"))
    words = [" the", " Ġodd", " a", " café", " 123abc"]
    want = [np.frombuffer(x, "<u4").tolist() for x in coder.of_texts(words)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.of_words(words)] == want
    # A joined word with a space inside would give more runs than words.
    odd = [" two words", " one"]
    assert coder.of_words(odd) == coder.of_texts(odd)
