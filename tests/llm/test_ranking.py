"""Ranked search: results beside a plain scoring of all documents, and beside SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import connect, rows_of, rows_of_sql
from trustlake.llm import queries, ranking

LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    tokens = [(d, Counter(cut(t))) for d, t in docs]
    tokens = [(d, c, sum(c.values())) for d, c in tokens if c]
    n_docs, total = len(tokens), sum(n for *_, n in tokens)
    df = Counter(t for _, c, _ in tokens for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(cut(t))
    out = []
    for i, own in of.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for d, c, n in tokens:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    own = ranking.rank(df, spark.createDataFrame(items, "item_id long, text string"), k, **options)
    return sorted((tuple(r) for r in own.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_like_a_plain_scoring(spark, seed):
    rng = random.Random(seed)
    words = ["the", "The", "é", "École", "x1", "7"] + [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(d, text(rng.randint(1, 60))) for d in range(300)]
    docs += [(400 + d, docs[d % 7][1]) for d in range(60)] + [(900, None), (901, ""), (902, "--- \x00\n"), (None, docs[0][1]), (3, docs[9][1]), (903, text(20_000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(6)] + [(10, " ".join(words)), (11, None), (12, "unknown"), (0, "w70 w71"), (None, "w5"), (13, "W1")]
    expected = plain(docs, items, 5)
    assert found(spark, docs, items, 5, block_docs=40) == expected
    assert found(spark, docs, items, 5, block_items=2, block_terms=20) == expected


def test_many_terms_make_wide_masks():
    rng = np.random.default_rng(0)
    present = rng.random((300, 150)) < 0.1
    doc, term = np.nonzero(present)
    block = ranking.Block(np.arange(300), np.searchsorted(doc, np.arange(301)), term, rng.integers(1, 9, len(term)))
    bits, place = block.masks(np.arange(len(block.present)))
    assert (bits[place] == present[:, block.present]).all()
    assert len(np.unique(bits, axis=0)) == len(bits)


def test_no_rows(spark):
    assert found(spark, [], [(1, "a")], 5) == []
    assert found(spark, [(1, "a")], [], 5) == []
    assert found(spark, [(1, "a"), (2, "b")], [(1, "a b")], 1) == plain([(1, "a"), (2, "b")], [(1, "a b")], 1)


def test_beside_sql(spark, data):
    own = rows_of(queries.op12_presence_masks(spark, data))
    assert own == rows_of_sql(connect(data), queries.ORACLES["op12_presence_masks"])
    assert own[1]
