"""Repeated passages: each result beside a plain search of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from trustlake.llm import queries, substrings

SCHEMA = "doc_id long, text string"


def plain(rows, size):
    """(doc_id, n_words, n_removed, kept) of each row by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, size, **options):
    rows = substrings.remove_repeats(df, size=size, **options).collect()
    sha = lambda r: r.words_sha256 if not r.n_removed else hashlib.sha256(r.kept.encode()).hexdigest()
    return sorted(((r.doc_id, r.n_words, r.n_removed, sha(r)) for r in rows), key=repr)


def test_equal_windows_decide_equal_symbols():
    rng = random.Random(1)
    for size in (6, 12):
        for _ in range(100):
            docs = [b" ".join(rng.choice([b"a", b"b", b"c", b"d", b"e"][: rng.choice([1, 2, 5])]) for _ in range(rng.randint(size, 60))) for _ in range(4)]
            words = substrings.Words(docs)
            numbers = words.numbers()
            name, of, low, high = substrings.deciding(numbers, words.doc, size, 3, 3)
            starts, known = np.r_[0, np.cumsum(words.n)], {}
            for d in range(4):
                for s in range(starts[d], starts[d + 1] - size + 1):
                    inside = (of == d) & (low >= s) & (high <= s + size)
                    own = sorted(zip(name[inside].tolist(), (low[inside] - s).tolist(), (high[inside] - s).tolist()))
                    assert own
                    assert known.setdefault(tuple(numbers[s : s + size].tolist()), own) == own


@pytest.mark.parametrize("seed", range(3))
def test_like_a_plain_search(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 30))] for _ in range(4)] + [["x"] * 25, ["y", "z"] * 12]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 20))]
        rows.append((d, " ".join(words)))
    rows += [(60, rows[3][1]), (61, rows[3][1] + "\n"), (62, None), (63, ""), (64, "\t \n"), (None, rows[5][1]), (5, rows[5][1]), (7, rows[8][1]), (65, "é " * 30), (66, "é " * 40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (8, 12):
        assert found(df, size, grown=3, rounds=4) == plain(rows, size)


def test_long_texts_other_columns_and_no_rows(spark):
    rng = random.Random(5)
    long = [str(rng.randrange(50_000)) for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[1000:1060] + ["new"] + long[3000:3049])), (3, "w " * 20_000), (4, "w " * 60)]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n_words int, kept string")
    assert found(df, 50) == plain(rows, 50)
    assert found(df.limit(0), 50) == []


def test_query_over_a_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    own = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op11_recompression(spark, data).collect()), key=repr)
    assert own == plain(rows, 50)
    assert any(r[2] for r in own)
