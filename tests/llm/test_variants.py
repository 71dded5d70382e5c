"""Spelling variants: results beside plain counting and deletion lists."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustlake.llm import queries, variants

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows, min_length=7, min_count=2, times=10):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= min_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    lists = defaultdict(set)
    for w in n:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            lists[v].add(w)
    out = {}
    for w in n:
        met = {x for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for x in lists[v] if near(w, x)}
        best = min(((-n[x], x) for x in met), default=None)
        form = best[1] if best and -best[0] >= times * n[w] else None
        out[w] = (form, len(met))
    rows = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], n_near, n[form] if form else None))
    return sorted(rows, key=repr)


def found(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(60))
def test_accepted_pairs_are_the_near_ones(seed):
    rng = random.Random(seed)
    low = [rng.randint(1, 5) for _ in range(rng.randint(1, 5))]
    rows = [(g, t) for g, size in enumerate(low) for t in sorted({"".join(rng.choice("abc") for _ in range(rng.choice([size, size + 1]))) for _ in range(40)})]
    group, tails = np.array([g for g, _ in rows]), [t for _, t in rows]
    lengths = np.array([len(t) for t in tails])
    codes = np.zeros((len(tails), lengths.max()), np.uint16)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(tails).encode("utf-16-le"), np.uint16)
    acceptor = variants.Acceptor(codes, lengths, group)
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in acceptor.near(np.array(low))))}
    assert got == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if group[i] == group[j] and near(tails[i], tails[j]) and min(lengths[i], lengths[j]) == low[group[i]]}
    # Minimal: no two states accept the same words.
    languages = defaultdict(set)
    for node in range(len(acceptor.first)):
        i, d = acceptor.first[node], acceptor.depth[node]
        words = frozenset(t[d:] for g, t in rows if g == group[i] and len(t) >= d and t[:d] == tails[i][:d])
        languages[int(acceptor.state[node])].add(words)
    assert all(len(x) == 1 for x in languages.values())
    assert len({next(iter(x)) for x in languages.values()}) == len(languages)


def some_rows(seed, n=150):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé", k=rng.randint(6, 10))) for _ in range(40)] + ["thousand", "thousands", "Thousand"]
    word = lambda: (lambda w: w if rng.random() < 0.9 else w[: (i := rng.randrange(len(w)))] + rng.choice(["", "a", "zb"]) + w[i + 1 :])(stems[min(int(rng.expovariate(0.15)), len(stems) - 1)])
    rows = [(d, " ".join(word() for _ in range(rng.randint(0, 40)))) for d in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, rows[1][1]), (3, rows[3][1]), (n + 2, "x" * 3000 + " " + "x" * 3000 + "1" + "x" * 3001 + "-" + "x" * 3001), (n + 3, "÷×÷×÷×÷ " * 3), (n + 4, "follows " * 400 + "followt " * 30 + "followtx " * 2)]


@pytest.mark.parametrize("seed", range(2))
def test_like_deletion_lists(spark, seed):
    rows = some_rows(seed)
    df = spark.createDataFrame([(d, t, 7, "w") for d, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    expected = plain(rows)
    assert any(r[1] and r[2] != r[1] for r in expected)
    assert found(variants.group_variants(df)) == expected
    assert found(variants.group_variants(df, slice_words=8)) == expected
    assert found(variants.group_variants(df.limit(0))) == []


def test_few_groups_at_a_time(spark):
    vocabulary = variants.words(spark.createDataFrame(some_rows(5), "doc_id long, text string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(variants.near_words(vocabulary, chunk_codes=64)) == rows(variants.near_words(vocabulary))


def test_query_over_a_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    own = found(queries.op13_one_edit_composition(spark, data))
    assert own == plain(rows)
    assert any(r[1] for r in own)
