"""Search queries over whole documents, beside brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trustlake.functions import text
from trustlake.operators import search
from trustlake.plans.catalog import QUERIES

TEXTS = {0: "Casa blanca casa", 1: None, 2: "", 3: "fooBar 42, ab", 4: "订单 of 用户订单 a订b", 5: " ".join(f"w{i % 977}" for i in range(20_000)), 6: "hot " * 5000}


def cells(text: str) -> dict[int, float]:
    out: Counter = Counter()
    for chunk in re.split(r"[^一-鿿a-z0-9]+", text.lower()):
        if re.search("[一-鿿]", chunk):
            features = [*chunk, *(chunk[i : i + 2] for i in range(len(chunk) - 1))]
        else:
            features = [chunk, *(chunk[i : i + 3] for i in range(len(chunk) - 2))] if chunk else []
        for f in features:
            digest = hashlib.sha256(f.encode()).digest()
            out[int.from_bytes(digest[:4], signed=True) % 256] += -1 if digest[4] & 1 else 1
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {i: v / norm for i, v in out.items() if v}


def test_documents_are_embedded_whole(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got: dict[int, dict[int, float]] = {}
    for r in QUERIES["r5_hash_embed_documents"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, {})[r.i] = r.v
    want = {d: c for d, t in TEXTS.items() if (c := cells(t or ""))}
    assert got.keys() == want.keys()
    for d, c in want.items():
        assert got[d] == pytest.approx(c, abs=2e-6)


def test_hybrid_fuses_what_each_retriever_finds(spark):
    # Only words find "green ... apple" whole, only the glossary pear, only vectors the greenish apples.
    texts = {0: "green apple", 1: "a pear stood there", 2: "greenish apples", 3: "zzz qqq vvv"} | {i: f"filler{i} xyz{i}" for i in range(4, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(7, "green apple"), (8, "nowhere word")], "query_id long, text string")
    terms = spark.createDataFrame([("pear", ["apple", "fruit"]), ("green", ["x"])], "name string, synonyms array<string>")
    rows = search.hybrid(search.retriever_lists(queries, terms, docs)).collect()
    got = {r.doc_id: r for r in rows if r.query_id == 7}
    assert got[0].retrievers == ["lexical", "vector"] and got[0].rank == 1 and got[0].score == pytest.approx(round(2 / 61, 4))
    assert "glossary" in got[1].retrievers and "lexical" not in got[1].retrievers
    assert got[2].retrievers == ["vector"] and got[2].score == pytest.approx(round(1 / 62, 4))
    # A query without words in the documents has only the list of the vectors.
    assert {tuple(r.retrievers) for r in rows if r.query_id == 8} == {("vector",)}
    assert max(r.rank for r in rows) == 10


def test_places_in_one_list_add_up_and_ties_go_by_id(spark):
    lists = spark.createDataFrame([(1, "glossary", 5, 1), (1, "glossary", 5, 3), (1, "lexical", 6, 1), (1, "vector", 4, 1)], "query_id int, retriever string, doc_id int, rank int")
    got = [(r.doc_id, r.score) for r in search.hybrid(lists).orderBy("rank").collect()]
    assert got == [(5, round(1 / 61 + 1 / 63, 4)), (4, round(1 / 61, 4)), (6, round(1 / 61, 4))]


def test_newer_documents_come_first_among_equals(spark):
    docs = spark.createDataFrame([(1, "a b", "2024-01-01"), (2, "a b", "2024-03-01"), (3, "a b", None), (4, "a a b", "2020-01-01")], "doc_id int, text string, at string")
    queries = spark.createDataFrame([(1, "b a")], "query_id int, text string")
    assert [r.doc_id for r in search.search(queries, docs, recency_col="at").orderBy("rank").collect()] == [4, 2, 1, 3]


def test_vector_search_equals_brute_force(spark):
    rng = random.Random(4)
    rows = {i: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)] for i in range(300)} | {300: None, 301: [0.0] * 6, 302: [1.0], 303: []}
    vectors = spark.createDataFrame([(i, v) for i, v in rows.items()], "id long, vector array<double>").repartition(3)
    queries = {"a": rows[5], "b": [1.0], "c": [0.0] * 6, "d": None, "e": [-v for v in rows[7]]}
    asked = spark.createDataFrame(list(queries.items()), "query_id string, vector array<double>")

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or not any(x) or not any(y):
            return 0.0
        return round(sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 6)

    got = {}
    for r in search.vector_search(asked, vectors, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, pytest.approx(r.score, abs=2e-6)))
    for name, q in queries.items():
        want = sorted(((-cosine(q, v), i) for i, v in rows.items()))[:7]
        assert sorted(got[name], key=lambda x: x[0]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_texts_are_hashed_where_they_are_and_only_ids_travel(spark):
    words = "alpha beta gamma 数据表 beta x9 " * 40
    docs = spark.createDataFrame([(i % 60, f"{words}{i}") for i in range(70)], "doc_id long, text string")
    cells = {(r.doc_id, r.i): r.v for r in search.hash_cells(docs).collect()}
    want = {}
    for i in range(70):
        for chunk in re.findall("[a-z0-9数据表]+", f"{words}{i}"):
            for f in search.features(chunk):
                digest = hashlib.sha256(f.encode()).digest()
                at = i % 60, int.from_bytes(digest[:4], "big", signed=True) % search.DIMENSION
                want[at] = want.get(at, 0) + (-1 if digest[4] % 2 else 1)
    assert cells == want
    vectors = {r.doc_id: r.vector for r in search.hash_embed(docs).collect()}
    assert set(vectors) == set(range(60)) and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in vectors.values())
    # One exchange of rows, by the id: no row for each feature of a text is sent.
    plan = search.hash_embed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_documents_are_cut_once_for_words_and_glossary(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "red hen"), (4, " ")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "red fox")], "query_id long, text string")
    terms = spark.createDataFrame([("hen", ["fox"])], "name string, synonyms array<string>")
    lists = search.word_lists(queries, terms, docs)
    assert sorted(r[:] for r in lists.collect()) == [(7, "glossary", 3, 1), (7, "lexical", 1, 1)]


def test_terms_are_counted_text_by_text(spark):
    rows = [(n, "one two one") for n in range(100)] + [(n, None) for n in range(100, 103)] + [(n, "!") for n in range(103, 106)]
    made = search.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r[:] for r in made.collect()) == sorted((t, n, tf) for n in range(100) for t, tf in (("one", 2), ("two", 1)))
    # Nothing is dealt out, so no task holds more than a few texts' terms.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_rows_that_share_an_id_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(search, "_RUNS", 3)
    rows = [("a", "x y x z"), ("b", "x"), ("a", "y"), (None, "x"), (None, "x w"), ("c", None)]
    made = search.postings(spark.createDataFrame(rows, "doc_id string, text string"))
    assert set(made.collect()) == {("x", "a", 2), ("y", "a", 2), ("z", "a", 1), ("x", "b", 1), ("x", None, 2), ("w", None, 1)}


def test_words_are_split_at_all_letters_and_digits(spark):
    texts = {"fooBar1Baz": ["foo", "bar1", "baz"], "ABCd": ["abcd"], "aBC": ["a", "bc"], "\U0001d41aB \U0001d7cfA": ["\U0001d41a", "b", "\U0001d7cf", "a"], "\u00e9\u00c9": ["\u00e9", "\u00e9"], "": [], "a\U00010400": ["a", "\U00010428"]}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r[0]: r[1] for r in df.select("text", text.tokens(F.col("text"))).collect()}
    assert got == texts
    han = {"\u2e80\u2e81": ["\u2e80\u2e81"], "a\u3005b": ["\u3005"], "\U00020000\U00020001": ["\U00020000\U00020001"], "caf\u00e9": [], "\uff21": []}
    df = spark.createDataFrame([(t,) for t in han], "text string")
    assert {r[0]: r[1] for r in df.select("text", text.han_terms(F.col("text"))).collect()} == han
