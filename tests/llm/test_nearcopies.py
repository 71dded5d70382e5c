"""Near copies beside brute force over the shingle sets, and as the pipeline's stage."""

from __future__ import annotations

import random

import corpus_pipeline

from trustlake.llm import nearcopies, simhash

COLUMNS = "doc_id long, text string"


def corpus() -> list[tuple[int | None, str | None]]:
    """Prose of 300 words; near copies with one to seventeen words changed, in chains too; copies, short, empty and null texts."""
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for changed in (0, 0, 1, 2, 4, 6, 8, 10, 12, 14, 17):
            own = list(words)
            for place in rng.sample(range(300), changed):
                own[place] = f"x{rng.randrange(5000)}"
            rows.append((at, " ".join(own)))
            at += 1
            if changed == 10:
                words = own
    rows += [(at, ""), (at + 1, None), (at + 2, " \n"), (at + 3, "one two"), (at + 4, "One  TWO"), (at + 5, "one"), (None, "one"), (None, "one")]
    rng.shuffle(rows)
    return rows


def brute_force(rows: list[tuple]) -> dict[int, int]:
    rows = sorted(r for r in rows if r[0] is not None)
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b or a and b and len(a & b) >= 0.8 * (len(a) * len(b)) ** 0.5) and top(i) != top(j):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def test_groups_equal_brute_force_whole_and_in_slices(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    want = brute_force(rows)
    for slices in (1 << 19, 700):
        assert {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(docs, slice_shingles=slices).collect()} == want


def test_stage_drops_copies_of_a_similarity_of_0_8(spark):
    rows = corpus()
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    want = brute_force(rows)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert sum(r.doc_id is None for r in kept) == 2


def test_pivot_tables_propose_and_shingles_decide(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "candidates", lambda nodes: spark.createDataFrame([], "a long, b long"))
    rows = corpus()
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    want = brute_force(rows)
    assert all(want[a] == want[b] for a, b in got.items())
    assert len(set(got.values())) < len({simhash.fingerprint((t or "").encode(), 10**6) for i, t in rows if i is not None})


def test_empty_table(spark):
    assert nearcopies.keep_representatives(spark.createDataFrame([], COLUMNS)).count() == 0
