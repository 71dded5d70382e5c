"""License scans beside an exact scan of all windows that is written here on its own."""

from __future__ import annotations

import os
import random
import re

import pytest

from trustlake.llm import licenses

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def filler(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


def expected(text, templates):
    """{name: (windows, first word, highest containment)} of windows that hold 80 % of a template's shingles."""
    out = {}
    words = re.findall(r"[^\W_]+", (text or "").lower())
    for name, body in templates.items():
        own = re.findall(r"[^\W_]+", body.lower())
        size = min(5, len(own))
        wanted = {" ".join(own[i : i + size]) for i in range(len(own) - size + 1)}
        half = 1
        while half < len(wanted):
            half *= 2
        every = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        blocks = [set(every[i : i + half]) for i in range(0, len(every), half)]
        pairs = [(0, blocks[0])] if len(blocks) == 1 else [(k * half, blocks[k] | blocks[k + 1]) for k in range(len(blocks) - 1)]
        hits = [(at, len(w & wanted) / len(wanted)) for at, w in pairs]
        hits = [h for h in hits if h[1] >= 0.8]
        if hits:
            out[name] = (len(hits), hits[0][0], max(s for _, s in hits))
    return out


def check(spark, texts, templates):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.find_licenses(docs, templates).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.windows, r.first_word, r.containment)
    assert got == {i: e for i, t in enumerate(texts) if (e := expected(t, templates))}
    return got


def test_texts_and_versions(spark):
    rnd = random.Random(7)
    texts = []
    for name, body in licenses.TEMPLATES.items():
        words = body.split()
        some = list(words)
        for i in rnd.sample(range(len(words)), len(words) // 40):
            some[i] = "changed"
        many = [w if rnd.random() < 0.7 else "changed" for w in words]
        texts += [f"{filler(rnd, rnd.randint(0, 90))} {t} {filler(rnd, rnd.randint(0, 90))}" for t in (body, " ".join(some).upper(), " ".join(many), " ".join(words[: len(words) // 2]))]
    texts += [None, "", "MIT", texts[3], texts[3], filler(rnd, 20_000) + licenses.TEXTS["mit-license"] + filler(rnd, 9000)]
    got = check(spark, texts, licenses.TEMPLATES)
    assert all(name in got[4 * i] for i, name in enumerate(licenses.TEMPLATES))
    assert "gpl-2.0-header" in got[4 * list(licenses.TEMPLATES).index("gpl-3.0-header")]


def test_long_licenses(spark, tmp_path):
    rnd = random.Random(8)
    first = filler(rnd, 5000).split()
    second = [w if rnd.random() > 0.02 else "new" for w in first]
    (tmp_path / "long-1").write_text(" ".join(first))
    (tmp_path / "long-2").write_text(" ".join(second))
    templates = licenses.templates_from(str(tmp_path)) | {"mit": licenses.NOTICES["mit"]}
    assert sorted(templates) == ["long-1", "long-2", "mit"]
    texts = [f"{filler(rnd, 3000)} {' '.join(first)} {filler(rnd, 12_000)} Released under the MIT License.", " ".join(second), " ".join(first[:3000]), " ".join(first[:2500]) + filler(rnd, 2500)]
    got = check(spark, texts, templates)
    assert set(got[0]) == {"long-1", "long-2", "mit"} and set(got[1]) == {"long-1", "long-2"} and 2 not in got and 3 not in got


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no license texts here")
def test_whole_texts_of_licenses(spark):
    folder = "/usr/share/common-licenses"
    templates = {n: t for n, t in licenses.templates_from(folder).items() if n in ("GPL-2", "GPL-3", "LGPL-2.1", "Apache-2.0")}
    got = check(spark, [filler(random.Random(1), 200) + " " + t for t in templates.values()], templates)
    assert [set(found) for found in got.values()] == [{n} for n in templates]


def test_bands_miss_at_most_one_in_a_million():
    for level in licenses.Scanner(licenses.TEMPLATES).levels:
        for _, own in level.templates:
            held = -(-len(own) * 4 // 5)
            assert (1 - held / (level.window + len(own) - held)) ** level.bands <= 1e-6 and len(own) <= level.stride
