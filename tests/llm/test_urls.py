"""Words of URLs keep their own odds, and long tokens are segmented."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import cache

import pytest

from trustlake.llm import queries, urls


def test_scores_are_those_of_exact_counts(spark):
    # 70,000 words in clean URLs: more than 2^16, so hashed places would be shared.
    rows = [(f"s{i}", [f"w{i}", "en"], False, 1) for i in range(70_000)] + [(f"b{i}", [f"x{i}", "casino", "en"], True, 2) for i in range(300)] + [("none", [], False, 3)]
    df = spark.createDataFrame(rows, "shape string, words array<string>, bad boolean, n long")
    got = {r.shape: r.score for r in urls.scores(df.union(spark.createDataFrame([("new", ["unseen", "en"], False, 1)], df.schema)), df).collect()}
    rows.append(("new", ["en"], False, 0))
    counts, docs = {True: Counter(), False: Counter()}, Counter()
    for _, words, bad, n in rows:
        docs[bad] += n
        for w in words:
            counts[bad][w] += n
    v = len(counts[True].keys() | counts[False].keys())
    share = {b: {w: (counts[b][w] + urls.SMOOTHING) / (sum(counts[b].values()) + urls.SMOOTHING * v) for w in counts[True].keys() | counts[False].keys()} for b in (True, False)}
    odds = {w: math.log(share[True][w] / share[False][w]) for w in share[True]}
    assert got == pytest.approx({s: math.log(docs[True] / docs[False]) + sum(odds[w] for w in words) for s, words, _, _ in rows})


def test_long_tokens_are_segmented(spark):
    words = ["quiet", "garden", "plants"] * 6 + ["casino"] + ["quiet", "garden"] * 8
    text = " ".join(["quiet garden plants"] * 300)
    rows = [(0, "http://k.net/" + "".join(words), text + " casino")] + [(i, f"http://quietgarden{i}.org/plants", text) for i in range(1, 9)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].words == ["k", "net", *words]
    assert got[1].verdict == "allow"


def test_words_longer_than_twenty_letters_stay_whole(spark):
    long = "donaudampfschifffahrtskapitaen"
    rows = [(i, f"http://{long}quiet{i}.net/", f"quiet {long} net " * 20) for i in range(4)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.words[:2] == [long, "quiet"] for r in got)


def test_verdicts_are_not_the_list_of_terms(spark):
    """Rules and pages say what is bad; hosts never hold a term, and a clean page may."""
    rows = [(i, f"http://luckywin{i}.net/en/{i}", "lucky win now, casino bonus") for i in range(60)]
    rows += [(100 + i, f"http://quietgarden{i}.org/en/{i}", "lucky quiet garden win plants") for i in range(300)]
    rows += [(500 + i, f"http://cheapwatch{i}.com/de/{i}", "cheap watch") for i in range(40)]
    rows += [(900, "http://quietgarden7.net/en/1", "quiet garden"), (902, "http://luckywin777.net/x", ""), (903, "http://cheapwatch.net/en/3", ""), (904, "http://www.casino.net/", "casino casino")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert all(got[i].verdict == "block" and not set(got[i].words) & set(urls.SEEDS) for i in range(60))
    assert got[902].verdict == "block" and got[900].verdict == "allow" and got[903].verdict == "block"
    assert all(got[100 + i].verdict == "allow" for i in range(300))
    held = urls.held_out(pages).first()
    assert held.caught + held.missed > 5 and held.missed == 0 and held.false_alarms == 0 and held.left_alone > 40
    # A term in the page's own host is no evidence from its text, and stands for itself only by the prior.
    assert got[904].verdict == "block"


def plain_judge(rows, rules, seeds):
    """(page_id, rule, verdict, score) of each page, by plain loops over whole counts."""
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), path

    def fits(host, path):
        own = [(len(h + p), v == "block", h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(own)[2:] if own else None

    def shape(host, path):
        return re.sub("[^a-z#]+", " ", re.sub("[0-9]+", " # ", f"{host}/{path}".lower())).strip().split(" ")

    counts, examples = Counter({w: urls.SEED_COUNT for w in seeds}), []
    for _, url, html in rows:
        host, path = parts(url)
        words = re.findall("[a-z]+", urls._TAGS.sub(" ", html or "").lower())
        counts.update(words)
        rule = fits(host, path)
        bad = rule[2] == "block" if rule else any(t in seeds and t not in host for t in words)
        if (bad or rule) and zlib.crc32(host.encode()) % urls.HELD:
            examples.append((tuple(shape(host[: len(host) - len(rule[0])], path[len(rule[1]) :]) if rule else shape(host, path)), bad, 1))
    total = sum(counts.values())
    split = cache(lambda t: urls.viterbi(t, counts, total) if len(t) > urls.WHOLE and t.isalpha() else [t])
    own = lambda tokens: [w for t in tokens for w in split(t) if w]
    seen, docs = {True: Counter({w: urls.SEED_EXAMPLES for w in seeds}), False: Counter()}, Counter()
    for tokens, bad, n in examples:
        docs[bad] += n
        for w in own(tokens):
            seen[bad][w] += n
    known = seen[True].keys() | seen[False].keys()
    share = lambda bad, w: (seen[bad][w] + urls.SMOOTHING) / (sum(seen[bad].values()) + urls.SMOOTHING * len(known))
    out = []
    for i, url, _ in rows:
        host, path = parts(url)
        rule = fits(host, path)
        score = math.log(docs[True] / docs[False]) + sum(math.log(share(True, w) / share(False, w)) for w in own(shape(host, path)) if w in known) if len(docs) > 1 else -1.0
        out.append((i, host, path, "".join(rule[:2]) if rule else None, rule[2] if rule else "block" if score > 0 else "allow", round(score, 6)))
    return sorted(out, key=repr)


def test_query_beside_plain_loops(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6)) for r in queries.op3_url_words(spark, data).collect()), key=repr)
    assert got == plain_judge(rows, urls.RULES, urls.SEEDS)


def test_odd_pages(spark):
    rows = [(None, "http://a.net/x", "casino"), (None, None, None), (1, "", ""), (1, "nothing", "poker"), (2, "http://B.example.org/es/9?q#f", "<p>" * 300_000), (3, "http://q.org/a", "w " * 400_000), (3, "http://q.org/a", "w"), (4, "http://" + "z" * 90 + ".net/", "z" * 90)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, host string")
    got = urls.judge(pages)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6)) for r in got.collect()), key=repr) == plain_judge(rows, urls.RULES, urls.SEEDS)
    assert got.filter("page_id = 4").first().words == ["z" * 90, "net"]
    assert urls.judge(pages.limit(0)).collect() == []


def test_tags_without_an_end_take_linear_time():
    import time

    began = time.time()
    assert urls._TAGS.sub(" ", "a <script>" + "<script x" * 200_000) == "a  " and urls._TAGS.sub(" ", "b " + "<" * 500_000) == "b  "
    assert urls._TAGS.sub(" ", "<style>x</style>y<b>z</b><p") == " y z  "
    assert time.time() - began < 5
