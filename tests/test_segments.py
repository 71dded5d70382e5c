"""Words of Han text by maximum match from both ends."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from trustlake.functions import text


def plain(run, words):
    def match(run, words):
        out, i = [], 0
        while i < len(run):
            n = next((n for n in range(min(8, len(run) - i), 1, -1) if run[i : i + n] in words), 1)
            out.append(run[i : i + n])
            i += n
        return out

    forward = match(run, words)
    backward = [t[::-1] for t in match(run[::-1], {w[::-1] for w in words})][::-1]
    score = lambda t: len(t) + 2 * sum(len(x) == 1 for x in t)
    return forward if score(forward) <= score(backward) else backward


def test_domain_phrases(spark):
    df = spark.createDataFrame([("客户订单明细",), ("客户订单",), ("单明",), ("户",), ("ods_客户x订单明",), ("",), (None,)], "t string")
    got = {r.t: (r.s, r.i) for r in df.select("t", text.segments(F.col("t")).alias("s"), text.han_index_terms(F.col("t")).alias("i")).collect()}
    assert got["客户订单明细"] == (["客户", "订单", "明细"], ["客户", "订单", "明细", "户订", "单明"])
    assert got["客户订单"][0] == ["客户", "订单"]
    assert got["单明"][1] == ["单明"] and got["户"][1] == ["户"]
    assert got["ods_客户x订单明"][1] == ["客户", "订单", "单明"]
    assert got[""] == ([], [])
    assert len(text.LEXICON) == 169 and len(set(text.LEXICON)) > 100


def test_like_plain_matching(spark):
    rng = random.Random(2)
    words = ["研究", "研究生", "生命", "科学", "命科"] + ["".join(rng.choices("甲乙丙丁", k=rng.randint(2, 8))) for _ in range(60)]
    runs = ["研究生命科学"] + ["".join(rng.choices("甲乙丙丁研究生命", k=rng.randint(1, 30))) for _ in range(300)]
    got = [r.s for r in spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r string").orderBy("i").select(text.segments(F.col("r"), words).alias("s")).collect()]
    assert got == [plain(r, set(words)) for r in runs]
    assert got[0] == ["研究", "生命", "科学"]
    one = spark.range(1).select(text.segments(F.lit("甲乙"), []).alias("s")).first().s
    assert one == ["甲", "乙"]
