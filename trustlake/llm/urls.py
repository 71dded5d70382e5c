"""URL filter: rules first, then words segmented out of hosts and paths, scored by multinomial naive Bayes.

1. Labels. A page that a block rule fits is a bad example, one that an allow rule fits a good one; of the other pages those
   whose visible text holds a seed term are bad, and the rest is not learned from. An example keeps only the part of its
   URL that the rule has not read, and terms that stand in the page's own host do not count in its text; so the label is
   never read off the words that are learned. Each seed term has ``SEED_EXAMPLES`` occurrences in bad examples beside its
   own, a prior that examples outweigh.
2. One pass over all pages counts the words of their visible text, which make a unigram model (plus the seed terms), and
   the examples by shape: URLs are reduced to shapes (their tokens in order, numbers as one mark). Hosts whose hash falls
   into one of ``HELD`` parts are held out: ``held_out`` counts how the scores fit their labels.
3. Each distinct token of letters in hosts and paths is split by Viterbi into the most probable words. Only counts of
   words that are parts of a token are joined to it, so no vocabulary is gathered anywhere.
4. Each word has its own exact counts in bad and good examples, which are joined to the words of the shapes; only the at
   most 1000 words that make up a thousandth of all are sent to every task. Words of no example count nothing.
5. The longest rule that fits decides; of other URLs those are blocked whose log-odds of being bad are above zero.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and no words; null html is empty; a
tag, script or style without an end reaches to the page's end; a run of over ``LONGEST_WORD`` letters is no word; tokens
of up to 3 characters stay whole; of rules of equal length that fit, a block comes first; a null id is learned from and judged;
repeated rows and equal ids are rows of their own; other columns are ignored; without examples of both kinds all that no
rule decides are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, materialize, texts

# The rules (verdict, host, path prefix) and the seed terms of bad URLs.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SEEDS = ["adult", "ads", "bet", "bets", "bingo", "casino", "escort", "gambling", "jackpot", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx"]

#: Occurrences that a seed term has beside its own in the word counts, and in bad examples.
SEED_COUNT = 1000
SEED_EXAMPLES = 1
LONGEST_WORD = 40
#: Parts of a token are listed by pieces of this length, which overlap by a word less a letter.
PIECE = 100
#: A word with this share of all is joined by broadcast.
HOT = 0.001
SMOOTHING = 0.1
#: Tokens up to this length are words already.
WHOLE = 3
NUMBER = "#"
FLUSH = 200_000
#: One in so many hosts is held out.
HELD = 5

# What has no end is taken to the end of the page, so no place is looked at twice.
_TAGS = re.compile(r"<(?:script|style)\b.*?(?:</(?:script|style)>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
_WORDS = re.compile(r"[a-z]+")


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(
        F.col(id_col).alias("page_id"),
        lower(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_of(rules: list[tuple[str, str, str]]) -> F.Column:
    """The longest fitting rule as a struct (rule, verdict, host_size, path_size), null where none fits. ``rules`` is a short driver-side list."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(len(host + path)).alias("n"), F.lit(verdict == "block").alias("b"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(len(host)).alias("host_size"), F.lit(len(path)).alias("path_size")),
        )
        for verdict, host, path in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def counted(pages: DataFrame, seeds: list[str] = SEEDS) -> DataFrame:
    """A written table of rows (kind, key, n) over all pages (host, rule, shape, html).

    Kind ``word`` counts the words of visible texts, and the seed terms; ``good``, ``bad``, ``held_good`` and
    ``held_bad`` count examples by the shape of their URL.
    """
    terms = frozenset(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        shaped: Counter = Counter()

        def made() -> pa.RecordBatch:
            keys = [*counts, *(k for _, k in shaped)]
            kinds = ["word"] * len(counts) + [kind for kind, _ in shaped]
            batch = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array([*counts.values(), *shaped.values()], pa.int64())], ["kind", "key", "n"])
            counts.clear()
            shaped.clear()
            return batch

        for batch in batches:
            for text, *own in zip(texts(batch, "html"), *(column(batch, c).to_pylist() for c in ("host", "verdict", "shape", "held"))):
                host, verdict, shape_, held = own
                words = _WORDS.findall(_TAGS.sub(" ", text).lower())
                counts.update(words)
                bad = verdict == "block" or verdict is None and any(t not in host for t in terms.intersection(words))
                if bad or verdict:
                    shaped["held_" * held + ("bad" if bad else "good"), shape_] += 1
                if len(counts) + len(shaped) > FLUSH:
                    yield made()
        yield made()

    held = F.crc32(F.col("host").cast("binary")) % HELD == 0
    # What a rule has read of an example's URL is left out.
    rest = lambda c, at, n: F.when(F.col("r").isNull(), F.col(c)).otherwise(F.substr(F.col(c), at, n))
    host = rest("host", F.lit(1), F.length("host") - F.col("r.host_size"))
    path = rest("path", F.col("r.path_size") + 1, F.length("path"))
    each = pages.select("host", F.col("r.verdict").alias("verdict"), shape(host, path).alias("shape"), held.alias("held"), "html")
    each = each.transform(in_small_batches).mapInArrow(run, "kind string, key string, n long")
    prior = pages.sparkSession.createDataFrame([("word", w, SEED_COUNT) for w in seeds], "kind string, key string, n long")
    return materialize(each.union(prior).groupBy("kind", "key").agg(F.sum("n").alias("n")), "page-counts")


def viterbi(token: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a token; an unknown word of n letters has the probability 1 / (total * 10^n)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(token[start:end])
            p = math.log(n / total) if n else -math.log(total) - (end - start) * math.log(10)
            options.append((best[start][0] + p, -start))
        if end == len(token) > LONGEST_WORD and counts.get(token):
            options.append((math.log(counts[token] / total), 0))
        score, start = max(options)
        best.append((score, -start))
    out, end = [], len(token)
    while end:
        out.append(token[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segmented(tokens: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Rows (token, words) of distinct tokens of letters."""
    step = PIECE - LONGEST_WORD + 1
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("token") - LONGEST_WORD + 1), F.lit(step))
    pieces = tokens.filter(F.length("token") > WHOLE).select("token", F.explode(F.transform(at, lambda i: F.substring(F.col("token"), i, F.lit(PIECE)))).alias("piece"))
    length = F.length("piece")
    starts = F.sequence(F.lit(1), length)
    subs = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), length - i + 1)), lambda n: F.substring(F.col("piece"), i, n)))))
    parts = pieces.select("piece").distinct().select("piece", F.explode(subs).alias("word"))
    found = parts.join(counts, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    whole = F.struct(F.col("word"), "n")
    long = tokens.filter(F.length("token") > LONGEST_WORD).join(counts.filter(F.length("word") > LONGEST_WORD), F.col("token") == F.col("word")).select("token", F.array(whole).alias("known"))
    known = pieces.join(found, "piece").select("token", "known").unionByName(long).groupBy("token").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    whole = tokens.join(known, "token", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens_, known_ = column(batch, "token").to_pylist(), column(batch, "known").to_pylist()
            out = [viterbi(t, {x["word"]: x["n"] for x in k or ()}, total) if WHOLE < len(t) else [t] for t, k in zip(tokens_, known_)]
            yield pa.RecordBatch.from_arrays([column(batch, "token"), pa.array(out, pa.list_(pa.string()))], ["token", "words"])

    return in_small_batches(whole).mapInArrow(run, "token string, words array<string>")


def shape(host: F.Column, path: F.Column) -> F.Column:
    """The tokens of a URL in order, joined by spaces; digits become one mark."""
    text = F.lower(F.concat_ws("/", host, path))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[0-9]+", f" {NUMBER} "), f"[^a-z{NUMBER}]+", " "))


def scores(listed: DataFrame, examples: DataFrame, seeds: list[str] = ()) -> DataFrame:
    """Rows (shape, score) of distinct shapes with their words: the log-odds of a bad URL, prior and exact odds of each word, smoothed by SMOOTHING.

    ``examples`` has rows (words, bad, n). Words that no example has count nothing.
    """
    docs = {r["bad"]: r["n"] for r in examples.groupBy("bad").agg(F.sum("n").alias("n")).collect()}
    if len(docs) < 2:
        return listed.select("shape", F.lit(-1.0).alias("score"))
    of = lambda bad: F.sum(F.when(F.col("bad") == F.lit(bad), F.col("n")).otherwise(0))
    seen = examples.select("bad", "n", F.explode("words").alias("word"))
    seen = seen.unionByName(listed.sparkSession.createDataFrame([(True, SEED_EXAMPLES, w) for w in seeds], "bad boolean, n long, word string"))
    words = materialize(seen.groupBy("word").agg(of(True).alias("b"), of(False).alias("g")), "word-odds")
    all_ = words.agg(F.sum("b").alias("b"), F.sum("g").alias("g"), F.count("*").alias("v")).first()
    share = lambda c: (F.col(c) + SMOOTHING) / F.lit((all_[c] or 0) + SMOOTHING * all_["v"])
    odds = words.select("word", F.log(share("b") / share("g")).alias("odds"))
    pairs = materialize(listed.select("shape", F.explode("words").alias("word")), "shape-words")
    often = pairs.groupBy("word").agg(F.count("*").alias("m")).filter(F.col("m") >= F.lit(HOT * pairs.count()))
    # At most 1 / HOT words are sent; no other word has so large a share of the rows.
    often = F.broadcast(materialize(often.select("word"), "hot-words"))
    hot = F.broadcast(odds.join(often, "word", "left_semi"))
    rest = pairs.join(often, "word", "left_anti").join(odds, "word")
    summed = pairs.join(hot, "word").unionByName(rest).groupBy("shape").agg(F.sum("odds").alias("odds"))
    return listed.select("shape").join(summed, "shape", "left").select("shape", (F.lit(math.log(docs[True] / docs[False])) + F.coalesce("odds", F.lit(0.0))).alias("score"))


def scored_shapes(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Written rows (shape, words, n, score) of all pages and examples, n being the pages, and (shape, good, bad, held_good, held_bad), the examples of each shape."""
    own = parsed(pages.select(F.col(html_col).cast("string").alias("__html"), F.col(url_col).cast("string").alias("__url")), "__html", "__url").withColumnRenamed("page_id", "html").withColumn("r", rule_of(rules))
    counts = counted(own, seeds)
    words = counts.filter("kind = 'word'").select(F.col("key").alias("word"), "n")
    total = words.agg(F.sum("n")).first()[0]
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    examples = counts.filter("kind != 'word'").groupBy(F.col("key").alias("shape")).agg(*map(of, ("good", "bad", "held_good", "held_bad")))
    sizes = own.groupBy(shape(F.col("host"), F.col("path")).alias("shape")).agg(F.count("*").alias("n"))
    shapes = materialize(sizes.join(examples, "shape", "full").fillna(0), "shapes")
    split = shapes.select("shape", F.posexplode(F.split("shape", " ")).alias("at", "token"))
    tokens = split.filter(F.col("token").rlike("^[a-z]+$")).select("token").distinct()
    found = materialize(segmented(tokens, words, total), "tokens")
    joined = split.join(found, "token", "left").select("shape", "at", F.coalesce("words", F.array("token")).alias("words"))
    listed = joined.groupBy("shape").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    listed = materialize(listed.withColumn("words", F.filter("words", lambda w: w != "")).join(shapes, "shape"), "url-words")
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("bad"), F.col("bad").alias("n")), F.struct(F.lit(False).alias("bad"), F.col("good").alias("n"))))
    learned = listed.select("words", kinds.alias("e")).select("words", "e.bad", "e.n").filter("n > 0")
    scored = listed.select("shape", "words", "n").join(scores(listed.select("shape", "words"), learned, seeds), "shape")
    return scored, listed.drop("words", "n")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log-odds of a bad URL) and words."""
    scored, _ = scored_shapes(pages, rules, seeds, url_col, html_col)
    scored = materialize(scored.filter("n > 0"), "url-scores")
    most = scored.agg(F.sum("n")).first()[0] or 0
    urls = parsed(pages, id_col, url_col).withColumn("shape", shape(F.col("host"), F.col("path")))
    # At most 1 / HOT shapes are sent; no other shape has so large a share of the pages.
    often = F.col("n") >= F.lit(HOT * most)
    hot, rest = F.broadcast(scored.filter(often).drop("n")), scored.filter(~often).drop("n")
    urls = urls.join(hot, "shape").unionByName(urls.join(hot.select("shape"), "shape", "left_anti").join(rest, "shape"))
    rule = rule_of(rules)
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return urls.select("page_id", "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], own).alias("verdict"), "score", "words")


def held_out(pages: DataFrame, **options) -> DataFrame:
    """One row over the examples of hosts that were not learned from: caught, missed, false_alarms, left_alone, all by the score alone."""
    scored, examples = scored_shapes(pages, **options)
    each = examples.join(scored.select("shape", (F.col("score") > 0).alias("blocked")), "shape")
    of = lambda blocked, kind, name: F.coalesce(F.sum(F.when(F.col("blocked") == blocked, F.col(kind))), F.lit(0)).alias(name)
    return each.agg(of(True, "held_bad", "caught"), of(False, "held_bad", "missed"), of(True, "held_good", "false_alarms"), of(False, "held_good", "left_alone"))
