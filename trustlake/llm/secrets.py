"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for patterned secrets (assignments, access keys, long hex strings) and for further high-entropy
tokens outside them. Every candidate's value is hashed, and over the whole corpus the distinct repositories and owners
of each hash are counted: values that many owners hold are copied examples, values of few owners look live. Patterned
spans are always reported; a high-entropy token is reported only if it looks live.

The counts are three aggregations in a row (value, owner and repository; value and owner; value), each partly done
before its shuffle, so that a value found everywhere is never gathered.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; repeated rows are rows of
their own and count as one repository; other columns are ignored; an empty table gives an empty result; spans that start
together are ordered by kind.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, materialize, texts

# The kinds in their order, and the patterns they stand for.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

MIN_ASSIGN = 8
#: A further token has this entropy (bits a character) at least, with digits and letters in it.
MIN_ENTROPY = 3.3
#: A value that this many owners hold is a copied example.
EXAMPLE_OWNERS = 4

CANDIDATE = "array<struct<kind:int,start:long,end:long,value_start:long,value_hash:binary>>"
_STRUCT = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_hash", pa.binary())]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of every candidate of a whole text, by start and kind; offsets are code points.

    A value ends where its span ends.
    """
    found = [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    found += [(k, m.start(), m.end(), m[0]) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    at = reach = 0
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start():
            continue
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= MIN_ENTROPY:
            found.append((3, m.start(), m.end(), value))
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan_rows(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """A written table of one row per input row: row, doc_id, owner, repo and the candidates."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch):
                found.append([{"kind": k, "start": s, "end": e, "value_start": e - len(v), "value_hash": hashlib.sha256(v.encode()).digest()[:16]} for k, s, e, v in scan(text)])
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("row", "doc_id", "owner", "repo")] + [pa.array(found, _STRUCT)], ["row", "doc_id", "owner", "repo", "candidates"])

    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text")
    )
    return materialize(in_small_batches(own).mapInArrow(run, f"row long, doc_id {kind}, owner string, repo string, candidates {CANDIDATE}"), "secret-scan")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, owners and repositories (distinct pairs of owner and repository) over the whole corpus."""
    by_repo = candidates.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def exploded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("candidates") > 0).select("row", "owner", "repo", F.explode("candidates").alias("c")).select("row", "owner", "repo", "c.*")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, corpus: DataFrame | None = None) -> DataFrame:
    """One row per input row: row, doc_id and secrets, an array of (start, kind, end, value_start, value_hash, owners, repositories, live).

    It holds every patterned span and the high-entropy tokens that look live, by start and kind. Owners and repositories
    are counted over ``docs`` and, where it is given, ``corpus``, a table with the same four columns from which ``docs``
    has been taken; a repository of both counts once.
    """
    rows = scan_rows(docs, id_col, text_col, owner_col, repo_col)
    each = exploded(rows)
    counted = each.select("value_hash", "owner", "repo")
    if corpus is not None:
        counted = counted.union(exploded(scan_rows(corpus, id_col, text_col, owner_col, repo_col)).select("value_hash", "owner", "repo"))
    judged = each.join(ownership(counted), "value_hash").withColumn("live", F.col("owners") < example_owners)
    kept = judged.filter((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "end", "value_start", "value_hash", "owners", "repositories", "live")
    by_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("secrets"))
    return rows.select("row", "doc_id").join(by_row, "row", "left").withColumn("secrets", F.coalesce("secrets", F.array().cast(by_row.schema["secrets"].dataType)))


def listed(spans: F.Column) -> F.Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[SECRET]", example_owners: int = EXAMPLE_OWNERS, corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with the value of every live-looking secret in ``text_col`` replaced by ``mark``; rows and other columns stay.

    Copied examples stay in the text. What is replaced is decided over the whole corpus first: the hashes of live
    values are joined to the texts that hold them, and those texts are cut at the spans. Where copies have been taken
    out of ``docs``, ``corpus`` is the table with them, so that widely copied examples still count as such.
    """

    def scanned(df: DataFrame) -> DataFrame:
        return df.select("__key", F.col(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repo_col).cast("string").alias("repo"))

    key = F.sha1(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.withColumn("__key", key)
    whole = None if corpus is None else scanned(corpus.withColumn("__key", F.lit("")))
    found = find_secrets(scanned(keyed), "__key", "text", "owner", "repo", example_owners, whole)
    live = found.select(F.col("doc_id").alias("__key"), F.filter("secrets", lambda s: s["live"]).alias("__live")).filter(F.size("__live") > 0)
    # Equal texts have equal spans and the same verdicts.
    live = live.groupBy("__key").agg(F.first("__live").alias("__live"))
    joined = keyed.join(live, "__key", "left")
    ends = F.array_sort(F.transform("__live", lambda s: F.struct(s["value_start"].alias("start"), s["end"].alias("end"))))
    merged = F.aggregate(
        ends,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(F.col(text_col), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return joined.withColumn(text_col, F.when(F.col("__live").isNull(), F.col(text_col)).otherwise(merged)).select(*docs.columns)
