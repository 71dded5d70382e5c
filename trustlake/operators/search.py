"""Catalog search: documents, postings, lexical, hybrid and vector retrieval."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustlake.functions import text
from trustlake.functions.storage import written

RRF = 60
DIMENSION = 256
#: Queries of a block that is sent to all tasks; more queries make more blocks.
BLOCK_QUERIES = 10_000
#: Rows and queries that a task scores together.
_ROWS, _QUERIES = 4096, 256
#: Buckets of terms in a written index, and files of a bucket.
BUCKETS, FILES = 256, 4


def terms_of(c: Column) -> Column:
    """All terms of a text, repeats included."""
    return F.concat(text.tokens(c), text.han_terms(c))


def has_term(c: Column) -> Column:
    """Whether ``terms_of`` finds anything: a look at the first letter, digit or Han character."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}\p{IsHan}]"), F.lit(False))


#: Words or runs of texts that a task counts together.
_RUNS = 1 << 18


def _texts(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[pa.RecordBatch]:
    """Batches in parts of 500 texts or _RUNS entries of their lists at most, but for one text that has more."""
    for batch in batches:
        first, held = 0, 0
        for i, n in enumerate(batch.column(lists).value_lengths().to_pylist()):
            held += n
            if held >= _RUNS or i - first >= 500:
                yield batch.slice(first, i + 1 - first)
                first, held = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (term, doc_id, tf) of each row of a table, counted where its text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches, "terms"):
            lists = part.column("terms")
            distinct = lists.flatten().dictionary_encode()
            if len(distinct):
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                pairs, n = np.unique(rows * len(distinct.dictionary) + distinct.indices.to_numpy(), return_counts=True)
                rows, terms = np.divmod(pairs, len(distinct.dictionary))
                yield pa.RecordBatch.from_arrays([distinct.dictionary.take(pa.array(terms)), part.column("doc_id").take(pa.array(rows)), pa.array(n)], ["term", "doc_id", "tf"])

    own = docs.select(F.col(id_col).alias("doc_id"), terms_of(F.col(text_col)).alias("terms"))
    return own.mapInArrow(run, f"term string, doc_id {own.schema['doc_id'].dataType.simpleString()}, tf long")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (term, doc_id, tf).

    Terms are counted text by text, so nothing is held or dealt out for that; only those of rows that share an id are
    added up.
    """
    shared = docs.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    if shared.isEmpty():
        return _counted(docs, id_col, text_col)
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    both = _counted(docs.join(shared, same, "left_semi"), id_col, text_col).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    return _counted(docs.join(shared, same, "left_anti"), id_col, text_col).unionByName(both)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write a search index: postings and document frequencies by bucket of terms, and the number of documents with a term.

    Postings lie in folders by bucket, sorted by term, so that a search reads the buckets and row groups of its terms.
    """
    posting = postings(docs, id_col, text_col).withColumn("bucket", bucket_of(F.col("term")))
    file = F.pmod(F.xxhash64("doc_id"), F.lit(FILES))
    posting.repartition("bucket", file).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    docs.agg(F.count_if(has_term(F.col(text_col))).alias("n")).write.mode("overwrite").parquet(f"{path}/documents")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over a written index: only the buckets that hold a query's term are read."""
    terms = query_terms(queries)
    # At most BUCKETS numbers.
    wanted = [r[0] for r in terms.select(bucket_of(F.col("term")).alias("b")).distinct().collect()]
    mine = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("bucket").isin(wanted)).join(terms.select("term").distinct(), "term", "left_semi")
    return rank_hits(terms, mine("postings").select("term", "doc_id", "tf"), mine("terms").select("term", "df"), spark.read.parquet(f"{path}/documents"), k)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))


def rank_hits(terms: DataFrame, posting: DataFrame, df: DataFrame, total: DataFrame, k: int, recency: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, doc_id, score, rank) of documents that hold all terms of a query, from postings of these terms, frequencies and a count."""
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    weight = F.col("tf") * F.log(1 + F.col("n") / F.col("df"))
    # The count is one row.
    hits = posting.join(terms, "term").join(df, "term").crossJoin(F.broadcast(total))
    found = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("met"), F.round(F.sum(weight), 6).alias("score"))
    full = found.join(wanted, "query_id").filter("met = wanted")
    newest = []
    if recency is not None:
        full, newest = full.join(recency.select("doc_id", "updated_at"), "doc_id", "left"), [F.desc_nulls_last("updated_at")]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *newest, "doc_id")
    return full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


# The types of entities that are found by search.
INDEXED_TYPES = ["Platform", "Container", "Dataset", "Column", "Pipeline", "Dashboard", "GlossaryTerm", "DataContract", "QualityRule"]
_ASPECTS = ["name", "path", "description", "tags", "synonyms", "owners", "classification"]


def build_search_docs(entity: DataFrame, aspects: DataFrame) -> DataFrame:
    """One document for each live entity of a type in INDEXED_TYPES, its aspects pivoted.

    Rows (urn, entity_type, display_name, platform, container, description, tags, owners, classification, text). Synonyms are
    found by the text but are no tags. ``entity``: urn, entity_type, lifecycle; ``aspects``: urn, field, value, seq, where
    tags and owners are lists by commas.
    """
    wide = aspects.groupBy("urn").agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f) for f in _ASPECTS])
    live = entity.filter((F.col("lifecycle") == "ACTIVE") & F.col("entity_type").isin(INDEXED_TYPES)).select("urn", "entity_type")
    own = live.join(wide, "urn", "left")
    parts = F.split(F.element_at(F.split("urn", ":"), -1), r"\.")
    deep = F.size(parts) > 2
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.element_at(parts, -1))
    words = text.search_text(*[F.col(c) for c in ["name", "urn", "path", "description", "tags", "synonyms"]])
    return own.select(
        "urn", "entity_type", name.alias("display_name"), F.when(deep, parts[1]).alias("platform"), F.when(deep, F.array_join(F.slice(parts, 2, F.size(parts) - 2), ".")).alias("container"),
        "description", listed(F.col("tags")).alias("tags"), listed(F.col("owners")).alias("owners"), "classification", words.alias("text"),
    )


def search_doc_changes(entity: DataFrame, aspects: DataFrame) -> DataFrame:
    """``build_search_docs`` with ``deleted`` false, and the URNs of entities that are gone with ``deleted`` true, as the index by segments takes them (R1, ST1)."""
    docs = build_search_docs(entity, aspects).withColumn("deleted", F.lit(False))
    gone = entity.filter((F.col("lifecycle") != "ACTIVE") & F.col("entity_type").isin(INDEXED_TYPES)).select("urn", "entity_type", F.lit(True).alias("deleted"))
    return docs.unionByName(gone, allowMissingColumns=True)


def search(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", recency_col: str | None = None) -> DataFrame:
    """Documents that hold all terms of a query, by the sum of tf * idf, then the newest, then id: rows (query_id, doc_id, score, rank) (R2).

    ``queries``: query_id, text. No index is needed: texts are cut in one scan, and only occurrences of the queries'
    terms leave it, into a written table.
    """
    terms = query_terms(queries)
    own = docs.select(F.col(id_col).alias("doc_id"), F.explode(terms_of(F.col(text_col))).alias("term"))
    each = own.join(terms.select("term").distinct(), "term", "left_semi")
    posting = written(each.groupBy("term", "doc_id").agg(F.count("*").alias("tf")), "hits")
    df = posting.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count_if(has_term(F.col(text_col))).alias("n"))
    recency = None if recency_col is None else docs.select(F.col(id_col).alias("doc_id"), F.col(recency_col).alias("updated_at"))
    return rank_hits(terms, posting, df, total, k, recency)


def expand_queries(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Queries for the glossary terms whose name or synonym is a token of a query (R4): rows (query_id, text).

    ``terms``: name, synonyms array<string>.
    """
    own = queries.select("query_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    keys = terms.select(F.col("name").alias("text"), F.explode(F.concat(F.array("name"), "synonyms")).alias("token")).withColumn("token", F.lower("token"))
    return own.join(keys, "token").filter("text != token").select("query_id", "text").distinct()


def glossary_lists(queries: DataFrame, terms: DataFrame, docs: DataFrame, k: int = 20, hits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What a glossary adds: rows (query_id, doc_id, rank), one list for each query.

    Each word of a query (of two letters or more) is searched in the terms' names and synonyms; the names of the best
    ``hits`` terms that are not the word itself are searched in the documents. The lists of the terms follow each other in
    the order of the words and of their hits. ``terms``: name, synonyms array<string>.
    """
    return word_lists(queries, terms, docs, k, hits, id_col, text_col).filter("retriever = 'glossary'").drop("retriever")


def word_lists(queries: DataFrame, terms: DataFrame, docs: DataFrame, k: int = 20, hits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lists of ``search`` and of ``glossary_lists`` by one scan of the documents: rows (query_id, retriever, doc_id, rank)."""
    words = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("place", "word")).filter(F.length("word") >= 2)
    asked = words.select(F.struct("query_id", "place", "word").alias("query_id"), F.col("word").alias("text"))
    named = terms.select("name", F.concat_ws(" ", F.array("name"), "synonyms").alias("text"))
    met = search(asked, named, hits, "name").filter(F.lower("doc_id") != F.lower("query_id.word"))
    key = lambda query, place, hit: F.struct(query.alias("query_id"), place.cast("int").alias("place"), hit.cast("int").alias("hit")).alias("query_id")
    expanded = met.select(key(F.col("query_id.query_id"), F.col("query_id.place"), F.col("rank")), F.col("doc_id").alias("text"))
    # A query's own text has no place.
    own = queries.select(key(F.col("query_id"), F.lit(-1), F.lit(0)), "text")
    found = search(own.unionByName(expanded), docs, k, id_col, text_col)
    each = found.select("query_id.query_id", "query_id.place", "query_id.hit", F.col("rank").alias("own"), "doc_id")
    lexical = each.filter("place < 0").select("query_id", F.lit("lexical").alias("retriever"), "doc_id", F.col("own").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("place", "hit", "own")
    glossary = each.filter("place >= 0").select("query_id", F.lit("glossary").alias("retriever"), "doc_id", F.row_number().over(order).alias("rank"))
    return lexical.unionByName(glossary)


def hybrid(lists: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, retriever, doc_id, rank); each place of a document in a list counts."""
    # Rounded to far more places than a sum's order can touch.
    total = F.round(F.sum(1 / (RRF + F.col("rank"))), 12)
    fused = lists.groupBy("query_id", "doc_id").agg(total.alias("total"), F.sort_array(F.collect_set("retriever")).alias("retrievers"))
    order = Window.partitionBy("query_id").orderBy(F.desc("total"), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", F.round("total", 4).alias("score"), "retrievers", "rank")


def chunks(c: Column) -> Column:
    """The runs of letters a-z, digits and Han characters of a text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{IsHan}a-z0-9]+"), lambda x: x != "")


def features(chunk: str) -> list[str]:
    """What is hashed of a run: it and its three-letter parts, or, if it has Han characters, these and their pairs."""
    if chunk.isascii():
        return [chunk, *(chunk[i : i + 3] for i in range(len(chunk) - 2))]
    return [*chunk, *(chunk[i : i + 2] for i in range(len(chunk) - 1))]


#: Runs and features whose places a task remembers before it starts anew.
_REMEMBERED = 1 << 18


def text_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """Rows (doc_id, sums, touched): sums of signed features by place, and whether any feature falls there; texts without a feature have none.

    A feature's place is the first four bytes of its SHA-256, as a signed number, modulo the dimension; it is taken away
    where the fifth byte is odd. Texts are summed where they are; only rows that share an id are added up afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[int, int]] = {}
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def place(f: str) -> tuple[int, int]:
            if f not in places:
                if len(places) >= _REMEMBERED:
                    places.clear()
                digest = hashlib.sha256(f.encode()).digest()
                places[f] = int.from_bytes(digest[:4], "big", signed=True) % dimension, 1 - 2 * (digest[4] % 2)
            return places[f]

        def of_run(chunk: str) -> tuple[np.ndarray, np.ndarray]:
            if chunk not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                found = np.array([place(f) for f in features(chunk)], np.int64)
                known[chunk] = found[:, 0], found[:, 1]
            return known[chunk]

        def summed(part: pa.RecordBatch) -> pa.RecordBatch:
            lists = part.column("chunks")
            distinct = lists.flatten().dictionary_encode()
            each = [of_run(x) for x in distinct.dictionary.to_pylist()]
            sums, touched = np.zeros(part.num_rows * dimension), np.zeros(part.num_rows * dimension)
            if each:
                # A run that a text repeats is one entry with its count.
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                pairs, n = np.unique(rows * len(each) + distinct.indices.to_numpy(), return_counts=True)
                rows, runs = pairs // len(each), pairs % len(each)
                sizes = np.array([len(x[0]) for x in each])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                places_of, signs_of = (np.concatenate([x[i] for x in each]) for i in (0, 1))
                own = sizes[runs]
                at = np.repeat(starts[runs] - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())
                cells = np.repeat(rows * dimension, own) + places_of[at]
                sums = np.bincount(cells, np.repeat(n, own) * signs_of[at], part.num_rows * dimension)
                touched = np.bincount(cells, minlength=part.num_rows * dimension)
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dimension)
            out = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (sums.astype(np.int64), touched > 0)]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *out], ["doc_id", "sums", "touched"])

        for part in _texts(batches, "chunks"):
            yield summed(part)

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), chunks(F.col(text_col)).alias("chunks")).filter(F.size("chunks") > 0)
    parts = own.mapInArrow(run, f"doc_id {kind}, sums array<long>, touched array<boolean>")
    both = parts.groupBy("doc_id").agg(F.collect_list("sums").alias("s"), F.collect_list("touched").alias("t"))
    added = lambda c, plus: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda x, y: F.zip_with(x, y, plus)))
    return both.select("doc_id", added(F.col("s"), lambda x, y: x + y).alias("sums"), added(F.col("t"), lambda x, y: x | y).alias("touched"))


def hash_cells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """Rows (doc_id, i, v): the sums of signed features by place, before they are made of length one."""
    sums = text_sums(docs, id_col, text_col, dimension)
    return sums.select("doc_id", F.posexplode(F.arrays_zip("sums", "touched")).alias("i", "x")).filter("x.touched").select("doc_id", "i", F.col("x.sums").cast("double").alias("v"))


def hash_embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """Unit vectors by signed feature hashing: rows (doc_id, vector); texts without a feature have none."""
    sums = text_sums(docs, id_col, text_col, dimension).select("doc_id", "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = unit_rows(batch.column("sums"), dimension).ravel()
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimension)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "vector"])

    return sums.mapInArrow(run, f"doc_id {sums.schema['doc_id'].dataType.simpleString()}, vector array<double>")


def retriever_lists(
    queries: DataFrame, terms: DataFrame, docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", embed: Callable[[DataFrame, str, str], DataFrame] | None = hash_embed
) -> DataFrame:
    """The k best documents of each query by words, by the glossary terms it leads to, and by vectors: rows (query_id, retriever, doc_id, rank).

    ``queries``: query_id, text; ``terms``: name, synonyms; ``docs``: already filtered by what may be seen. ``embed`` gives
    (doc_id, vector) of a table, by its id and its text; without it there are no lists by vectors.
    """
    lists = word_lists(queries, terms, docs, k, 5, id_col, text_col)
    if embed is None:
        return lists
    asked = embed(queries, "query_id", "text").withColumnRenamed("doc_id", "query_id")
    near = vector_search(asked, embed(docs, id_col, text_col).withColumnRenamed("doc_id", "id"), k).withColumnRenamed("id", "doc_id")
    return lists.unionByName(near.select("query_id", F.lit("vector").alias("retriever"), "doc_id", "rank"))


def hybrid_search(queries: DataFrame, terms: DataFrame, docs: DataFrame, k: int = 10, embed: Callable[[DataFrame, str, str], DataFrame] | None = hash_embed, **columns: str) -> DataFrame:
    """``hybrid`` over ``retriever_lists``, with ``unavailable``: the retrievers that could not be asked. Nothing takes their place."""
    lists = retriever_lists(queries, terms, docs, max(k, 20), embed=embed, **columns)
    missing = F.array() if embed is not None else F.array(F.lit("vector"))
    return hybrid(lists, k).withColumn("unavailable", missing.cast("array<string>"))


MODEL = ["urn", "provider", "dimension"]


def changed_docs(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents whose content hash has no vector of the model yet (R6): ``docs`` with urn and doc_hash, and provider and dimension if ``vectors`` has them."""
    return docs.join(vectors.select(*[c for c in (*MODEL, "doc_hash") if c in docs.columns]), [c for c in (*MODEL, "doc_hash") if c in docs.columns], "left_anti")


def embedding_report(docs: DataFrame, vectors: DataFrame, provider: str, dimension: int) -> DataFrame:
    """One row on a model's vectors: scanned, embedded (to do now), skipped_unchanged, stale_other_model (documents whose vector is another model's), orphaned (vectors without a document)."""
    own = vectors.select("urn", F.col("doc_hash").alias("known"), ((F.col("provider") == provider) & (F.col("dimension") == dimension)).alias("mine"))
    both = docs.select("urn", "doc_hash").join(own, "urn", "full")
    there = F.col("doc_hash").isNotNull()
    same = there & F.coalesce(F.col("mine") & (F.col("known") == F.col("doc_hash")), F.lit(False))
    return both.agg(
        F.count_if(there).alias("scanned"), F.count_if(there & ~same).alias("embedded"), F.count_if(same).alias("skipped_unchanged"),
        F.count_if(there & F.coalesce(~F.col("mine"), F.lit(False))).alias("stale_other_model"), F.count_if(~there).alias("orphaned"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for other lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def unit_rows(vectors: pa.Array, length: int) -> np.ndarray:
    """Vectors as rows of length one; null, of another length or zero: zeros, whose cosine is 0."""
    out = np.zeros((len(vectors), length))
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False).to_numpy(zero_copy_only=False))
    if len(fits) and length:
        out[fits] = pc.fill_null(pc.cast(vectors.take(pa.array(fits)).flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, length)
    norm = np.sqrt((out * out).sum(1))
    good = norm > 0
    out[~good] = 0
    out[good] /= norm[good, None]
    return out


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest vectors by cosine of each stated query, then id: rows (query_id, id, score, rank).

    ``queries``: query_id, vector; ``vectors``: id, vector, already filtered by what may be seen. All vectors are scored:
    they stay where they are and the stated queries come to them, in blocks of BLOCK_QUERIES. A batch of rows sends on the
    k best for each query, and a task the k best of its batches.
    """
    spark = vectors.sparkSession
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    own = queries.select("query_id", "vector").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = spark.createDataFrame([], schema)
    for b in range(blocks):
        # About BLOCK_QUERIES rows.
        block = own.filter(F.col("block") == b).select("query_id", "vector").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, wanted = block["query_id"].combine_chunks(), block["vector"].combine_chunks()
        lengths = pc.list_value_length(wanted)
        groups = []
        for n in pc.unique(pc.fill_null(lengths, 0)).to_pylist():
            at = pc.indices_nonzero(pc.equal(pc.fill_null(lengths, 0), n))
            groups.append((ids.take(at), unit_rows(wanted.take(at), n)))
        shared = spark.sparkContext.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    part = whole.slice(at, _ROWS)
                    # Places are in the order of ids, which settles ties.
                    part = part.take(pc.sort_indices(part.column("id")))
                    for names, q in shared.value:
                        rows = unit_rows(part.column("vector"), q.shape[1])
                        for first in range(0, len(q), _QUERIES):
                            scores = np.round(q[first : first + _QUERIES] @ rows.T, 6) + 0.0
                            if scores.shape[1] > k:
                                least = np.partition(scores, -k, axis=1)[:, -k, None]
                                i, j = np.nonzero(scores >= least)
                            else:
                                i, j = (x.ravel() for x in np.indices(scores.shape))
                            order = np.lexsort((j, -scores[i, j], i))
                            i, j = i[order], j[order]
                            starts = np.searchsorted(i, i, "left")
                            few = np.arange(len(i)) - starts < k
                            i, j = i[few], j[few]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(i + first)), part.column("id").take(pa.array(j)), pa.array(scores[i, j])], ["query_id", "id", "score"])

        parts = parts.unionByName(vectors.select("id", "vector").mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def suggest(docs: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    """The k shortest names that hold the first word of a prefix."""
    word = prefix.strip().split(" ")[0]
    return docs.filter(F.contains(F.lower("name"), F.lit(word.lower()))).select("name").distinct().orderBy(F.length("name"), "name").limit(k)


def facets(df: DataFrame, *names: str) -> DataFrame:
    """Counts by each of the columns under one filter, in one pass."""
    sets = [[F.col(n)] for n in names]
    counted = df.groupingSets(sets, *names).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(names)) - 1
    facet = F.coalesce(*[F.when(F.col("g") == (full ^ (1 << (len(names) - 1 - i))), n) for i, n in enumerate(names)])
    return counted.select(facet.alias("facet"), F.coalesce(*names).alias("value"), "n")


def resolve_tables(raw: DataFrame, entity: DataFrame) -> DataFrame:
    """Names to URNs: a URN as it is, else the only asset whose path ends in the name's parts, else the only one with that display name.

    Nothing is guessed: no or several hits give null. ``raw``: name. ``entity``: urn, display_name. Paths are exploded
    into their suffixes, so that the match is an equi join at a dot.
    """
    names = raw.select("name").distinct()
    parts = F.split(F.split_part("urn", F.lit(":"), F.lit(4)), r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    one = lambda df, key: df.groupBy(key).agg(F.min("urn").alias("urn"), F.count_distinct("urn").alias("n")).filter("n = 1").select(F.col(key).alias("name"), "urn")
    by_path = one(entity.select("urn", F.explode(suffixes).alias("key")), "key").withColumnRenamed("urn", "path_urn")
    by_name = one(entity.select("urn", F.col("display_name").alias("key")), "key").withColumnRenamed("urn", "name_urn")
    known = entity.select(F.col("urn").alias("name"), F.col("urn").alias("same_urn")).distinct()
    # Sizes are estimated by the columns that are read, paths are longer than these; so no side is sent to all tasks by an estimate.
    out = reduce(lambda df, side: df.join(side.hint("merge"), "name", "left"), (known, by_path, by_name), names)
    return out.select("name", F.coalesce("same_urn", "path_urn", "name_urn").alias("urn"))


def suggest_fixes(entity: DataFrame, aspects: DataFrame, columns: DataFrame, edge: DataFrame) -> DataFrame:
    """Three detectors (N1): no owner though two or more read it, a schema without a description, a sensitive column without a level.

    ``aspects``: urn, aspect_type. ``columns``: urn, column_name, classification.
    """
    has = lambda kind: aspects.filter(F.col("aspect_type") == kind).select("urn").distinct()
    readers = edge.filter("state = 'ACTIVE'").groupBy(F.col("from_urn").alias("urn")).agg(F.count("*").alias("n")).filter("n >= 2")
    row = lambda df, kind, confidence: df.select("urn", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    a = entity.join(has("ownership"), "urn", "left_anti").join(readers, "urn", "left_semi")
    b = entity.join(has("schema"), "urn", "left_semi").join(has("description"), "urn", "left_anti")
    c = columns.filter(text.is_sensitive_name(F.col("column_name")) & F.col("classification").isNull()).select("urn").distinct()
    return row(a, "missing_owner", 0.75).unionByName(row(b, "missing_description", 0.6)).unionByName(row(c, "ungraded_column", 0.7))


def dedup_suggestions(new: DataFrame, existing: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Suggestions without a pending one and without a verdict in the last days."""
    keys = ["urn", "kind"]
    recent = F.col("decided_at").cast("timestamp") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    held = existing.filter((F.col("status") == "PENDING") | F.coalesce(recent, F.lit(False))).select(*keys)
    return new.join(held, keys, "left_anti")


def inbox(suggestions: DataFrame, least: float = 0.5, limit: int = 100) -> DataFrame:
    """Pending suggestions of a confidence, the most confident and newest first."""
    return suggestions.filter((F.col("status") == "PENDING") & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), F.desc("created_at"), "urn").limit(limit)


def accepted_writes(suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What accepted suggestions write, as AI_GENERATED aspect writes for the merge by source; and verdicts that are refused.

    ``suggestions``: suggestion_id, urn, aspect_type, field, value, status, reason, decided_at (which orders the writes).
    A rejection without a reason is refused.
    """
    accepted = suggestions.filter("status = 'ACCEPTED'")
    writes = accepted.select(F.unix_micros(F.col("decided_at").cast("timestamp")).alias("seq"), F.col("suggestion_id").cast("double").alias("tie"), "urn", "aspect_type", "field", "value", F.lit("AI_GENERATED").alias("source"))
    refused = suggestions.filter((F.col("status") == "REJECTED") & (F.coalesce(F.trim("reason"), F.lit("")) == "")).select("suggestion_id", F.lit("a rejection needs a reason").alias("problem"))
    return writes, refused


def acceptance_rate(suggestions: DataFrame) -> DataFrame:
    """Per kind: reviewed ones and the share accepted, null when none was reviewed."""
    reviewed = F.count_if(F.col("status").isin("ACCEPTED", "REJECTED"))
    return suggestions.groupBy("kind").agg(reviewed.alias("reviewed"), F.when(reviewed > 0, F.round(F.count_if(F.col("status") == "ACCEPTED") / reviewed, 4)).alias("rate"))
