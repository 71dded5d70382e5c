"""Search, vectors, resolution and suggestions over driver tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from trustlake.functions import text, urn
from trustlake.functions.storage import new_path
from trustlake.operators import search
from trustlake.operators.policy import visible
from trustlake.plans.fixtures import load, with_views
from trustlake.plans.registry import query

_TOKENS = r"list_filter(string_split(lower(trim(regexp_replace(regexp_replace({0}, '(\p{{Ll}}|\p{{N}})(\p{{Lu}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), ' '), lambda t: t <> '')"
_POST = f"tok AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2)"


@query(f"WITH {_POST} SELECT * FROM post")
def r1_postings(spark, sf_dir):
    return search.postings(load(spark, sf_dir, "documents"))


def _queries(spark, sf_dir):
    words = F.split("text", " ")
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 2), " ").alias("text"))


_LEXICAL = f"""{_POST}, qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format("array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')")}) AS term FROM benchmark), wa AS (SELECT query_id, count(*) AS wanted FROM qt GROUP BY 1),
hi AS (SELECT * FROM post JOIN qt USING (term)), dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM hi GROUP BY 1), fo AS (SELECT query_id, doc_id, count(*) AS met, round(sum(tf * ln(1 + (SELECT count(DISTINCT doc_id) FROM post) / df)), 6) AS score FROM hi JOIN dfs USING (term) GROUP BY 1, 2),
lex AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fo JOIN wa USING (query_id) WHERE met = wanted)"""


@query(f"WITH {_LEXICAL} SELECT * FROM lex WHERE rank <= 10")
def r2_search(spark, sf_dir):
    return search.search(_queries(spark, sf_dir), load(spark, sf_dir, "documents"))


@query(f"WITH {_LEXICAL} SELECT * FROM lex WHERE rank <= 10")
def r2_search_index(spark, sf_dir):
    path = new_path(spark, "index")
    search.write_index(load(spark, sf_dir, "documents"), path)
    return search.search_index(spark, path, _queries(spark, sf_dir))


_GLOSSARY = "SELECT 'term' || CAST(item_id % 7 AS STRING) AS name, lower(split_part(text, ' ', 1)) AS synonym FROM benchmark"


@query(f"WITH g AS ({_GLOSSARY}), t AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark), k AS (SELECT name, name AS token FROM g UNION SELECT name, synonym FROM g) SELECT DISTINCT query_id, name AS text FROM t JOIN k USING (token) WHERE name <> token")
def r4_expand_queries(spark, sf_dir):
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    terms = spark.sql(_GLOSSARY).groupBy("name").agg(F.collect_set("synonym").alias("synonyms"))
    return search.expand_queries(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), terms)


#: The first word of an item leads to its third.
_LEADS = "SELECT DISTINCT lower(split_part(text, ' ', 3)) AS name, lower(split_part(text, ' ', 1)) AS synonym FROM benchmark"


def _cells(table: str, key: str, words: str = "text") -> str:
    """SQL for the sums of signed features by place."""
    return rf"""(WITH w AS (SELECT {key} AS doc_id, list_filter(string_split_regex(lower(coalesce({words}, '')), '[^\p{{Han}}a-z0-9]+'), lambda x: x <> '') AS ws FROM {table}),
f AS (SELECT doc_id, unnest(list_concat(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{Han}}')), flatten(list_transform(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{{Han}}')), lambda x: list_transform(generate_series(1, length(x) - 2), lambda i: substr(x, i, 3)))),
flatten(list_transform(list_filter(ws, lambda x: regexp_matches(x, '\p{{Han}}')), lambda x: list_concat(list_transform(generate_series(1, length(x)), lambda i: substr(x, i, 1)), list_transform(generate_series(1, length(x) - 1), lambda i: substr(x, i, 2))))))) AS f FROM w),
n AS (SELECT doc_id, f, count(*) AS n, sha256(f) AS h FROM f GROUP BY 1, 2) SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS i, CAST(sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN -n ELSE n END) AS DOUBLE) AS v FROM n GROUP BY 1, 2)"""


def _embed_sql(table: str, key: str) -> str:
    return f"WITH s AS {_cells(table, key)}, z AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1) SELECT doc_id, i, round(v / norm, 6) AS v FROM s JOIN z USING (doc_id) WHERE v <> 0"


def _listed(vectors):
    return vectors.select("doc_id", F.posexplode("vector").alias("i", "v")).filter("v != 0").select("doc_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(_embed_sql("benchmark", "item_id"))
def r5_hash_embed(spark, sf_dir):
    return _listed(search.hash_embed(load(spark, sf_dir, "benchmark"), "item_id"))


@query(_embed_sql("documents", "doc_id"))
def r5_hash_embed_documents(spark, sf_dir):
    return _listed(search.hash_embed(load(spark, sf_dir, "documents")))


_FIRST_TWO = "array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')"
#: Three lists of 20 and their fusion. Glossary: words of two letters or more, terms that hold them, documents that hold the term's name.
_FUSED = rf"""{_POST}, ndoc AS (SELECT count(DISTINCT doc_id) AS n FROM post), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), qs AS (SELECT item_id AS query_id, {_FIRST_TWO} AS text FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('text')}) AS term FROM qs), wa AS (SELECT query_id, count(*) AS wanted FROM qt GROUP BY 1),
fo AS (SELECT query_id, doc_id, count(*) AS met, round(sum(tf * ln(1 + n / df)), 6) AS score FROM post JOIN qt USING (term) JOIN dfs USING (term), ndoc GROUP BY 1, 2),
lex AS (SELECT query_id, 'lexical' AS retriever, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fo JOIN wa USING (query_id) WHERE met = wanted QUALIFY rank <= 20),
gl AS ({_LEADS}), gt AS (SELECT name, name || ' ' || string_agg(synonym, ' ') AS text FROM gl GROUP BY 1), gp AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest({_TOKENS.format('text')}) AS term FROM gt) GROUP BY 1, 2), gn AS (SELECT count(DISTINCT name) AS n FROM gp), gd AS (SELECT term, count(*) AS df FROM gp GROUP BY 1),
wd AS (SELECT query_id, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) AS place, unnest(string_split_regex(trim(text), '\s+')) AS word FROM qs), wt AS (SELECT DISTINCT query_id, place, word, unnest({_TOKENS.format('word')}) AS term FROM wd WHERE length(word) >= 2), ww AS (SELECT query_id, place, count(*) AS wanted FROM wt GROUP BY 1, 2),
gf AS (SELECT query_id, place, word, name, count(*) AS met, round(sum(tf * ln(1 + n / df)), 6) AS score FROM gp JOIN wt USING (term) JOIN gd USING (term), gn GROUP BY 1, 2, 3, 4),
gh AS (SELECT query_id, place, word, name, row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, name) AS hit FROM gf JOIN ww USING (query_id, place) WHERE met = wanted QUALIFY hit <= 5),
et AS (SELECT DISTINCT query_id, place, hit, unnest({_TOKENS.format('name')}) AS term FROM gh WHERE lower(name) <> lower(word)), ew AS (SELECT query_id, place, hit, count(*) AS wanted FROM et GROUP BY 1, 2, 3),
ef AS (SELECT query_id, place, hit, doc_id, count(*) AS met, round(sum(tf * ln(1 + n / df)), 6) AS score FROM post JOIN et USING (term) JOIN dfs USING (term), ndoc GROUP BY 1, 2, 3, 4),
er AS (SELECT query_id, place, hit, doc_id, row_number() OVER (PARTITION BY query_id, place, hit ORDER BY score DESC, doc_id) AS own FROM ef JOIN ew USING (query_id, place, hit) WHERE met = wanted QUALIFY own <= 20),
glo AS (SELECT query_id, 'glossary' AS retriever, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, hit, own) AS rank FROM er),
dc AS {_cells('documents', 'doc_id')}, dz AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM dc GROUP BY 1), qc AS {_cells('qs', 'query_id')}, qz AS (SELECT doc_id AS query_id, sqrt(sum(v * v)) AS qnorm FROM qc GROUP BY 1),
dot AS (SELECT qc.doc_id AS query_id, dc.doc_id, sum(qc.v * dc.v) AS d FROM qc JOIN dc ON dc.i = qc.i GROUP BY 1, 2), co AS (SELECT query_id, dz.doc_id, CASE WHEN qnorm > 0 AND norm > 0 THEN round(coalesce(d, 0) / (qnorm * norm), 6) ELSE 0 END AS score FROM qz CROSS JOIN dz LEFT JOIN dot USING (query_id, doc_id)),
vec AS (SELECT query_id, 'vector' AS retriever, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM co QUALIFY rank <= 20),
fu AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 12) AS total, list_sort(list(DISTINCT retriever)) AS retrievers FROM (FROM lex UNION ALL FROM glo UNION ALL FROM vec) GROUP BY 1, 2)
SELECT query_id, doc_id, round(total, 4) AS score, retrievers, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS INTEGER) AS rank FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) <= 10"""


#: The same without the lists by vectors.
_FUSED_WORDS = _FUSED.replace(" UNION ALL FROM vec", "").replace("AS score, retrievers, CAST", "AS score, retrievers, ['vector'] AS unavailable, CAST")


@query(f"WITH {_FUSED}")
def r3_hybrid(spark, sf_dir):
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    terms = spark.sql(_LEADS).groupBy("name").agg(F.collect_set("synonym").alias("synonyms"))
    return search.hybrid(search.retriever_lists(_queries(spark, sf_dir), terms, load(spark, sf_dir, "documents")))


#: The fusion over documents that a reader may see.
@query(f"WITH {_FUSED}".replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 5 <> 4)"))
def r3_hybrid_retrievers(spark, sf_dir):
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    terms = spark.sql(_LEADS).groupBy("name").agg(F.collect_set("synonym").alias("synonyms"))
    return search.hybrid(search.retriever_lists(_queries(spark, sf_dir), terms, visible(load(spark, sf_dir, "search_doc"), ["READER"])))


@query(f"WITH {_FUSED_WORDS}")
def r3_hybrid_without_vectors(spark, sf_dir):
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    terms = spark.sql(_LEADS).groupBy("name").agg(F.collect_set("synonym").alias("synonyms"))
    return search.hybrid_search(_queries(spark, sf_dir), terms, load(spark, sf_dir, "documents"), embed=None)


@query("SELECT doc_id, sha256(text) AS doc_hash FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def r6_changed_docs(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("urn"), F.sha2("text", 256).alias("doc_hash"))
    vectors = docs.filter("urn % 3 = 0").withColumn("doc_hash", F.when(F.col("urn") % 2 == 0, F.lit("old")).otherwise(F.col("doc_hash")))
    return search.changed_docs(docs, vectors).select(F.col("urn").alias("doc_id"), "doc_hash")


@query("""
WITH d AS (SELECT doc_id AS urn, sha256(text) AS h FROM documents), v AS (SELECT urn, CASE WHEN urn % 6 = 0 THEN 'old' ELSE h END AS known, urn % 4 <> 0 AS mine FROM d WHERE urn % 3 = 0 UNION ALL SELECT urn + 100000000, h, true FROM d WHERE urn % 50 = 0)
SELECT count(h) AS scanned, count(h) - count(h) FILTER (mine AND known = h) AS embedded, count(h) FILTER (mine AND known = h) AS skipped_unchanged, count(h) FILTER (NOT mine) AS stale_other_model, count(*) FILTER (h IS NULL) AS orphaned FROM d FULL JOIN v USING (urn)""")
def r6_embedding_report(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("urn"), F.sha2("text", 256).alias("doc_hash"))
    model = F.when(F.col("urn") % 4 != 0, "hash").otherwise("other")
    kept = docs.filter("urn % 3 = 0").select("urn", F.when(F.col("urn") % 6 == 0, F.lit("old")).otherwise(F.col("doc_hash")).alias("doc_hash"), model.alias("provider"), F.lit(256).alias("dimension"))
    lost = docs.filter("urn % 50 = 0").select(F.col("urn") + 100000000, "doc_hash", F.lit("hash"), F.lit(256))
    return search.embedding_report(docs, kept.union(lost), "hash", 256)


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(
    f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT.format('q.embedding', 'v.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('v.embedding', 'v.embedding')})), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5"
)
def r7_vector_search(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.vector_search(vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), vectors, 5)


@query(
    f"WITH v AS (SELECT * FROM embeddings WHERE label % 5 <> 4 AND label % 2 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT.format('q.embedding', 'v.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('v.embedding', 'v.embedding')})), 6) AS score FROM embeddings q JOIN v ON q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5"
)
def r7_visible_vectors(spark, sf_dir):
    """Vectors of one kind of entity at levels that a reader may see, before any is scored."""
    level = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("L1", "L2", "L3", "L4"))), F.col("label") % 5 + 1)
    own = load(spark, sf_dir, "embeddings").withColumns({"classification": level, "entity_type": F.when(F.col("label") % 2 == 0, "Dataset").otherwise("Dashboard")})
    seen = visible(own.filter("entity_type = 'Dataset'"), ["READER"]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.vector_search(own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), seen, 5)


@query("SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY length(p_name), p_name LIMIT 5")
def r8_suggest(spark, sf_dir):
    return search.suggest(load(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "ring x")


@query(with_views("v AS (SELECT * FROM asset WHERE coalesce(classification, 'L2') IN ('L1', 'L2', 'L3')) SELECT 'entity_type' AS facet, entity_type AS value, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'platform', platform, count(*) FROM v GROUP BY 2", "asset"))
def a13_facets(spark, sf_dir):
    return search.facets(visible(load(spark, sf_dir, "asset"), ["READER"]), "entity_type", "platform")


#: Every document's text is cut, and joined words and identifiers of parts beside it.
_NAMED = "SELECT doc_id AS id, text AS name FROM documents UNION ALL SELECT -p_partkey, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '' ELSE '.x' END) || 'Key' || p_size || 'Id' FROM part"


@query(f"WITH i AS ({_NAMED}) SELECT id, {_TOKENS.format('name')} AS tokens FROM i")
def x1_tokens(spark, sf_dir):
    for t in ("documents", "part"):
        load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(_NAMED).select("id", text.tokens(F.col("name")).alias("tokens"))


#: Names of customers in Han script, made from their keys: runs of one to five characters.
_SIGNS = "客户订单明用细表数据"
_HAN = f"SELECT c_custkey AS id, substr('{_SIGNS}', CAST(c_custkey % 9 + 1 AS INT), CAST(c_custkey % 5 + 1 AS INT)) || CASE c_custkey % 3 WHEN 0 THEN 'ab，' WHEN 1 THEN ' ' ELSE '' END || substr('{_SIGNS}', CAST(c_nationkey % 8 + 1 AS INT), CAST(c_nationkey % 3 AS INT)) AS name FROM customer"


@query(rf"""
WITH c AS ({_HAN}), r AS (SELECT id, name, regexp_extract_all(name, '\p{{Han}}+') AS runs FROM c),
g AS (SELECT id, name, list_concat(flatten(list_transform(runs, lambda x: list_transform(generate_series(1, length(x) - 1), lambda i: substr(x, i, 2)))), list_filter(runs, lambda x: length(x) = 1)) AS terms FROM r)
SELECT id, name, list_sort(list_distinct(terms)) AS terms, list_filter(['客户', '用细', '订单'], lambda w: contains(name, w)) AS words FROM g""")
def x2_han_terms(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    df = spark.sql(_HAN)
    lexicon = spark.createDataFrame([("订单",), ("客户",), ("用细",)], "word string")
    # The lexicon is three rows.
    hits = df.select("id", F.explode(text.han_candidates(F.col("name"))).alias("word")).join(F.broadcast(lexicon), "word").groupBy("id").agg(F.sort_array(F.collect_set("word")).alias("words"))
    return df.join(hits, "id", "left").select("id", "name", F.sort_array(text.han_terms(F.col("name"))).alias("terms"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


# Words that overlap, so that the two directions differ.
_WORDS = [*text.LEXICON, "户订", "单明用", "细表数"]
_ALTERNATIVES = "|".join(sorted({w for w in _WORDS}, key=lambda w: (-len(w), w)))
_REVERSED = "|".join(sorted({w[::-1] for w in _WORDS}, key=lambda w: (-len(w), w)))


@query(rf"""
WITH c AS ({_HAN}), r AS (SELECT id, unnest(regexp_extract_all(name, '\p{{Han}}+')) AS run FROM c),
m AS (SELECT id, run, regexp_extract_all(run, '{_ALTERNATIVES}|.') AS f, list_reverse(list_transform(regexp_extract_all(reverse(run), '{_REVERSED}|.'), lambda x: reverse(x))) AS b FROM r)
SELECT id, run, CASE WHEN len(f) + 2 * len(list_filter(f, lambda x: length(x) = 1)) <= len(b) + 2 * len(list_filter(b, lambda x: length(x) = 1)) THEN f ELSE b END AS words FROM m""")
def x2_segments(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    runs = spark.sql(_HAN).select("id", F.explode(text.han_runs(F.col("name"))).alias("run"))
    return runs.select("id", "run", text.segments(F.col("run"), [w for w in _WORDS]).alias("words"))



@query(with_views("SELECT DISTINCT urn, concat_ws(' ', display_name, urn, platform, owner, tag) AS text FROM asset", "asset"))
def x3_search_text(spark, sf_dir):
    own = load(spark, sf_dir, "asset").distinct()
    return own.select("urn", text.search_text(F.col("display_name"), F.col("urn"), F.col("platform"), F.col("owner"), F.col("tag")).alias("text")).distinct()


_ENTITY = "SELECT 'urn:asset:Dataset:prod.dw.s' || CAST(p_partkey % 3 AS STRING) || '.t' || CAST(p_partkey AS STRING) AS urn, p_name AS display_name FROM part"
_NAMES = "SELECT CASE k % 5 WHEN 0 THEN 't' || CAST(k AS STRING) WHEN 1 THEN 's' || CAST(k % 3 AS STRING) || '.t' || CAST(k AS STRING) WHEN 2 THEN 'urn:asset:Dataset:prod.dw.s' || CAST(k % 3 AS STRING) || '.t' || CAST(k AS STRING) WHEN 3 THEN n ELSE 'x' || CAST(k AS STRING) END AS name FROM (SELECT p_partkey AS k, p_name AS n FROM part) AS p"


@query(
    f"WITH e AS ({_ENTITY}), r AS (SELECT DISTINCT name FROM ({_NAMES}) x), h AS (SELECT name, min(urn) AS p, count(DISTINCT urn) AS c FROM r JOIN e ON ends_with(split_part(urn, ':', 4), '.' || name) OR split_part(urn, ':', 4) = name GROUP BY 1), d AS (SELECT display_name AS name, min(urn) AS p, count(DISTINCT urn) AS c FROM e GROUP BY 1) SELECT r.name, coalesce(e.urn, CASE WHEN h.c = 1 THEN h.p END, CASE WHEN d.c = 1 THEN d.p END) AS urn FROM r LEFT JOIN (SELECT DISTINCT urn FROM e) e ON e.urn = r.name LEFT JOIN h ON h.name = r.name LEFT JOIN d ON d.name = r.name"
)
def j8_resolve_tables(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return search.resolve_tables(spark.sql(_NAMES), spark.sql(_ENTITY))


@query("SELECT p_partkey, 'urn:asset:Dataset:prod.' || replace(replace(p_brand, '.', '_'), ' ', '_') || '.' || replace(p_name, ' ', '_') AS urn, 'Dataset' AS kind, 3 AS depth, 'urn:asset:Column:prod.' || replace(p_brand, ' ', '_') || '.' || replace(p_name, ' ', '_') || '.c_1' AS column_urn, true AS back FROM part")
def f7_urns(spark, sf_dir):
    own = load(spark, sf_dir, "part").select("p_partkey", urn.build("Dataset", F.lit("prod"), F.col("p_brand"), F.col("p_name")).alias("urn"))
    own = own.withColumn("column_urn", urn.column_urn(F.col("urn"), F.lit("c.1")))
    return own.select("p_partkey", "urn", urn.kind(F.col("urn")).alias("kind"), F.size(urn.path(F.col("urn"))).alias("depth"), "column_urn", (urn.dataset_of(F.col("column_urn")) == F.col("urn")).alias("back"))


_ASPECTS = "SELECT 'part:' || CAST(p_partkey AS STRING) AS urn, k AS aspect_type FROM part CROSS JOIN (SELECT 'ownership' AS k UNION ALL SELECT 'schema' UNION ALL SELECT 'description') AS a WHERE (k = 'ownership' AND p_partkey % 3 <> 0) OR (k = 'schema' AND p_partkey % 2 = 0) OR (k = 'description' AND p_partkey % 5 = 0)"
_PARTS = "SELECT 'part:' || CAST(p_partkey AS STRING) AS urn, CASE p_size % 12 WHEN 0 THEN 'user_email' WHEN 1 THEN 'MobilePhone' WHEN 2 THEN '手机号' WHEN 3 THEN 'salary' WHEN 4 THEN 'Passwd_hash' WHEN 5 THEN 'api_secret' WHEN 6 THEN 'card_no' WHEN 7 THEN '姓名' WHEN 8 THEN 'birth_day' WHEN 9 THEN 'ssn' WHEN 10 THEN '密码' ELSE 'amount' END AS column_name, CASE WHEN p_partkey % 7 = 0 THEN 'L3' END AS classification FROM part"
_FIXES = f"""asp AS ({_ASPECTS}), ent AS (SELECT DISTINCT urn FROM asset), co AS ({_PARTS}), fix AS (SELECT urn, 'missing_owner' AS kind, 0.75::DOUBLE AS confidence FROM ent WHERE urn NOT IN (SELECT urn FROM asp WHERE aspect_type = 'ownership') AND urn IN (SELECT from_urn FROM lineage_edge WHERE state = 'ACTIVE' GROUP BY 1 HAVING count(*) >= 2)
UNION ALL SELECT urn, 'missing_description', 0.6 FROM ent WHERE urn IN (SELECT urn FROM asp WHERE aspect_type = 'schema') AND urn NOT IN (SELECT urn FROM asp WHERE aspect_type = 'description') UNION ALL SELECT DISTINCT urn, 'ungraded_column', 0.7 FROM co WHERE regexp_matches(column_name, '(?i)phone|mobile|email|id_card|idcard|passwd|password|secret|token|ssn|bank|card_no|姓名|身份证|手机|电话|邮箱|地址|银行|密码') AND classification IS NULL)"""


def _fixes(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return search.suggest_fixes(load(spark, sf_dir, "asset").select("urn").distinct(), spark.sql(_ASPECTS), spark.sql(_PARTS), load(spark, sf_dir, "lineage_edge"))


@query(with_views(f"{_FIXES} SELECT * FROM fix", "asset", "lineage_edge"))
def n1_suggest_fixes(spark, sf_dir):
    return _fixes(spark, sf_dir)


_HELD = "SELECT 'part:' || CAST(p_partkey AS STRING) AS urn, CASE WHEN p_partkey % 2 = 0 THEN 'missing_owner' ELSE 'missing_description' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, CASE WHEN p_partkey % 3 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - (INTERVAL 1 DAY) * (p_partkey % 20) END AS decided_at, TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL 1 HOUR) * (p_partkey % 500) AS created_at, 0.4 + (p_size % 10) / 20.0 AS confidence FROM part"


@query(with_views(f"{_FIXES}, held AS ({_HELD}) SELECT * FROM fix WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.urn = fix.urn AND h.kind = fix.kind AND (status = 'PENDING' OR decided_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY))", "asset", "lineage_edge"))
def n2_dedup_suggestions(spark, sf_dir):
    new = _fixes(spark, sf_dir)
    return search.dedup_suggestions(new, spark.sql(_HELD), "2024-01-31 00:00:00")


@query(f"WITH held AS ({_HELD}) SELECT urn, kind, created_at FROM held WHERE status = 'PENDING' AND confidence >= 0.5 ORDER BY confidence DESC, created_at DESC, urn LIMIT 100")
def n3_inbox(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return search.inbox(spark.sql(_HELD)).select("urn", "kind", "created_at")


_DECIDED = "SELECT p_partkey AS suggestion_id, 'part:' || CAST(p_partkey % 50 AS STRING) AS urn, 'descriptions' AS aspect_type, CASE p_partkey % 2 WHEN 0 THEN 'text' ELSE 'owner' END AS field, p_name AS value, CASE p_partkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'known' END AS reason, TIMESTAMP '2024-01-31 00:00:00' - (INTERVAL 1 HOUR) * (p_partkey % 900) AS decided_at FROM part"


@query(f"WITH s AS ({_DECIDED}) SELECT epoch_us(decided_at) AS seq, suggestion_id::DOUBLE AS tie, urn, aspect_type, field, value, 'AI_GENERATED' AS source FROM s WHERE status = 'ACCEPTED'")
def n3_accepted_writes(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return search.accepted_writes(spark.sql(_DECIDED))[0]


@query(f"WITH s AS ({_DECIDED}) SELECT suggestion_id, 'a rejection needs a reason' AS problem FROM s WHERE status = 'REJECTED' AND trim(coalesce(reason, '')) = ''")
def n3_refused_verdicts(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return search.accepted_writes(spark.sql(_DECIDED))[1]


@query(f"WITH held AS ({_HELD}) SELECT kind, count(*) FILTER (status <> 'PENDING') AS reviewed, round(count(*) FILTER (status = 'ACCEPTED') / count(*) FILTER (status <> 'PENDING'), 4) AS rate FROM held GROUP BY 1")
def a12_acceptance_rate(spark, sf_dir):
    load(spark, sf_dir, "part").createOrReplaceTempView("part")
    return search.acceptance_rate(spark.sql(_HELD))
