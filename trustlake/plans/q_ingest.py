"""Sources over driver tables and documents made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlake.functions.storage import new_path
from trustlake.operators import access, search
from trustlake.plans.fixtures import TABLES, load, spread, with_views
from trustlake.plans.registry import query
from trustlake.sources import ingest

#: A table in the catalog for each part.
_CATALOG = "t AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'pg_catalog' ELSE 's' || CAST(p_size AS STRING) END AS schema_name, 't' || p_partkey AS table_name, p_partkey AS k FROM part)"


@query(f"""
WITH {_CATALOG} SELECT schema_name, table_name, k AS row_estimate, list_transform(range(1, k % 3 + 2), lambda i: 'c' || i) AS column_names, CASE WHEN k % 2 = 0 THEN ['c1'] END AS primary_key, 'estimated' AS precision, CASE WHEN k % 4 = 0 THEN ['partition:day'] END AS partition_keys FROM t WHERE schema_name <> 'pg_catalog' AND k % 5 <> 4""")
def s1_catalog_datasets(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    own = part.select(F.when(F.col("p_size") % 7 == 0, "pg_catalog").otherwise(F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("schema_name"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table_name"), F.col("p_partkey").alias("k"))
    columns = own.filter("k % 5 != 4").select("schema_name", "table_name", F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int"))).alias("ordinal")).select("schema_name", "table_name", F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("column_name"), "ordinal", F.lit("int").alias("type"), F.lit(True).alias("nullable"))
    keys = own.filter("k % 2 = 0").select("schema_name", "table_name", F.lit("c1").alias("column_name"))
    parts = own.select("schema_name", "table_name", F.lit("partition").alias("role"), F.when(F.col("k") % 4 == 0, "day").alias("expression"))
    out = ingest.catalog_datasets(own.withColumnRenamed("k", "row_estimate"), columns, keys, parts)
    return out.select("schema_name", "table_name", "row_estimate", F.col("columns.column_name").alias("column_names"), "primary_key", "precision", F.transform("partition_keys", lambda p: F.concat_ws(":", p["role"], p["expression"])).alias("partition_keys"))


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}


@query("SELECT table_name, column_name, column_index - 1 AS ordinal, " + "CASE data_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END AS type FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def s3_file_datasets(spark, sf_dir):
    found = ingest.file_datasets(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES] + [f"{sf_dir}/readme.unknown"])
    return found.select(F.regexp_extract("path", r"/(\w+)\.parquet$", 1).alias("table_name"), "column_name", "ordinal", "type")


_NESTED = """'{"id":' || event_id || ',"kind":' || CASE WHEN event_id % 4 = 0 THEN 'null' WHEN event_id % 4 = 1 THEN '1.5' ELSE '"' || event_type || '"' END || ',"tags":' || CASE WHEN event_id % 3 = 0 THEN '[]' ELSE '["a","b"]' END || ',"geo":{"lat":1.5' || CASE WHEN event_id % 2 = 0 THEN ',"zip":"x"' ELSE '' END || '}}'"""


@query("""
WITH t AS (SELECT count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS z FROM events)
SELECT * FROM (SELECT 'id' AS path, 'number' AS type, false AS nullable, 100.0::DOUBLE AS coverage FROM t UNION ALL SELECT 'kind', 'mixed(number|string)', true, 100.0 FROM t UNION ALL SELECT 'tags', 'mixed(array<string>|array<unknown>)', false, 100.0 FROM t UNION ALL SELECT 'geo', 'object', false, 100.0 FROM t UNION ALL SELECT 'geo.lat', 'number', false, 100.0 FROM t UNION ALL SELECT 'geo.zip', 'string', true, round(100 * z / n, 2) FROM t)""")
def s4_document_schema(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return ingest.infer_document_schema(spark.sql(f"SELECT {_NESTED} AS json FROM events".replace("|| event_id ||", "|| CAST(event_id AS STRING) ||")), "json")


@query("SELECT 'k' AS path, 'number' AS type, false AS nullable, 100.0::DOUBLE AS coverage FROM events HAVING count(*) > 0")
def s4_props_schema(spark, sf_dir):
    return ingest.infer_document_schema(load(spark, sf_dir, "events"), "props")


def _manifests(spark, sf_dir):
    """A manifest per part: a model that reads a source, a model that reads it and something missing, and a test."""
    k = F.col("p_partkey").cast("string")
    node = lambda kind, alias, *deps: F.concat(F.lit(f'{{"resource_type":"{kind}","schema":"dw","alias":"{alias}'), k, F.lit('","depends_on":{"nodes":['), F.concat_ws(",", *[F.concat(F.lit('"'), d, F.lit('"')) for d in deps]), F.lit("]}}"))
    a, b = F.concat(F.lit("model.p.a"), k), F.concat(F.lit("model:p:b"), k)
    src = F.concat(F.lit("source.p.s"), k)
    json = F.concat(
        F.lit('{"nodes":{"'), a, F.lit('":'), node("model", "a", src), F.lit(',"'), b, F.lit('":'), node("seed", "b", F.concat(F.lit("model.p.a"), k), F.lit("model.p.gone")), F.lit(',"test.p.t":'), node("test", "t", a),
        F.lit('},"sources":{"'), src, F.lit('":{"schema":"raw","identifier":"s'), k, F.lit('"}}}'),
    )
    return spread(load(spark, sf_dir, "part"), "p_partkey").select(json.alias("json"))


@query("SELECT 'raw.s' || p_partkey AS from_name, 'dw.a' || p_partkey AS to_name FROM part UNION ALL SELECT 'dw.a' || p_partkey, 'dw.b' || p_partkey FROM part")
def s5_manifest_edges(spark, sf_dir):
    return ingest.manifest_edges(_manifests(spark, sf_dir))[0]


@query("SELECT 'model.p.gone' AS upstream, count(*) AS skipped FROM part")
def s5_skipped_upstreams(spark, sf_dir):
    return ingest.manifest_edges(_manifests(spark, sf_dir))[1]


_TABLES = "SELECT 'urn:asset:Dataset:prod.dw.t' || CAST(p_partkey AS STRING) AS urn, p_name AS display_name FROM part"
_DASH = "SELECT s_suppkey AS dashboard_id, s_nationkey AS n, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'm' || CAST(s_suppkey AS STRING) END AS owner_email, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS owner_name, s_suppkey AS owner_id FROM supplier"
_CHART = "SELECT 'ch' || CAST(p_partkey AS STRING) AS chart_name, CASE WHEN p_partkey % 4 = 0 THEN 'gone' ELSE 'dw.t' END || CAST(p_partkey AS STRING) AS datasource, p_partkey % 5 <> 0 AS is_physical FROM part WHERE p_partkey % 7 <> 0"


def _dashboards(spark, sf_dir):
    spread(load(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView("part")
    load(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    dash = spark.sql(_DASH).withColumn("charts", F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat(F.lit("ch"), (F.col("n") * 7 + i).cast("string"))))
    return ingest.dashboard_edges(dash, spark.sql(_CHART), spark.sql(_TABLES))


_DASHED = f"e AS ({_TABLES}), d AS ({_DASH}), c AS ({_CHART}), x AS (SELECT dashboard_id, coalesce(owner_email, owner_name, CAST(owner_id AS VARCHAR)) AS owner, 'ch' || (n * 7 + i) AS chart_name FROM d, (VALUES (1), (2), (3)) v(i)), y AS (SELECT x.*, urn, coalesce(is_physical AND urn IS NOT NULL, false) AS resolved FROM x LEFT JOIN c USING (chart_name) LEFT JOIN e ON split_part(urn, ':', 4) = 'prod.' || datasource)"


@query(f"WITH {_DASHED} SELECT DISTINCT urn AS from_urn, dashboard_id, owner FROM y WHERE resolved")
def s6_dashboard_edges(spark, sf_dir):
    return _dashboards(spark, sf_dir)[0]


@query(f"WITH {_DASHED} SELECT dashboard_id, chart_name, resolved FROM y")
def s6_dashboard_charts(spark, sf_dir):
    return _dashboards(spark, sf_dir)[1]


def lineage_events(orders, at_input=False):
    """A run event per order: one input, one output, and column lineage that is masked or not, at the output or the input.

    At the input, every fifth names no table.
    """
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    table = F.when(F.lit(at_input) & (F.col("o_orderkey") % 5 == 0), " ").otherwise(F.concat(F.lit("c"), c))
    facet = F.concat(
        F.lit(',"facets":{"columnLineage":{"fields":{"x":{"inputFields":[{"namespace":"n","name":"'), table, F.lit('","field":"y","transformations":[{"type":"'), F.when(F.col("o_orderkey") % 2 == 0, "DIRECT").otherwise("INDIRECT"),
        F.lit('","masking":'), F.when(F.col("o_orderkey") % 3 == 0, "true").otherwise("false"), F.lit("}]}]}}}}"),
    )
    none = F.lit("")
    return orders.select(
        F.concat(
            F.lit('{"eventTime":"2024-01-01","inputs":[{"namespace":"n","name":"c'), c, F.lit('"'), facet if at_input else none,
            F.lit('}],"outputs":[{"namespace":"n","name":"o'), o, F.lit('"'), none if at_input else facet, F.lit("}]}"),
        ).alias("json")
    )


@query("""
SELECT 'n.c' || o_custkey AS from_name, 'n.o' || o_orderkey AS to_name, 'table' AS level, 'DIRECT' AS transform, 0.95::DOUBLE AS confidence FROM orders
UNION ALL SELECT 'n.c' || o_custkey || '.y', 'n.o' || o_orderkey || '.x', 'column', CASE WHEN o_orderkey % 3 = 0 THEN 'MASKED' WHEN o_orderkey % 2 = 1 THEN 'INDIRECT' ELSE 'DIRECT' END, 0.95 FROM orders""")
def s7_openlineage_edges(spark, sf_dir):
    return ingest.openlineage_edges(lineage_events(load(spark, sf_dir, "orders")))


@query("""
SELECT 'n.c' || o_custkey AS from_name, 'n.o' || o_orderkey AS to_name, 'table' AS level, 'DIRECT' AS transform, 0.95::DOUBLE AS confidence FROM orders
UNION ALL SELECT 'n.c' || o_custkey || '.y', 'n.o' || o_orderkey || '.x', 'column', CASE WHEN o_orderkey % 3 = 0 THEN 'MASKED' WHEN o_orderkey % 2 = 1 THEN 'INDIRECT' ELSE 'DIRECT' END, 0.95 FROM orders WHERE o_orderkey % 5 <> 0""")
def s7_input_facets(spark, sf_dir):
    return ingest.openlineage_edges(lineage_events(load(spark, sf_dir, "orders"), True))


_LOGGED = "SELECT 'q' || CAST(event_id AS STRING) AS queryId, CAST(ts AS STRING) AS eventTime, 'u' || CAST(user_id AS STRING) AS user, 'app.' || event_type AS `table`, event_type AS op FROM events"


def write_documents(df, path):
    """A JSON document a file, as readers of whole documents need them: what follows the first one of a file is not read."""
    df.write.option("maxRecordsPerFile", 1).json(path)


@query("SELECT k AS kind, 'q' || event_id AS query_id, ts AS event_time, 'u' || user_id AS actor, 'app.' || event_type AS resource, upper(event_type) AS operation FROM events, (VALUES ('jsonl'), ('csv'), ('json')) v(k)")
def s8_audit_log(spark, sf_dir):
    """The events as a log in each form, written, read back and brought under common names."""
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    log, out = spark.sql(_LOGGED), None
    for kind in ("jsonl", "csv", "json"):
        path = new_path(spark, f"log-{kind}")
        if kind == "jsonl":
            log.write.json(path)
        elif kind == "csv":
            log.write.option("header", True).csv(path)
        else:
            # Users are dealt out to a hundred documents.
            write_documents(log.groupBy(F.pmod(F.xxhash64("user"), F.lit(100)).alias("b")).agg(F.collect_list(F.struct(*log.columns)).alias("records")).select("records"), path)
        own = access.normalize_audit(ingest.read_audit_log(spark, path, kind))[0].select(F.lit(kind).alias("kind"), "query_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "actor", "resource", "operation")
        out = own if out is None else out.unionByName(own)
    return out


def _sunk(spark, sf_dir):
    own = load(spark, sf_dir, "part").select(F.lit("wh").alias("platform"), F.col("p_brand").alias("schema_name"), F.col("p_name").alias("table_name"), F.array(F.col("p_type")).alias("columns"))
    return ingest.sink_datasets(own)


_CLEAN = "replace(replace(replace({0}, '.', '_'), ':', '_'), ' ', '_')"


@query(f"SELECT 'urn:asset:Platform:wh' AS urn, 'Platform' AS entity_type, 'wh' AS display_name UNION SELECT 'urn:asset:Container:wh.' || {_CLEAN.format('p_brand')}, 'Container', p_brand FROM part UNION SELECT 'urn:asset:Dataset:wh.' || {_CLEAN.format('p_brand')} || '.' || {_CLEAN.format('p_name')}, 'Dataset', p_name FROM part")
def s12_sink_entities(spark, sf_dir):
    return _sunk(spark, sf_dir)[0]


@query(f"SELECT 'urn:asset:Platform:wh' AS from_urn, 'urn:asset:Container:wh.' || {_CLEAN.format('p_brand')} AS to_urn, 'contains' AS edge_type FROM part UNION SELECT 'urn:asset:Container:wh.' || {_CLEAN.format('p_brand')}, 'urn:asset:Dataset:wh.' || {_CLEAN.format('p_brand')} || '.' || {_CLEAN.format('p_name')}, 'contains' FROM part")
def s12_sink_edges(spark, sf_dir):
    return _sunk(spark, sf_dir)[1]


def _metrics(spark, sf_dir):
    spread(load(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView("part")
    own = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("metric"), F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.concat(F.lit("t"), (F.col("s_suppkey") * 11 + i * 5000).cast("string"))).alias("columns"))
    return ingest.metric_edges(own, spark.sql(_TABLES))


_METRIC = f"e AS ({_TABLES}), m AS (SELECT s_name AS metric, 't' || (s_suppkey * 11 + i * 5000) AS name FROM supplier, (VALUES (0), (1)) v(i)), j AS (SELECT * FROM m LEFT JOIN e ON urn = 'urn:asset:Dataset:prod.dw.' || name)"


@query(f"WITH {_METRIC} SELECT DISTINCT urn AS from_urn, metric FROM j WHERE urn IS NOT NULL")
def s13_metric_edges(spark, sf_dir):
    return _metrics(spark, sf_dir)[0]


@query(f"WITH {_METRIC} SELECT metric, list_sort(list(DISTINCT name)) AS unresolved FROM j WHERE urn IS NULL GROUP BY 1")
def s13_unresolved(spark, sf_dir):
    return _metrics(spark, sf_dir)[1]


@query("""
WITH a AS (SELECT 'part:' || p_partkey AS urn, p_partkey AS k FROM part)
SELECT urn, 'info' AS aspect_type, 'size' AS property, 'wrong_type' AS problem FROM a WHERE k % 3 = 0 UNION ALL SELECT urn, 'info', 'tier', 'not_in_enum' FROM a WHERE k % 4 = 0 UNION ALL SELECT urn, 'info', 'odd', 'unknown_property' FROM a WHERE k % 5 = 0 UNION ALL SELECT urn, 'info', 'name', 'missing_required' FROM a WHERE k % 7 = 0""")
def f11_validate_aspects(spark, sf_dir):
    k = F.col("p_partkey")
    data = F.concat(
        F.lit('{"size":'), F.when(k % 3 == 0, '"big"').otherwise("3"), F.lit(',"tier":'), F.when(k % 4 == 0, '"z"').otherwise('"a"'), F.when(k % 5 == 0, ',"odd":1,"x_own":1').otherwise(""), F.when(k % 7 == 0, "").otherwise(',"name":"n"'), F.lit("}")
    )
    aspects = spread(load(spark, sf_dir, "part"), "p_partkey").select(F.concat(F.lit("part:"), k.cast("string")).alias("urn"), F.lit("info").alias("aspect_type"), data.alias("data"))
    defs = spark.createDataFrame([("info", "size", "integer", False, None), ("info", "tier", "enum", False, ["a", "b"]), ("info", "name", "string", True, None)], "aspect_type string, property string, kind string, required boolean, enum_values array<string>")
    return ingest.validate_aspects(aspects, defs)


_FACTS = "SELECT urn, k AS field, k || ' ' || display_name AS value, 1 AS seq FROM asset CROSS JOIN (SELECT 'name' AS k UNION ALL SELECT 'tags') AS ks"


@query(with_views("a AS (SELECT urn, max(display_name) AS n FROM asset GROUP BY 1) SELECT urn, 'name ' || n || ' ' || urn || ' tags ' || n AS text FROM a WHERE urn NOT LIKE '%9'", "asset"))
def r1_search_docs(spark, sf_dir):
    asset = load(spark, sf_dir, "asset")
    asset.createOrReplaceTempView("asset")
    entity = asset.select("urn", "entity_type", F.when(F.col("urn").endswith("9"), "TOMBSTONE").otherwise("ACTIVE").alias("lifecycle")).dropDuplicates(["urn"])
    return search.build_search_docs(entity, spark.sql(_FACTS)).select("urn", "text")


_ENTITY = "SELECT 'urn:asset:Dataset:prod.' || p_brand || '.s' || CAST(p_partkey % 9 AS STRING) || '.t' || CAST(p_partkey AS STRING) AS urn, CASE WHEN p_partkey % 10 = 0 THEN 'Incident' ELSE 'Dataset' END AS entity_type, CASE WHEN p_partkey % 7 = 0 THEN 'TOMBSTONE' ELSE 'ACTIVE' END AS lifecycle, p_partkey AS k, p_name AS n FROM part"
_FIELDS = f"SELECT urn, f AS field, CASE f WHEN 'owners' THEN ' ann, bob ,' WHEN 'tags' THEN 'core,' || n WHEN 'classification' THEN 'L3' WHEN 'name' THEN CASE WHEN k % 4 = 0 THEN ' ' ELSE n END ELSE 'd ' || n END AS value, 1 AS seq FROM ({_ENTITY}) e CROSS JOIN (SELECT 'owners' AS f UNION ALL SELECT 'tags' UNION ALL SELECT 'classification' UNION ALL SELECT 'name' UNION ALL SELECT 'description') fs WHERE k % 5 <> 0 OR f <> 'owners'"


@query(rf"""
WITH e AS ({_ENTITY}) SELECT urn, entity_type, CASE WHEN k % 4 = 0 THEN 't' || k ELSE n END AS display_name, split_part(substr(urn, 19), '.', 2) AS platform, split_part(substr(urn, 19), '.', 2) || '.s' || k % 9 AS container, 'd ' || n AS description, ['core', n] AS tags, CASE WHEN k % 5 <> 0 THEN ['ann', 'bob'] ELSE [] END AS owners, 'L3' AS classification, false AS deleted FROM e WHERE lifecycle = 'ACTIVE' AND entity_type = 'Dataset'
UNION ALL SELECT urn, entity_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM e WHERE lifecycle <> 'ACTIVE' AND entity_type = 'Dataset'""")
def r1_search_doc_changes(spark, sf_dir):
    spread(load(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView("part")
    return search.search_doc_changes(spark.sql(_ENTITY), spark.sql(_FIELDS)).drop("text")
