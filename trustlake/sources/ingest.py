"""Catalog, file, document, manifest, BI, lineage-event and audit-log sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustlake.functions.storage import written
from trustlake.operators.search import resolve_tables

# Schemas of the system, file suffixes, kinds of manifest nodes, type families of JSON values.
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog", "pg_toast", "sys", "system"]
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".ndjson": "json", ".jsonl": "json"}
NODE_KINDS = ["model", "seed", "snapshot"]
NUMERIC = ["BIGINT", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT"]
EVENT_CONFIDENCE = 0.95


def catalog_datasets(tables: DataFrame, columns: DataFrame, keys: DataFrame, partition_keys: DataFrame | None = None) -> DataFrame:
    """Datasets with their columns in order and primary keys (S1, S2); system schemas and tables without columns are left out.

    ``tables``: schema_name, table_name, row_estimate. ``columns``: schema_name, table_name, column_name, ordinal, type,
    nullable. ``keys``: schema_name, table_name, column_name. ``partition_keys``: schema_name, table_name, role, expression.
    """
    k = ["schema_name", "table_name"]
    own = tables.filter(~F.lower("schema_name").isin(SYSTEM_SCHEMAS))
    cols = columns.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "type", "nullable"))).alias("columns"))
    pk = keys.groupBy(*k).agg(F.sort_array(F.collect_list("column_name")).alias("primary_key"))
    out = own.join(cols, k).join(pk, k, "left").withColumn("precision", F.when(F.col("row_estimate").isNotNull(), "estimated"))
    if partition_keys is not None:
        parts = partition_keys.filter("expression IS NOT NULL AND expression != ''").groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("role", "expression"))).alias("partition_keys"))
        out = out.join(parts, k, "left")
    return out


def file_datasets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The schema of each file, no data read but what inference needs; unknown suffixes are skipped (S3). Rows: path, format, column_name, ordinal, type, schema_hash."""
    rows = []
    for p in paths:
        suffix = next((s for s in FORMATS if p.lower().rstrip("/").endswith(s)), None)
        if suffix is None:
            continue
        kind = FORMATS[suffix]
        reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
        rows += [(p, kind, f.name, i, f.dataType.simpleString()) for i, f in enumerate(reader.format(kind).load(p).schema.fields)]
    df = spark.createDataFrame(rows, "path string, format string, column_name string, ordinal int, type string")
    hashed = df.groupBy("path").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "type")))), 256).alias("schema_hash"))
    return df.join(hashed, "path")


def infer_document_schema(df: DataFrame, json_col: str, max_depth: int = 4) -> DataFrame:
    """Paths of nested JSON documents with their type, nullability and coverage.

    Types are a set per path: numbers are one family, arrays are ``array<T>``, ``array<mixed>`` or ``array<unknown>``,
    several families are ``mixed(a|b)``. A path is nullable if a document lacks it or has null there. Text that is no
    JSON object counts as a document without paths.
    """
    docs = df.select(F.monotonically_increasing_id().alias("doc"), F.try_parse_json(F.col(json_col)).alias("v"))
    level = docs.select("doc", F.lit("").alias("path"), "v")
    parts = []
    for _ in range(max_depth):
        objects = level.filter(F.schema_of_variant("v").startswith("OBJECT"))
        level = _explode_objects(objects)
        parts.append(level.select("doc", "path", _family(F.schema_of_variant("v")).alias("family")))
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    total = docs.agg(F.count("*").alias("total"))
    own = seen.groupBy("path").agg(F.sort_array(F.array_distinct(F.filter(F.collect_set("family"), lambda x: x != "null"))).alias("families"), F.count_distinct("doc").alias("docs"), F.max(F.col("family") == "null").alias("has_null"))
    kind = F.when(F.size("families") == 0, "unknown").when(F.size("families") == 1, F.col("families")[0]).otherwise(F.concat(F.lit("mixed("), F.array_join("families", "|"), F.lit(")")))
    return own.crossJoin(F.broadcast(total)).select("path", kind.alias("type"), (F.col("has_null") | (F.col("docs") < F.col("total"))).alias("nullable"), F.round(100 * F.col("docs") / F.col("total"), 2).alias("coverage"))


def _explode_objects(objects: DataFrame) -> DataFrame:
    keyed = objects.select("doc", "path", F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias("key", "v"))
    return keyed.select("doc", F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key")).alias("path"), "v")


def _family(schema: Column) -> Column:
    scalar = lambda s: F.when(s.rlike("^(" + "|".join(NUMERIC) + "|DECIMAL)"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.startswith("OBJECT"), "object").otherwise("other")
    inner = F.regexp_extract(schema, "^ARRAY<(.*)>$", 1)
    array = F.when(inner == "VOID", "array<unknown>").when(inner == "VARIANT", "array<mixed>").otherwise(F.concat(F.lit("array<"), scalar(inner), F.lit(">")))
    return F.when(schema.startswith("ARRAY<"), array).when(schema.isNull(), "null").otherwise(scalar(schema))


MANIFEST = "struct<nodes:map<string,struct<resource_type:string,schema:string,alias:string,depends_on:struct<nodes:array<string>>>>,sources:map<string,struct<schema:string,identifier:string>>>"


def manifest_rows(manifests: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind, name) and dependencies (node_id, upstream) of build manifests; ids with colons are taken as with dots.

    Manifests are parsed once, into a written table.
    """
    m = written(manifests.select(F.from_json(F.col(json_col), MANIFEST).alias("m")), "manifests")
    dotted = lambda c: F.translate(c, ":", ".")
    nodes = m.select(F.explode("m.nodes").alias("id", "n")).filter(F.col("n.resource_type").isin(NODE_KINDS))
    own = nodes.select(dotted(F.col("id")).alias("node_id"), F.col("n.resource_type").alias("kind"), F.concat_ws(".", "n.schema", "n.alias").alias("name"))
    src = m.select(F.explode("m.sources").alias("id", "s")).select(dotted(F.col("id")).alias("node_id"), F.lit("source").alias("kind"), F.concat_ws(".", "s.schema", "s.identifier").alias("name"))
    deps = nodes.select(dotted(F.col("id")).alias("node_id"), F.explode("n.depends_on.nodes").alias("u")).select("node_id", dotted(F.col("u")).alias("upstream"))
    return own.unionByName(src), deps


def manifest_edges(manifests: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Edges between the names of a manifest's nodes, and upstreams that it does not have, counted.

    Both sides of the joins are written, so that Spark knows how large they are and sends none to all tasks that is not small.
    """
    nodes, deps = (written(df, label) for df, label in zip(manifest_rows(manifests, json_col), ("nodes", "dependencies")))
    up = nodes.select(F.col("node_id").alias("upstream"), F.col("name").alias("from_name"))
    edges = deps.join(nodes, "node_id").join(up, "upstream").select("from_name", F.col("name").alias("to_name"))
    skipped = deps.join(up, "upstream", "left_anti").groupBy("upstream").agg(F.count("*").alias("skipped"))
    return edges.distinct(), skipped


def dashboard_edges(dashboards: DataFrame, charts: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from physical tables to dashboards, and charts with whether they were resolved.

    ``dashboards``: dashboard_id, charts array<string>, owner_email, owner_name, owner_id. ``charts``: chart_name,
    datasource, is_physical.
    """
    owner = F.coalesce("owner_email", "owner_name", F.col("owner_id").cast("string"))
    each = dashboards.select("dashboard_id", owner.alias("owner"), F.explode_outer("charts").alias("chart_name")).join(charts, "chart_name", "left")
    urns = resolve_tables(each.filter("is_physical").select(F.col("datasource").alias("name")), entity)
    out = each.join(urns.withColumnRenamed("name", "datasource"), "datasource", "left").withColumn("resolved", F.coalesce(F.col("is_physical") & F.col("urn").isNotNull(), F.lit(False)))
    edges = out.filter("resolved").select(F.col("urn").alias("from_urn"), "dashboard_id", "owner").distinct()
    return edges, out.select("dashboard_id", "chart_name", "resolved")


_LINEAGE = "struct<columnLineage:struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string,transformations:array<struct<type:string,masking:boolean>>>>>>>>"
RUN_EVENT = f"struct<eventTime:string,inputs:array<struct<namespace:string,name:string,facets:{_LINEAGE}>>,outputs:array<struct<namespace:string,name:string,facets:{_LINEAGE}>>>"


def openlineage_edges(events: DataFrame, json_col: str = "json") -> DataFrame:
    """Table and column edges of run events, batch or stream (S7): rows (from_name, to_name, level, transform, confidence).

    Column lineage is an output's facet; where an output has none, that of the event's first input stands for it, since
    some producers put it there. Input fields without a table or a column are left out.
    """
    e = events.select(F.from_json(F.col(json_col), RUN_EVENT).alias("e")).select("e.outputs", F.coalesce("e.inputs", F.from_json(F.lit("[]"), f"array<struct<namespace:string,name:string,facets:{_LINEAGE}>>")).alias("inputs"))
    name = lambda s: F.concat_ws(".", s["namespace"], s["name"])
    pairs = F.flatten(F.transform("outputs", lambda o: F.transform("inputs", lambda i: F.struct(name(i).alias("from_name"), name(o).alias("to_name"), F.lit("table").alias("level"), F.lit("DIRECT").alias("transform")))))
    of_input = F.get("inputs", F.lit(0))["facets"]["columnLineage"]["fields"]

    def of_field(o: Column, f: Column) -> Column:
        kind = lambda i: F.when(F.exists(i["transformations"], lambda t: F.coalesce(t["masking"], F.lit(False))), "MASKED").when(F.exists(i["transformations"], lambda t: t["type"] == "INDIRECT"), "INDIRECT").otherwise("DIRECT")
        there = F.filter(f["value"]["inputFields"], lambda i: (F.trim(i["name"]) != "") & (F.trim(i["field"]) != ""))
        return F.transform(there, lambda i: F.struct(F.concat_ws(".", i["namespace"], i["name"], i["field"]).alias("from_name"), F.concat_ws(".", o["namespace"], o["name"], f["key"]).alias("to_name"), F.lit("column").alias("level"), kind(i).alias("transform")))

    # flatten is null if one of the arrays is.
    known = lambda o: F.filter(F.map_entries(F.coalesce(o["facets"]["columnLineage"]["fields"], of_input)), lambda f: f["value"]["inputFields"].isNotNull())
    none = F.from_json(F.lit("[]"), "array<struct<from_name:string,to_name:string,level:string,transform:string>>")
    fields = F.flatten(F.transform("outputs", lambda o: F.coalesce(F.flatten(F.transform(known(o), lambda f: of_field(o, f))), none)))
    return e.select(F.explode(F.concat(pairs, fields)).alias("x")).select("x.*", F.lit(EVENT_CONFIDENCE).alias("confidence"))


#: Names under which a JSON document may hold its records.
RECORD_KEYS = ["records", "data", "queries", "events"]


def read_audit_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An audit log as it is, nothing parsed or filled in (S8): ``jsonl``, ``csv`` with a header, or ``json``, a document that is an array of records or holds one."""
    if kind == "csv":
        df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        return df.withColumnsRenamed({c: c.removeprefix("\ufeff") for c in df.columns})
    if kind not in ("jsonl", "json"):
        raise ValueError(f"unknown kind of log {kind}")
    df = spark.read.option("multiLine", kind == "json").json(path)
    held = [k for k in RECORD_KEYS if kind == "json" and k in df.columns and df.schema[k].dataType.typeName() == "array"]
    return df.select(F.inline(held[0])) if held else df


def audit_log_stream(spark: SparkSession, path: str, kind: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """``read_audit_log`` of a folder that grows, as a stream; a stream needs the records' schema."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if kind == "csv":
        return reader.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    if kind not in ("jsonl", "json"):
        raise ValueError(f"unknown kind of log {kind}")
    if kind == "jsonl":
        return reader.schema(schema).json(path)
    held = ", ".join(f"{k} array<struct<{', '.join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))}>>" for k in RECORD_KEYS)
    whole = reader.schema(held).option("multiLine", True).json(path)
    return whole.select(F.inline(F.coalesce(*RECORD_KEYS)))


def sink_datasets(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, ``contains`` edges and schema facts of dataset rows (S12): platform, schema_name, table_name, columns."""
    urn = lambda kind, *parts: F.concat(F.lit(f"urn:asset:{kind}:"), F.concat_ws(".", *[F.translate(p, ".: ", "___") for p in parts]))
    p, s, t = F.col("platform"), F.col("schema_name"), F.col("table_name")
    rows = raw.select(urn("Platform", p).alias("a"), urn("Container", p, s).alias("b"), urn("Dataset", p, s, t).alias("c"), p.alias("pn"), s.alias("sn"), t.alias("tn"), F.to_json("columns").alias("schema"))
    entity = rows.select(F.inline(F.array(*[F.struct(F.col(u).alias("urn"), F.lit(k).alias("entity_type"), F.col(n).alias("display_name")) for u, k, n in (("a", "Platform", "pn"), ("b", "Container", "sn"), ("c", "Dataset", "tn"))]))).distinct()
    edge = rows.select(F.inline(F.array(*[F.struct(F.col(x).alias("from_urn"), F.col(y).alias("to_urn"), F.lit("contains").alias("edge_type")) for x, y in (("a", "b"), ("b", "c"))]))).distinct()
    return entity, edge, rows.select(F.col("c").alias("urn"), F.lit("schema").alias("aspect_type"), F.col("schema").alias("value"), F.lit("AUTO_COLLECTED").alias("source"))


def metric_edges(metrics: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from uniquely resolved columns to metrics, and per metric the columns that were not (S13): metric, columns array<string>."""
    each = metrics.select("metric", F.explode_outer("columns").alias("name"))
    urns = resolve_tables(each.filter("name IS NOT NULL").select("name"), entity)
    out = each.join(urns, "name", "left")
    missing = out.filter("name IS NOT NULL AND urn IS NULL").groupBy("metric").agg(F.sort_array(F.collect_set("name")).alias("unresolved"))
    return out.filter("urn IS NOT NULL").select(F.col("urn").alias("from_urn"), "metric").distinct(), missing


def validate_aspects(aspects: DataFrame, definitions: DataFrame) -> DataFrame:
    """Violations of aspects by property definitions (F11): required, type, enum, and unknown keys without a namespace.

    ``aspects``: urn, aspect_type, data (JSON object). ``definitions``: aspect_type, property, kind, required, enum_values.
    """
    props = aspects.select("urn", "aspect_type", F.explode(F.from_json("data", "map<string,variant>")).alias("property", "v")).withColumn("kind_found", _family(F.schema_of_variant("v")))
    d = definitions.withColumnRenamed("kind", "kind_wanted")
    j = props.join(d, ["aspect_type", "property"], "left")
    want = F.when(F.col("kind_wanted").isin("integer", "number"), "number").when(F.col("kind_wanted") == "enum", "string").otherwise(F.col("kind_wanted"))
    free = F.col("property").startswith("x_") | F.col("property").rlike("[:.]")
    problem = (
        F.when(F.col("kind_wanted").isNull(), F.when(~free, "unknown_property"))
        .when((F.col("kind_found") != "null") & (F.col("kind_found") != want) & ~((F.col("kind_wanted") == "array") & F.col("kind_found").startswith("array")), "wrong_type")
        .when((F.col("kind_wanted") == "enum") & (F.col("kind_found") == "string") & ~F.array_contains("enum_values", F.col("v").cast("string")), "not_in_enum")
    )
    bad = j.withColumn("problem", problem).filter("problem IS NOT NULL").select("urn", "aspect_type", "property", "problem")
    there = props.filter("kind_found != 'null'").select("urn", "aspect_type", "property")
    missing = aspects.select("urn", "aspect_type").distinct().join(d.filter("required").select("aspect_type", "property"), "aspect_type").join(there.hint("merge"), ["urn", "aspect_type", "property"], "left_anti")
    return bad.unionByName(missing.select("urn", "aspect_type", "property", F.lit("missing_required").alias("problem")))
