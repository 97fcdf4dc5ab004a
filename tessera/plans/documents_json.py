"""Semi-structured documents: path projections, predicates, containment, arrays and edits, as JSON text and as variants, over `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import spread, table


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, d: each document as a struct."""
    o = spread(table(spark, sf_dir, "orders"))
    record = F.struct(
        F.when(F.col("o_orderkey") % 11 == 0, "BROKEN").otherwise("VALID").alias("validity"), F.concat(F.lit("F"), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("family"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("truncated"), F.lit("late"))).otherwise(F.array().cast("array<string>")).alias("diagnostics"),
    )
    fields = F.struct(
        F.struct(F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_custkey") % 5 * 100 + 4).cast("int")).alias("code"), F.col("o_orderstatus").alias("word")).alias("status"),
        F.struct(F.concat(F.lit("u"), F.col("o_custkey"), F.when(F.col("o_custkey") % 2 == 0, ".org").otherwise(".com")).alias("value")).alias("email"),
        F.struct((F.col("o_custkey") % 1800 / 10 - 90).alias("degrees")).alias("latitude"), F.struct(F.col("o_orderpriority").alias("value")).alias("priority"),
    )
    return o.select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderkey").alias("id"), record.alias("record"), fields.alias("fields")).alias("d"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc: canonical text with a fixed order of keys and explicit nulls."""
    return _objects(spark, sf_dir).select("id", F.to_json("d", {"ignoreNullFields": "false"}).alias("doc"))


_BASE = """d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'BROKEN' ELSE 'VALID' END AS validity, 'F' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS family, CASE WHEN o_orderkey % 7 = 0 THEN ['truncated', 'late'] ELSE [] END AS diagnostics,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey % 5 * 100 + 4 AS INT) END AS code, o_orderstatus AS word, 'u' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.org' ELSE '.com' END AS email, (o_custkey % 1800) / 10 - 90 AS degrees, o_orderpriority AS priority FROM orders)"""


def text(path: str):
    """A path of the text form: parsed for each call."""
    return F.get_json_object("doc", path)


def variants(spark, sf_dir):
    """id, v: the binary form, written straight from the values; no text is written and parsed on the way."""
    return _objects(spark, sf_dir).select("id", F.to_variant_object("d").alias("v"))


def value(path: str, kind: str = "string"):
    return F.try_variant_get("v", path, kind)


#: The hot paths, read in one pass.
SCHEMA = "id bigint, record struct<validity: string, family: string, diagnostics: array<string>>, fields struct<status: struct<code: int, word: string>, email: struct<value: string>, latitude: struct<degrees: double>, priority: struct<value: string>>"


def flat(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.from_json("doc", SCHEMA).alias("d"))
    return d.select("d.id", "d.record.validity", "d.record.family", "d.record.diagnostics", F.col("d.fields.status.code").alias("code"), F.col("d.fields.status.word").alias("word"), F.col("d.fields.email.value").alias("email"), F.col("d.fields.latitude.degrees").alias("degrees"), F.col("d.fields.priority.value").alias("priority"))


def _v(where):
    return lambda spark, sf_dir: variants(spark, sf_dir).filter(where()).select("id")


def _t(where):
    return lambda spark, sf_dir: documents(spark, sf_dir).filter(where()).select("id")


def whole_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.md5("doc").alias("digest"), F.char_length("doc").cast("long").alias("n_chars"))


def one_path(spark, sf_dir):
    return variants(spark, sf_dir).select("id", value("$.record.validity").alias("validity"))


def one_path_text(spark, sf_dir):
    return documents(spark, sf_dir).select("id", text("$.record.validity").alias("validity"))


def all_paths(spark, sf_dir):
    return flat(spark, sf_dir).withColumn("diagnostics", F.array_join("diagnostics", ","))


def point(spark, sf_dir):
    return documents(spark, sf_dir).filter("id = 42").select("id", text("$.fields.email.value").alias("email"))


def group_one(spark, sf_dir):
    return variants(spark, sf_dir).groupBy(value("$.record.family").alias("family")).agg(F.count("*").alias("n"))


def group_two(spark, sf_dir):
    return variants(spark, sf_dir).groupBy(value("$.fields.status.code").alias("code"), value("$.fields.status.word").alias("word")).agg(F.count("*").alias("n"))


def numbers(spark, sf_dir):
    lat = value("$.fields.latitude.degrees", "double")
    return variants(spark, sf_dir).filter(value("$.record.validity") == "VALID").agg(F.min(lat).alias("lo"), F.max(lat).alias("hi"), F.round(F.avg(lat), 6).alias("mean"))


def set_path(spark, sf_dir):
    """The typed edit: the struct is rebuilt and written again."""
    d = documents(spark, sf_dir).select("id", F.from_json("doc", SCHEMA).alias("d")).withColumn("d", F.when(F.col("id") % 10 == 0, F.col("d").withField("record.validity", F.lit("EDITED"))).otherwise(F.col("d")))
    return d.select("id", F.get_json_object(F.to_json("d"), "$.record.validity").alias("validity"), F.get_json_object(F.to_json("d"), "$.fields.status.word").alias("word"))


def edit_text(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.get_json_object(F.regexp_replace("doc", '"validity":"BROKEN"', '"validity":"FIXED"'), "$.record.validity").alias("validity"))


def valid_objects(spark, sf_dir):
    """Objects with unique keys; anything else is null."""
    cases = F.when(F.col("id") % 4 == 0, '{"a":1,"a":2}').when(F.col("id") % 4 == 1, "[1,2]").when(F.col("id") % 4 == 2, "{broken").otherwise(F.col("doc"))
    v = documents(spark, sf_dir).select("id", F.try_parse_json(cases).alias("v"))
    return v.select("id", (F.coalesce(F.schema_of_variant("v"), F.lit("")).startswith("OBJECT")).alias("ok"))


def elements(spark, sf_dir):
    return flat(spark, sf_dir).select("id", F.explode("diagnostics").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


_EXISTS = lambda: F.exists(F.from_json(text("$.record.diagnostics"), "array<string>"), lambda x: x == "truncated")
_WHERE = {
    "eq_rare": (_v(lambda: value("$.record.validity") == "BROKEN"), "validity = 'BROKEN'"),
    "eq_broad": (_v(lambda: value("$.record.family") == "F1"), "family = 'F1'"),
    "eq_integer": (_v(lambda: value("$.fields.status.code", "int") == 404), "code = 404"),
    "range_numeric": (_v(lambda: value("$.fields.latitude.degrees", "double").between(50, 55)), "degrees BETWEEN 50 AND 55"),
    "range_text": (_t(lambda: (text("$.fields.email.value") >= "u3") & (text("$.fields.email.value") < "u4")), "email >= 'u3' AND email < 'u4'"),
    "like_suffix": (_t(lambda: text("$.fields.email.value").endswith(".org")), "email LIKE '%.org'"),
    "like_prefix": (_t(lambda: text("$.fields.priority.value").startswith("1-")), "priority LIKE '1-%'"),
    "array_member": (_t(_EXISTS), "list_contains(diagnostics, 'truncated')"),
    "not_null": (_t(lambda: text("$.fields.status.code").isNotNull()), "code IS NOT NULL"),
    "conjunction": (_v(lambda: (value("$.record.family") == "F3") & (value("$.fields.status.code", "int") == 204)), "family = 'F3' AND code = 204"),
    "contains_path": (_v(lambda: (value("$.record.validity") == "BROKEN") & (value("$.fields.status.word") == "F")), "validity = 'BROKEN' AND word = 'F'"),
    "contains_element": (_v(lambda: F.array_contains(value("$.record.diagnostics", "array<string>"), "late")), "list_contains(diagnostics, 'late')"),
    "path_exists": (_v(lambda: F.coalesce(value("$.fields.status.code", "int") == 404, F.lit(False))), "code = 404"),
}
QUERIES = {f"json_{k}": q for k, (q, _) in _WHERE.items()} | {f"json_{f.__name__}": f for f in (one_path, one_path_text, all_paths, point, group_one, group_two, numbers, set_path, edit_text, valid_objects, elements, props)}
_SQL = {f"json_{k}": f"SELECT id FROM d WHERE {sql}" for k, (_, sql) in _WHERE.items()} | {
    "json_one_path": "SELECT id, validity FROM d",
    "json_one_path_text": "SELECT id, validity FROM d",
    "json_all_paths": "SELECT id, validity, family, array_to_string(diagnostics, ',') AS diagnostics, code, word, email, degrees, priority FROM d",
    "json_point": "SELECT id, email FROM d WHERE id = 42",
    "json_group_one": "SELECT family, count(*) AS n FROM d GROUP BY family",
    "json_group_two": "SELECT CAST(code AS VARCHAR) AS code, word, count(*) AS n FROM d GROUP BY ALL",
    "json_numbers": "SELECT min(degrees) AS lo, max(degrees) AS hi, round(avg(degrees), 6) AS mean FROM d WHERE validity = 'VALID'",
    "json_set_path": "SELECT id, CASE WHEN id % 10 = 0 THEN 'EDITED' ELSE validity END AS validity, word FROM d",
    "json_edit_text": "SELECT id, CASE WHEN validity = 'BROKEN' THEN 'FIXED' ELSE validity END AS validity FROM d",
    "json_valid_objects": "SELECT id, id % 4 = 3 AS ok FROM d",
    "json_elements": "SELECT code, count(*) AS n FROM (SELECT unnest(diagnostics) AS code FROM d) GROUP BY code",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
}
ORACLE = {k: f"WITH {_BASE} {v}" for k, v in _SQL.items()}
_DOC = """concat('{"id":', id, ',"record":{"validity":"', validity, '","family":"', family, '","diagnostics":[', CASE WHEN len(diagnostics) = 0 THEN '' ELSE '"truncated","late"' END, ']},"fields":{"status":{"code":',
  coalesce(CAST(code AS VARCHAR), 'null'), ',"word":"', word, '"},"email":{"value":"', email, '"},"latitude":{"degrees":', degrees, '},"priority":{"value":"', priority, '"}}}')"""
QUERIES["json_whole_documents"] = whole_documents
ORACLE["json_whole_documents"] = f"WITH {_BASE} SELECT id, md5(doc) AS digest, length(doc) AS n_chars FROM (SELECT id, {_DOC} AS doc FROM d)"
