"""The flat form of parsed lines: 71 typed columns in a row for each line, and the documents of 70 leaves that are written from it.

A line is parsed once, and its typed values are read in the same pass: a row in, a row out, nothing is shuffled. Only valid values have a
typed form, except that the shape of a time is named whenever it has one. A zone given by letters other than Z has no offset, so such a
time has no instant.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.logs import parser
from tessera.operators.logs import validators as val
from tessera.operators.logs import vocabulary as v

#: What a record says of a line, as (column, key in the parsed form, type).
RECORD = (
    ("format_family", "family", "string"), ("detection_rule", "rule", "string"), ("sub_format", "sub_format", "string"), ("record_validity", "record_validity", "string"),
    ("is_truncated", "truncated", "boolean"), ("event_end_pos", "event_end", "int"), ("diagnostics", "diagnostics", "array<string>"),
)
#: What every field has, and the typed values that some have besides, as (leaf, type).
COMMON = (("value", "string"), ("validity", "string"), ("start_pos", "int"), ("source", "string"), ("missing_reason", "string"))
TYPED = {
    "entity_type": (("code", "string"),), "event_timestamp": (("shape", "string"), ("local", "timestamp_ntz"), ("utc_offset_minutes", "int"), ("utc", "timestamp_ntz")),
    "latitude": (("degrees", "decimal(10,7)"),), "longitude": (("degrees", "decimal(10,7)"),), "ip_address": (("address", "string"), ("zone_id", "string")), "status": (("code", "int"), ("word", "string")),
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "decimal(10,7)": pa.decimal128(10, 7), "array<string>": pa.list_(pa.string())}
_TIMES = {"local": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "utc": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}


def column(field: str, leaf: str) -> str:
    return field if leaf == "value" else f"{field}_{leaf}"


#: (field, leaf, type) of all 61 leaves of the fields, in the order of the columns.
LEAVES = tuple((f, leaf, kind) for f in v.FIELDS for leaf, kind in (*COMMON, *TYPED.get(f, ())))
FLAT = ", ".join(["log_id long", *[f"{name} {kind}" for name, _, kind in RECORD], *[f"{column(f, leaf)} {kind}" for f, leaf, kind in LEAVES]])


def published(logs: DataFrame, run_id: int = 1, id_col: str = "log_id", text_col: str = "raw_log", year: int = 2026) -> DataFrame:
    """log_id, run_id, loaded_at, the record and the fields of every row of logs. Null and empty lines are broken records without a
    value; rows of equal ids are published each."""
    rows = logs.select(F.col(id_col).cast("long").alias("log_id"), F.col(text_col).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [parser.parse(t, year) for t in batch.column(1).to_pylist()]
            each = [[f | {"source": f["slot_id"]} | typed_values(f, year) for f in p["fields"]] for p in lines]
            at = {f: i for i, f in enumerate(v.FIELDS)}
            out = [batch.column(0), *[pa.array([p[key] for p in lines], _ARROW[kind]) for _, key, kind in RECORD]]
            out += [pa.array([fields[at[f]].get(leaf) for fields in each], _ARROW[kind]) for f, leaf, kind in LEAVES]
            yield pa.RecordBatch.from_arrays(out, ["log_id", *[r[0] for r in RECORD], *[column(f, leaf) for f, leaf, _ in LEAVES]])

    return rows.mapInArrow(run, FLAT).select("log_id", F.lit(run_id).cast("long").alias("run_id"), F.current_timestamp().alias("loaded_at"), *[r[0] for r in RECORD], *[column(f, leaf) for f, leaf, _ in LEAVES])


def typed_values(judged: dict, year: int) -> dict:
    """The typed leaves of one judged field."""
    field, value = judged["field"], judged["value"]
    if field == "event_timestamp" and value:
        out = {"shape": val.timestamp_shape(value)}
        if judged["validity"] == "VALID":
            _, local, east = val.timestamp(value, year)
            out |= {"local": local, "utc_offset_minutes": east, "utc": None if east is None else local - datetime.timedelta(minutes=east)}
        return out
    if judged["validity"] != "VALID":
        return {}
    if field == "entity_type":
        return {"code": val.entity_code(value)}
    if field in ("latitude", "longitude"):
        return {"degrees": val.degrees(value, field)}
    if field == "ip_address":
        address, _, zone = value.partition("%")
        return {"address": address, "zone_id": zone or None}
    if field == "status":
        return {"code": int(value[:3])} if value[:3].isdigit() else {"word": value.upper()}
    return {}


def pivoted(fields: DataFrame) -> DataFrame:
    """The 50 common attributes from the long form, where rows of a line may lie anywhere: five aggregates for each of the ten fields."""
    long = fields.withColumnRenamed("slot_id", "source")
    wide = long.groupBy("log_id").pivot("field", list(v.FIELDS)).agg(*[F.max(leaf).alias(leaf) for leaf, _ in COMMON])
    return wide.select("log_id", *[F.col(f"{f}_{leaf}").alias(column(f, leaf)) for f in v.FIELDS for leaf, _ in COMMON])


def imprecise(flat: DataFrame) -> DataFrame:
    """log_id, axis, value of valid coordinates that 7 digits can't hold: more digits after the point, or seconds with more than three.
    Publication is refused unless there is none."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"), F.col(f"{a}_validity").alias("validity")) for a in ("latitude", "longitude")]))
    digits = F.length(F.regexp_extract("c.value", "[.]([0-9]+)", 1))
    return flat.select("log_id", axes.alias("c")).filter((F.col("c.validity") == "VALID") & (digits > F.when(F.col("c.value").contains("°"), 3).otherwise(7))).select("log_id", "c.axis", "c.value")


def documents(flat: DataFrame) -> DataFrame:
    """log_id, doc: the canonical text, keys in the order of the columns, nulls written out."""
    leaf = lambda f, name: (F.date_format(column(f, name), _TIMES[name]) if name in _TIMES else F.col(column(f, name))).alias(name)
    record = F.struct(*[F.col(r[0]) for r in RECORD])
    fields = F.struct(*[F.struct(*[leaf(f, name) for name, _ in (*COMMON, *TYPED.get(f, ()))]).alias(f) for f in v.FIELDS])
    return flat.select("log_id", F.to_json(F.struct("log_id", "run_id", record.alias("record"), fields.alias("fields")), {"ignoreNullFields": "false"}).alias("doc"))


def _paths() -> list[tuple[str, str, str]]:
    """(column, path, type) of all 70 leaves."""
    return [("log_id", "log_id", "bigint"), ("run_id", "run_id", "bigint"), *[(name, f"record.{name}", kind) for name, _, kind in RECORD], *[(column(f, leaf), f"fields.{f}.{leaf}", kind) for f, leaf, kind in LEAVES]]


def _cast(c: Column, path: str, kind: str) -> Column:
    return F.to_timestamp_ntz(c, F.lit(_TIMES[path.rpartition(".")[2]])) if kind == "timestamp_ntz" else c


def leaves(docs: DataFrame) -> DataFrame:
    """All 70 leaves as columns of the types they had: the text is read once, by one schema."""
    kinds = lambda pairs: ", ".join(f"{name}: {'string' if kind == 'timestamp_ntz' else kind}" for name, kind in pairs)
    fields = ", ".join(f"{f}: struct<{kinds((*COMMON, *TYPED.get(f, ())))}>" for f in v.FIELDS)
    schema = f"log_id bigint, run_id bigint, record struct<{kinds((name, kind) for name, _, kind in RECORD)}>, fields struct<{fields}>"
    return docs.select(F.from_json("doc", schema).alias("d")).select(*[_cast(F.col(f"d.{path}"), path, kind).alias(name) for name, path, kind in _paths()])


def variant_leaves(docs: DataFrame) -> DataFrame:
    """The same from the binary form, each leaf by its path."""
    x = docs.select(F.parse_json("doc").alias("d"))
    return x.select(*[_cast(F.try_variant_get("d", f"$.{path}", "string" if kind == "timestamp_ntz" else kind), path, kind).alias(name) for name, path, kind in _paths()])
