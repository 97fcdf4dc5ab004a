"""Change events (before, after, op, source) to order events: forward inserted rows, skip other changes, reject what isn't one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that carry no new row, the table that is followed, columns by kind.
SKIPPED = {"r": "snapshot row", "u": "update", "d": "delete", "t": "truncate", "m": "logical message"}
TABLE = "order_events"
TECHNICAL = ("id", "record_source", "created_at")
BACKFILL = "backfill"
NUMERIC, INTEGER, NESTED = ("unit_price", "discount_pct"), ("customer_id", "quantity"), ("shipping_address",)
REQUIRED = ("event_id", "event_time", "order_id")
_UUID = r"^\{?(?:urn:uuid:)?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"
_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})$"


def utc_millis_text(c: Column) -> Column:
    """ISO-8601 text of any zone as UTC with milliseconds, cut not rounded; null if it is none."""
    c = F.trim(c)
    part = lambda i: F.regexp_extract(c, _ISO, i)
    base = F.try_to_timestamp(F.concat_ws(" ", part(1), part(2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = part(4)
    sign = F.when(F.substring(zone, 1, 1) == "-", 1).otherwise(-1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    shift = F.when(zone == "Z", F.lit(0)).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    moment = F.timestamp_micros(F.unix_micros(base) + shift.cast("long") * 60_000_000)
    text = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.rpad(F.substring(part(3), 1, 3), 3, "0"), F.lit("Z"))
    return F.when(c.rlike(_ISO), text)


def uuid_text(c: Column) -> Column:
    hexes = F.lower(F.regexp_replace(F.regexp_replace(c, "urn:uuid:", ""), "[{}-]", ""))
    cuts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(c.rlike(_UUID), F.concat_ws("-", *cuts))


def classified(raw: DataFrame, table: str = TABLE) -> DataFrame:
    """value -> action (forward, skip, reject), reason, event_key, event (JSON text without null fields) beside raw's columns."""
    text = F.when(F.call_function("is_valid_utf8", F.col("value").cast("string")), F.col("value").cast("string"))
    d = raw.withColumn("_text", text).withColumn("_v", F.try_parse_json("_text"))
    wrapped = F.get_json_object("_text", "$.schema").isNotNull() & F.get_json_object("_text", "$.payload").isNotNull()
    d = d.withColumn("_m", F.when(wrapped, F.get_json_object("_text", "$.payload")).otherwise(F.col("_text")))
    d = d.withColumn("_op", F.get_json_object("_m", "$.op")).withColumn("_table", F.get_json_object("_m", "$.source.table")).withColumn("_after", F.get_json_object("_m", "$.after"))
    d = d.withColumn("_row", F.map_filter(F.from_json("_after", "map<string,string>"), lambda k, v: v.isNotNull() & ~k.isin(*TECHNICAL)))
    d = d.withColumn("_source", F.get_json_object("_after", "$.record_source"))
    kind = lambda c: F.schema_of_variant(F.try_variant_get(F.try_parse_json("_after"), f"$.{c}", "variant"))
    got = lambda c: F.col("_row")[c]
    bad = [F.when(got("event_id").isNotNull() & uuid_text(got("event_id")).isNull(), "event_id is not a UUID"), F.when(got("event_time").isNotNull() & utc_millis_text(got("event_time")).isNull(), "event_time is not a time with a zone")]
    bad += [F.when(got(c).isNotNull() & ((kind(c) == "BOOLEAN") | got(c).try_cast("double").isNull()), f"{c} is not a number") for c in NUMERIC]
    bad += [F.when(got(c).isNotNull() & (~kind(c).isin("BIGINT") | got(c).try_cast("bigint").isNull()), f"{c} is not a whole number") for c in INTEGER]
    bad += [F.when(got(c).isNotNull() & F.try_parse_json(got(c)).isNull(), f"{c} is not JSON") for c in NESTED]
    bad += [F.when(got(c).isNull(), f"row has no {c}") for c in REQUIRED]
    bad += [F.when(~kind("order_id").startswith("STRING") | (got("order_id") == ""), "order_id is not text")]
    skip = F.when(F.col("value").isNull(), "tombstone")
    is_event = F.col("_op").isNotNull()
    for op, why in SKIPPED.items():
        skip = skip.when(F.col("_op") == op, why)
    skip = skip.when(is_event & F.col("_table").isNotNull() & (F.col("_table") != table), "another table").when((F.col("_op") == "c") & (F.col("_source") == BACKFILL), "backfill row")
    reject = (
        F.when(F.col("_text").isNull(), "not valid UTF-8").when(F.col("_v").isNull(), "not valid JSON").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not a JSON object")
        .when(~is_event, "no op field").when(F.col("_op") != "c", "unknown operation").when(F.coalesce(~F.schema_of_variant(F.try_parse_json("_after")).startswith("OBJECT"), F.lit(True)), "insert without a row")
        .otherwise(F.coalesce(*bad))
    )
    d = d.withColumn("_skip", skip).withColumn("_reject", F.when(F.col("_skip").isNull(), reject))
    quoted = lambda v: F.to_json(F.array(v))
    plain = lambda v: F.regexp_replace(quoted(v), r"(?s)^\[|\]$", "")
    rendered = F.transform(
        F.map_entries("_row"),
        lambda e: F.concat(
            plain(e["key"]), F.lit(":"),
            F.when(e["key"] == "event_id", plain(uuid_text(e["value"]))).when(e["key"] == "event_time", plain(utc_millis_text(e["value"])))
            .when(e["key"].isin(*NUMERIC), e["value"].try_cast("double").cast("string")).when(e["key"].isin(*INTEGER, *NESTED), e["value"])
            .when(e["value"].isin("true", "false") | e["value"].rlike(r"^-?[0-9]+(\.[0-9]+)?$") | e["value"].rlike(r"(?s)^[\[{].*[\]}]$"), F.when(F.col("_after").contains(F.concat(plain(e["key"]), F.lit(":"), plain(e["value"]))), plain(e["value"])).otherwise(e["value"]))
            .otherwise(plain(e["value"])),
        ),
    )
    event = F.concat(F.lit("{"), F.array_join(rendered, ","), F.lit("}"))
    action = F.when(F.col("_skip").isNotNull(), "skip").when(F.col("_reject").isNotNull(), "reject").otherwise("forward")
    return d.select(*raw.columns, action.alias("action"), F.coalesce("_skip", "_reject").alias("reason"), F.when(action == "forward", got("order_id")).alias("event_key"), F.when(action == "forward", event).alias("event"))
