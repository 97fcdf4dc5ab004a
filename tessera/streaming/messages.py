"""From raw messages (key, value, topic, partition, offset, timestamp) to records, or to a reason why not. All in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema that a broker source has; a file source with it stands in where no broker is.
SOURCE_SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
#: The columns that belong to the loader, and the longest column name.
METADATA = ("_KAFKA_TOPIC", "_KAFKA_PARTITION", "_KAFKA_OFFSET", "_KAFKA_TIMESTAMP", "_INGESTED_AT")
LONGEST_NAME = 255
_NOT_A_NUMBER = r'(?<=[\[:,\s])-?(?:NaN|Infinity)(?=[\s,\]}])'


def column_name(name: Column) -> Column:
    """Upper case, other characters than A-Z, 0-9 and _ as _, and a _ before a leading digit."""
    plain = F.regexp_replace(F.upper(name), "[^A-Z0-9_]", "_")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def _outside_strings(text: Column) -> Column:
    return F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')


def parsed(raw: DataFrame) -> DataFrame:
    """Adds text, fields (map of column name to JSON value as text) and reject_reason (null if the message is good)."""
    text = F.when(F.call_function("is_valid_utf8", F.col("value").cast("string")), F.col("value").cast("string"))
    out = raw.withColumn("text", text).withColumn("_v", F.try_parse_json("text"))
    keys = F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.json_object_keys("text"))
    out = out.withColumn("_keys", keys).withColumn("_names", F.transform("_keys", column_name))
    reason = (
        F.when(F.col("value").isNull(), "message has no value")
        .when(F.col("text").isNull(), "message is not valid UTF-8")
        .when(_outside_strings(F.col("text")).rlike(_NOT_A_NUMBER), "message contains a number that JSON has not")
        .when(F.col("_v").isNull(), "message is not valid JSON")
        .when(F.col("_keys").isNull(), "message is not a JSON object")
        .when(F.array_contains("_keys", ""), "field name is empty")
        .when(F.exists("_names", lambda n: F.char_length(n) > LONGEST_NAME), "field name is too long")
        .when(F.arrays_overlap("_names", F.array(*map(F.lit, METADATA))), "field clashes with a metadata column")
        .when(F.size(F.array_distinct("_names")) < F.size("_names"), "several fields map to one column")
    )
    # from_json keeps nested values as their JSON text; a JSON null is no value
    values = F.from_json("text", "map<string,string>")
    fields = F.map_filter(F.transform_keys(values, lambda k, _: column_name(k)), lambda _, v: v.isNotNull())
    return out.withColumn("reject_reason", reason).withColumn("fields", F.when(F.col("reject_reason").isNull(), fields)).drop("_v", "_keys", "_names")


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def with_metadata(messages: DataFrame, ingested_at: Column) -> DataFrame:
    return messages.select(
        F.col("topic").alias("_KAFKA_TOPIC"), F.col("partition").alias("_KAFKA_PARTITION"), F.col("offset").alias("_KAFKA_OFFSET"),
        utc_text(F.col("timestamp")).alias("_KAFKA_TIMESTAMP"), utc_text(ingested_at).alias("_INGESTED_AT"), "fields", "reject_reason", "key", "value",
    )
