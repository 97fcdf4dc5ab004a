"""The two ways to the binary form of a document."""

from pyspark.sql import functions as F

from tessera.plans import documents_json as dj

PATHS = {
    "id": "bigint", "record.validity": "string", "record.family": "string", "record.diagnostics": "array<string>", "fields.status.code": "int", "fields.status.word": "string",
    "fields.email.value": "string", "fields.latitude.degrees": "double", "fields.priority.value": "string",
}


def test_variants_hold_what_parsing_the_text_gives(spark, sf):
    """Value by value; numbers with a fraction are decimals in one and doubles in the other, which their text shows."""
    leaves = [F.try_variant_get("v", f"$.{path}", kind).alias(path.replace(".", "_")) for path, kind in PATHS.items()]
    parsed = dj.documents(spark, sf).select(F.parse_json("doc").alias("v")).select(*leaves)
    made = dj.variants(spark, sf).select(*leaves)
    assert parsed.count() > 0 and parsed.exceptAll(made).count() == 0 and made.exceptAll(parsed).count() == 0
