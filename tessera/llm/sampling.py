"""Which rows may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch

#: Hash values that a share is measured in.
FINE = 1_000_000


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of doc_id as text modulo parts; that of the empty text for a null."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def stratified(rows: DataFrame, id_col: str, stratum: str, text_col: str, per_stratum: int, most_rows: int) -> DataFrame:
    """About per_stratum rows of each stratum, the same ones in every run: those stay whose hash of id and text lies under per_stratum / the
    stratum's rows, and one row in any case. With more than most_rows / per_stratum strata the share of each shrinks. A text counts
    once for each stratum, however many rows and ids have it: copies can't make the sample larger than their stratum."""
    one = F.xxhash64(F.lit("one"), F.col(id_col), F.col(text_col))
    sizes = scratch(rows.groupBy(stratum).agg(F.count("*").alias("_size"), F.min(one).alias("_one")), "strata")
    each = F.lit(max(1, min(per_stratum, most_rows // max(sizes.count(), 1))))
    picked = rows.join(F.broadcast(sizes), stratum)
    low = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(FINE)) < F.lit(FINE) * each / F.col("_size")
    chosen = picked.filter(low | (one == F.col("_one"))).drop("_size", "_one")
    return chosen.withColumn("_text", F.xxhash64(text_col)).dropDuplicates([stratum, "_text"]).drop("_text")
