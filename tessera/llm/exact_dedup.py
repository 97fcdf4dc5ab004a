"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition gives a run: entries (digest, smallest identifier, count) in the order of the digests, one for each of its
texts. In every round FAN_IN neighbouring runs become one. A round is two sort aggregates: the first sorts what a task holds and
leaves one entry for each text and run, the exchange deals entries by digest, and the second merges what came from all runs of the
block in the order of the digests, keeping the smallest identifier and the sum of the counts. After log_FAN_IN(runs) rounds one run
is left. The copies of one text, however many, cross an exchange only as one entry from each run.

At every level an identifier is kept only if it is verified: entries are of one text if the SHA-256, an independent 64-bit hash and
the length all agree, and an entry that agrees in the digest alone stays a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, join_hot, scratch, thinned, whole

FAN_IN = 16
KEY = ["digest", "witness", "n_octets"]


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole(text), SPACES, " ")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: run (the partition that read it), row (unique), doc_id and the verified key of its text."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    return text.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("witness"), F.octet_length("t").alias("n_octets"),
    )


def merge_runs(runs: DataFrame, last_run: int, fan_in: int = FAN_IN) -> DataFrame:
    """The rounds. Returns a row per text: its key, keep_id, keep_row and group_size. The least of a struct makes Spark sort, not hash."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    level, block = runs.withColumn("first", first).withColumn("n", F.lit(1).cast("long")), 1
    while True:
        block *= fan_in
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = level.groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        if block > last_run:
            break
    return level.select(*KEY, F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Null texts count as empty; texts equal after white-space folding are one group. The row with the smallest doc_id stays; a
    null doc_id counts as largest; of rows that agree in doc_id and text exactly one stays. Columns other than the two named are
    not read, so their names can't clash. An empty table gives an empty result.
    """
    runs = scratch(digest_runs(docs, id_col, text_col), "digest-runs")
    rows, last_run = runs.agg(F.count("*"), F.coalesce(F.max("run"), F.lit(0))).first()
    kept = scratch(merge_runs(runs, last_run), "digest-merged")
    joined = join_hot(runs, kept, KEY, "group_size", rows)
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were: the one with the smallest doc_id, a null one counting
    as largest.

    Null texts count as empty. Of rows that agree in doc_id and text the same one stays in every run. No column name can clash. An
    empty table gives an empty result.
    """
    odd = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    odd = odd.filter("n > 1 OR NOT stays").select("doc_id", F.unhex("text_sha256").alias("sha"), "stays")
    return thinned(docs, [F.col(id_col), F.unhex(F.sha2(normalised(text_col), 256))], scratch(odd, "exact-odd"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
