"""The training-data pipeline: documents to a deduplicated, mixed and tokenised corpus, stage by stage.

A stage takes the documents that the one before it kept and works on all of them; none reads another table. Extra columns pass through
unchanged whatever their names, a null or repeated doc_id is a value like any other, null texts count as empty, texts of any length are
taken whole, and an empty table gives an empty result.

SQL can't express the first stage (a fitted model), so there is no ORACLE_SQL; tests/llm holds the pipeline against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tessera.llm.common import scratch

ORACLE_SQL = None
#: Below this score no language is taken to be recognised; texts without a letter have score 0.
LEAST_LANGUAGE_SCORE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a learnt language. Null and empty texts and those without a letter go; repeated rows share one fate; a table
    without any lang to learn from keeps nothing."""
    return language_id.accepted(docs, language_id.train(docs), least=LEAST_LANGUAGE_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id; a null one counts as largest, null and empty texts
    are one group, and of rows that agree in id and text the same one stays in every run."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest doc_id; texts without a word are in no group and stay."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded, in the order of the slots that read it. Texts without a word go, and so do
    documents that the mix takes less than half of; a null source is a source."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and text_sha256, the digest of what the ids decode to; a row for each row. Other
    columns end here."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), digest_col="text_sha256").drop("text")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "text_sha256")


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
