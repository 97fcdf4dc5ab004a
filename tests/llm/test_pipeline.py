"""The whole pipeline against plain Python; only the language scores are taken from the fitted model."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tessera.llm import bpe, language_id
from tests.llm.test_operators import mix_brute, near_brute, sha


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = language_id.identify(docs, language_id.train(docs)).collect()
    stay = {r.doc_id for r in scores if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    first: dict[str, int] = {}
    for i in sorted(stay):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    near = near_brute({i: rows[i].text for i in first.values()})
    kept = [i for i, (_, component) in near.items() if component == i]
    c, want = bpe.codec(bpe.default_ranks(), bpe.default_pattern()), Counter()
    for (i, size, _, _, taken), n in mix_brute([(i, rows[i].text, None, rows[i].source) for i in kept], 1024).items():
        ids = c.encode(rows[i].text)
        want[(i, len(ids), sha(rows[i].text))] += n * ((2 * taken + size) // (2 * max(size, 1)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens, r.text_sha256) for r in got) == +want
    assert all(r.token_ids == c.encode(rows[r.doc_id].text) for r in got)


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_an_empty_table_passes_through(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
