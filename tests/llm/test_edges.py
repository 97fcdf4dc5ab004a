"""What operators and stages do with texts made to break them, repeated and missing ids, clashing names and empty tables."""

from __future__ import annotations

import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, html_text, language_id, mixing, near_dedup, quality_model, quality_rules, sampling, secrets_scan, shingles, toxicity

MB = 1 << 18  # a quarter, so that the suite stays short; secrets and byte pairs have tests with 1 MB
LONG = {
    "spaces": " " * MB, "letters": "x" * MB, "feeds": "\n" * MB, "keys": "-----BEGIN " + "A " * (MB // 2), "tokens": "eyJ" * (MB // 3), "dashed": "eyJ-" * (MB // 4),
    "dots": "eyJaaaaaaaaa." * (MB // 13), "words": "password " * (MB // 9), "leet": "a$" * (MB // 2), "spaced": "a b " * (MB // 4), "symbols": "#$%&" * (MB // 4),
}


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(LONG.values())], "doc_id long, text string, lang string, source string").repartition(4).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids with the same and with other texts, empty texts, and columns with names that operators use."""
    base = "the quick brown fox jumps over the lazy dog and runs away from it all as fast as it can go on its four feet "
    texts = [(1, base * 3), (1, base * 3), (1, base * 3 + "now"), (2, base * 3), (None, base * 3), (None, base * 3), (None, "another text that has nothing to do with it"), (3, None), (3, None), (4, ""), (5, "\x0b \t"), (6, "Noch ein Text, der hier steht")]
    names = "doc_id long, text string, lang string, source string, n_chars long, _keep string, _sha_own string, _copies long, _key0 string, _table0 string, tx long, stays boolean, place string, slot long, skey string, digest string, kept boolean, node long, run long, t string, words string"
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "a" if i else None, 0, "k", "s", 9, "k", "t", 7, False, "p", 1, "s", "d", False, 1, 2, "t", "w") for i, t in texts], names).repartition(3).cache()


QUERIES = {
    "exact": exact_dedup.exact_groups, "near": near_dedup.near_groups, "secrets": secrets_scan.scan_documents, "bpe": bpe.digests, "mix": mixing.mix, "rules": quality_rules.apply_rules,
    "language": lambda d: language_id.identify(d, language_id.train(d)), "toxic": lambda d: toxicity.classify(d, _labels(d)), "quality": lambda d: quality_model.classify(d, _labels(d)),
}


def _labels(d):
    return d.sparkSession.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", QUERIES)
def test_long_texts_and_odd_rows(long, odd, name):
    began = time.time()
    assert QUERIES[name](long).count() == len(LONG)
    assert time.time() - began < 120
    assert QUERIES[name](odd).count() == odd.count()
    assert QUERIES[name](odd.filter("false")).count() == 0


def test_secrets_in_a_megabyte(spark):
    texts = ["-----BEGIN " + "A " * 500_000, "eyJ" * 350_000, "eyJ-" * 250_000, "password " * 110_000, "eyJaaaaaaaaa." * 80_000]
    began = time.time()
    got = secrets_scan.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 5 and time.time() - began < 60


def test_queries_leave_extra_columns_alone(odd):
    plain = odd.select("doc_id", "text", "lang", "source")
    for name in ("exact", "near", "secrets", "bpe", "mix", "rules"):
        a, b = QUERIES[name](odd), QUERIES[name](plain)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name


@pytest.mark.parametrize("few", [common.FEW_ROWS, 0])
def test_stages_on_odd_rows(spark, odd, few, monkeypatch):
    """Once with broadcasts, once with shuffles only."""
    for module in (common, near_dedup, secrets_scan, mixing):
        monkeypatch.setattr(module, "FEW_ROWS", few)
    exact = corpus_pipeline.drop_copies(spark, odd, "")
    assert exact.columns == odd.columns
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in exact.collect())
    assert [(n, i) for n, i, _ in texts] == [(False, 1), (False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]
    near = corpus_pipeline.drop_near_copies(spark, odd, "")
    assert near.columns == odd.columns
    got = sorted(((r.doc_id if r.doc_id is not None else 99), (r.text or "").strip()[:7]) for r in near.collect())
    assert got == [(1, "the qui"), (3, ""), (3, ""), (4, ""), (5, ""), (6, "Noch ei"), (99, "another")]
    mixed = corpus_pipeline.mix_sources(spark, odd, "")
    assert mixed.columns == odd.columns and mixed.filter("text IS NULL OR trim(text) = ''").count() == 0
    sizes = odd.select("source", common.word_count(common.whole("text")).alias("n")).groupBy("source").agg(F.sum("n")).collect()
    assert all(v > 0 for _, v in sizes)
    kept = corpus_pipeline.keep_languages(spark, odd, "")
    assert kept.columns == odd.columns and kept.filter("text IS NULL OR text = ''").count() == 0
    coded = corpus_pipeline.tokenise(spark, odd, "")
    assert coded.count() == odd.count() and coded.filter("text_sha256 IS NULL").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.filter("false"), "").count() == 0


def test_near_groups_agree_however_they_are_joined(spark, monkeypatch):
    """Passages in crowds of texts: by small buckets or by shingles, by broadcasts or by shuffles, in one block or in many."""
    import random

    from tests.llm.test_operators import near_brute

    r = random.Random(8)
    texts = {}
    for p in range(3):
        passage = " ".join(f"p{p}x{i}" for i in range(60))
        for i in range(60):
            own = r.choice([8, 14, 20, 24])
            texts[100 * p + i] = passage + " " + " ".join(f"v{r.randrange(10 ** r.choice([2, 6]))}" for _ in range(own))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5).cache()
    want = near_brute(texts)
    for small, few, block in ((32, common.FEW_ROWS, 1024), (1, common.FEW_ROWS, 4), (1, 0, 3)):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
        for module in (common, near_dedup):
            monkeypatch.setattr(module, "FEW_ROWS", few)
        got = near_dedup.near_groups(docs).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want, (small, few, block)


def test_a_repeated_text_fills_no_sample(spark):
    rows = spark.createDataFrame([(None, "one text", "en")] * 500 + [(i, f"text {i}", "en") for i in range(500)], "doc_id long, text string, lang string")
    assert sampling.stratified(rows, "doc_id", "lang", "text", 400, 12_800).filter("text = 'one text'").count() <= 1


def test_html_of_any_depth():
    began = time.time()
    assert html_text.main_text("<div>" * 50_000 + "x") == html_text.main_text("<div>x")
    html_text.main_text("<p>x</p></div>" * 50_000)
    html_text.main_text("<div class='ad'>" * 50_000 + "</div>" * 50_000)
    assert time.time() - began < 10


def test_a_header_within_an_article_stays():
    long = "This is the text of the page and it has all of the words that a reader would want from it, as it was written for them. " * 3
    page = f'<header class="site-header"><p>{long}</p></header><article><div class="entry-header"><h1>The title</h1></div><p>{long}</p></article>'
    assert html_text.main_text(page) == f"The title {long}".strip()


def test_hashes_of_long_texts_need_no_neighbours(monkeypatch):
    """Words and sets are the same whatever the block; a word may be longer than one."""
    texts = ["a" * 500 + " b " + "ab cd " * 300, "x", "", "y" * 1000]
    whole = [x.tolist() for x in shingles.sets_of(pa.array(texts))]
    stats = quality_model.statistics(pa.array(texts))
    monkeypatch.setattr(shingles, "BLOCK", 64)
    monkeypatch.setattr(shingles, "_tables", [])
    assert [x.tolist() for x in shingles.sets_of(pa.array(texts))] == whole
    assert np.array_equal(quality_model.statistics(pa.array(texts)), stats)


def test_spectra_go_piece_by_piece(monkeypatch):
    text = "Ein Text, der -- mit Lücken --------------- weitergeht und weitergeht. 12 34 " * 5
    want = language_id.places(text)
    for piece in (1, 3, 7, 50):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert np.array_equal(language_id.places(text), want)
    assert not len(language_id.places("12 --"))


def test_kernel_ridge_is_what_its_formula_says():
    """Scores against the plain dual solution: with all texts as landmarks, kernels and weights in one formula."""
    r = np.random.default_rng(3)
    bits = np.packbits(r.random((30, language_id.SPECTRUM)) < 0.02, axis=1)
    labels = np.array(["a", "b", "c"] * 10, dtype=object)
    languages, z, w = language_id.fit(bits, labels, marks=30, ridge=0.5)
    x = np.unpackbits(bits, axis=1).astype(float)
    sizes = np.sqrt(x.sum(axis=1))
    k = x @ x.T / sizes[:, None] / sizes[None, :]
    # features of the landmarks, then ridge regression with equal weight for each language and a free constant
    order = [i for n in range(10) for i in (n * 3, n * 3 + 1, n * 3 + 2)]
    s, u = np.linalg.eigh(k[np.ix_(order, order)])
    g = np.hstack([k[:, order] @ u[:, s > 1e-6 * s.max()] / np.sqrt(s[s > 1e-6 * s.max()]), np.ones((30, 1))])
    y = np.where(labels[:, None] == np.array(languages, dtype=object), 1.0, -1.0)
    reg = np.diag([0.5] * (g.shape[1] - 1) + [1e-9])
    want = g @ np.linalg.solve(g.T @ g / 10 + reg, g.T @ y / 10)
    got = (x / sizes[:, None]) @ z.T @ w[:-1] + w[-1]
    assert np.allclose(got, want, atol=1e-3)


def test_discriminant_is_what_its_formula_says():
    r = np.random.default_rng(5)
    d = len(quality_model.NAMES)
    x, y = np.vstack([r.normal(0, 1, (200, d)), r.normal(0.5, 2, (100, d))]), np.repeat([0, 1], [200, 100])
    moments = {v: np.hstack([np.ones(((y == v).sum(), 1)), x[y == v]]).T @ np.hstack([np.ones(((y == v).sum(), 1)), x[y == v]]) for v in (0, 1)}
    spread = np.diag(np.var(x, axis=0).clip(quality_model.FLOOR))
    logs = []
    for v in (0, 1):
        own = x[y == v]
        few = min(1.0, quality_model.SHRINK_OWN + d / len(own))
        s = np.cov(own.T)
        s = (1 - few) * s + few * np.diag(np.diag(s))
        s = (1 - quality_model.SHRINK_ALL) * s + quality_model.SHRINK_ALL * spread
        away = x - own.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away) + np.linalg.slogdet(s)[1]) + np.log(len(own) / len(x)))
    want = 1 / (1 + np.exp((logs[0] - logs[1]) / quality_model.TEMPERATURE))
    assert np.allclose(quality_model.Model(moments).scores(x), want, atol=1e-6)
