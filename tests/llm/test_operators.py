"""Each operator against brute force on hand-made rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, html_text, language_id, mixing, near_dedup, quality_model, quality_rules, registry, sampling, secrets_scan, shingles, toxicity
from tests.oracle import differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, digest string, size string, node string, row string, key string, run string, t string, x string"
WORDS = [f"w{i}" for i in range(40)]


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 4, 5, 6, 30, 80]))) for _ in range(n)]
    for i in range(0, n, 7):  # near copies of the long ones
        w = texts[i].split()
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [texts[0].replace(" ", " \t\n"), texts[1], None, "", " \n ", "Ünïcode ß İ ſ", "a " * 30_000, "y" * 50_000]
    texts += ["password = 'abcdefghijkl' Token:short secret=ABCDEFGHIJKLMNOP api_key: \"0123456789abcdef01\" é AKIA" + "B" * 16, "paſſword=abcdefghijklmnop"]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), 0, 1, "d", "s", "n", "r", "k", "u", "t", "x") for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, "a null id", "en", "a", 0, 1, "d", "s", "n", "r", "k", "u", "t", "x"), (None, None, None, None, 0, 1, "d", "s", "n", "r", "k", "u", "t", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_exact_groups(docs, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows()]
    groups: dict[str, list] = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    want = Counter()
    for t, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == first and left > 0
            left -= kept
            want[(i, first, len(ids), kept, sha(t))] += 1
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    runs = exact_dedup.digest_runs(docs)
    for fan_in in (2, 3):  # more rounds, same result
        assert sorted(r.group_size for r in exact_dedup.merge_runs(runs, 4, fan_in).collect()) == sorted(map(len, groups.values()))
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicate(docs).count() == len(groups)
    assert exact_dedup.deduplicate(docs).columns == docs.columns


def near_brute(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def end(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = end(i), end(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), end(i)) for i in sets}


def test_near_groups(docs, empty):
    want = near_brute({i: t for i, t, *_ in rows() if i is not None})
    got = near_dedup.near_groups(docs).filter("doc_id IS NOT NULL").collect()
    assert len(got) == len([r for r in rows() if r[0] is not None])
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_groups_of_texts_around_one_passage(spark):
    """A passage makes up much of many texts: buckets are full of pairs that aren't links; loose chains still hold together."""
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {}
    for i in range(120):
        texts[i] = passage + " " + " ".join(f"v{r.randrange(10**6)}" for _ in range(r.choice([10, 18, 22, 30])))
    chain = [f"c{i}" for i in range(100)]
    for i in range(120, 150):
        chain[(i * 7) % 100] = f"z{i}"
        texts[i] = " ".join(chain)
    got = near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)).collect()
    want = near_brute(texts)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


def test_sketches_agree_as_often_as_sets():
    import numpy as np

    r = np.random.default_rng(1)
    for n, share in ((4, 0.5), (300, 0.75), (5000, 0.3)):
        same = []
        for _ in range(40):
            k = round(2 * n * share / (1 + share))
            x = r.integers(1 << 63, size=2 * n - k, dtype=np.uint64)
            a, b = shingles.sketch(np.sort(x[:n])), shingles.sketch(np.sort(x[n - k :]))
            same.append((a == b).mean())
        assert abs(np.mean(same) - k / (2 * n - k)) < 0.05


def spans_brute(t: str) -> list[tuple]:
    out = []
    for rank, rule in enumerate(secrets_scan.RULES):
        for m in re.finditer(rule.pattern, t, re.A):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(rule.span), rank, rule.kind, m.end()))
    return sorted(out)


def test_secret_spans(docs, empty):
    want = Counter()
    for i, t, *_ in rows():
        s = spans_brute(t or "")
        line = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, k, b in x)
        want[(i, *[sum(k == x for _, _, x, _ in s) for k in ("assign", "access", "hex")], sha(line([x for x in s if x[1] < 3])), line(s))] += 1
    assert Counter(map(tuple, secrets_scan.scan_documents(docs).collect())) == want
    assert any(k[1] for k in want) and any(k[2] for k in want) and any(k[3] for k in want)
    assert secrets_scan.scan_documents(empty).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    old = spark.createDataFrame([("a@1", "token=abcdefghijklmnop"), ("b@1", "nothing")], "doc_id string, text string")
    new = old.unionByName(spark.createDataFrame([("a@2", "nothing"), ("c@1", "secret: 0123456789abcdef"), ("c@2", "secret: 0123456789abcdef")], "doc_id string, text string"))
    read = lambda: secrets_scan.read_ledger(spark, folder)
    secrets_scan.update(old, folder)
    assert read().count() == 2
    addresses = secrets_scan.update(new, folder)
    assert read().count() == 3  # one blob is new, two paths have it
    found = {r.path: sorted(x.kind for x in r.spans) for r in secrets_scan.findings(addresses, read()).collect()}
    assert found == {"a@1": ["assign"], "b@1": [], "a@2": [], "c@1": ["assign", "hex"], "c@2": ["assign", "hex"]}
    # an edited rule is another version: it alone runs again, and what its old version found no longer counts
    rules = tuple(secrets_scan.Rule("hex", r"[0-9a-f]{20,}", 0, 20, True) if r.kind == "hex" else r for r in secrets_scan.RULES)
    assert secrets_scan.RULES[0].version == rules[0].version and secrets_scan.RULES[2].version != rules[2].version
    addresses, more = secrets_scan.scan(new, read(), rules=rules)
    assert {tuple(r.versions) for r in more.collect()} == {(rules[2].version,)} and more.count() == 3
    addresses = secrets_scan.update(new, folder, rules=rules)
    found = {r.path: sorted(x.kind for x in r.spans) for r in secrets_scan.findings(addresses, read(), rules).collect()}
    assert found["c@1"] == ["assign"] and found["a@1"] == ["assign"]
    assert secrets_scan.scan(new, read(), rules=rules)[1].count() == 0


def library(pattern=None):
    import base64

    import tiktoken

    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern or bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_the_library_and_round_trips(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_CHARS", 3)  # nearly all pieces go through the tree
    c, want = bpe.Codec(bpe.default_ranks(), bpe.default_pattern(), leaf_chars=8, leaf_bytes=4), library()
    r = random.Random(1)
    alphabet = "ab cd'st re\n\n  \t.,!é中文0129 'll've ÀßĀ \U0001f600"
    for k in range(6000):
        few = alphabet if k % 3 else r.choice(["ab", " \n", "a", "0", "-=", "eyJ", "'s t"])
        t = "".join(r.choice(few) for _ in range(r.randint(0, 200)))
        ids = c.encode(t)
        assert ids == want(t) and c.decode(ids) == t.encode()


def test_bpe_with_another_pattern_takes_texts_whole():
    pattern = r"\s*[\r\n]+|\s+(?!\S)|\s+|\p{L}{1,7}|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
    c, want, r = bpe.Codec(bpe.default_ranks(), pattern, leaf_chars=8), library(pattern), random.Random(2)
    for _ in range(500):
        t = "".join(r.choice("ab c\n  12.é") for _ in range(r.randint(0, 200)))
        assert c.encode(t) == want(t)


@pytest.mark.parametrize("unit", [" ", "a", "abc", "\n", "-=", "0123456789", "é"])
def test_bpe_of_long_runs(unit):
    """Texts that the library can't split: the tree must decode them, and encode a shorter run as the library does."""
    c, want = bpe.codec(bpe.default_ranks(), bpe.default_pattern()), library()
    t = unit * (50_000 // len(unit)) + " x"
    assert c.encode(t) == want(t)
    t = unit * (1_000_000 // len(unit)) + " x"
    assert c.decode(c.encode(t)) == t.encode()


def test_bpe_digests(docs, empty):
    encode, want = library(), Counter()
    for i, t, *_ in rows():
        ids = encode(t or "")
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))] += 1
    assert Counter(map(tuple, bpe.digests(docs).collect())) == want
    assert bpe.digests(empty).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs)).filter(F.col("decoded").cast("string") != F.coalesce("text", F.lit("")))
    assert back.count() == 0


def mix_brute(data: list[tuple], block: int) -> dict:
    """taken of each (doc_id, size) by stepping through words."""
    by: dict = {}
    for i, t, _, s, *_ in data:
        by.setdefault("~" if s is None else "s" + s, []).append((hashlib.md5(f"mix:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    sizes = {k: sum(x[2] for x in v) for k, v in by.items()}
    weights = {k: n % 3 + 1 for n, k in enumerate(sorted(by))}
    total, held = sum(sizes.values()), {}
    while True:
        left = total - sum(held.values())
        w = sum(weights[k] for k in by if k not in held)
        over = [k for k in by if k not in held and left * weights[k] / w > 3 * sizes[k]]
        if not over:
            break
        held |= {k: 3 * sizes[k] for k in over}
    targets = {k: held.get(k, left * weights[k] / w if k not in held else 0) for k in by}
    out: Counter = Counter()
    for k, v in by.items():
        stream = [n for n, x in enumerate(sorted(v, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))) for _ in range(x[2])]
        order = sorted(v, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
        taken = Counter()
        goal = int(targets[k] + 0.5)
        if stream:
            for n, c in Counter(stream).items():
                taken[n] = goal // len(stream) * c
            taken.update(stream[: goal % len(stream)])
        for n, x in enumerate(order):
            out[(x[1], x[2], sizes[k], round(targets[k], 6), taken[n])] += 1
    return out


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_mix(docs, empty, block):
    out = mixing.mix(docs, block_words=block).collect()
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out)
    assert got == mix_brute(rows(), block)
    assert all((r.first_slot is None) == (r.taken == 0) for r in out)
    assert mixing.mix(empty).count() == 0


def test_documents_come_in_the_order_of_their_slots(docs, empty):
    """Each document as often as it is taken, rounded; the first copies come in the order of first_slot."""
    got = [r.doc_id for r in mixing.mixed_documents(docs, block_words=64).collect()]
    want: Counter = Counter()
    for (i, size, _, _, taken), n in mix_brute(rows(), 64).items():
        want[i] += n * ((2 * taken + size) // (2 * max(size, 1)))
    assert Counter(got) == +want
    slots = {r.doc_id: r.first_slot for r in mixing.mix(docs, block_words=64).collect() if r.doc_id is not None}
    whole = [i for i in dict.fromkeys(got) if i is not None and got.count(i) > 1]
    assert [slots[i] for i in whole] == sorted(slots[i] for i in whole)
    half = [r.source for r in mixing.mixed_documents(docs, block_words=64).collect()]
    assert len(set(half[: len(half) // 4])) == len(set(half))  # sources are interleaved, not one after another
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_schedule_is_spread_evenly(spark):
    per = mixing.targets(spark.createDataFrame([("sa", 1_000_000), ("sb", 1_000_000), ("sc", 500)], "skey string, source_size long"))
    got = mixing.schedule(per).orderBy("slot").collect()
    goal = {r.skey: r.goal for r in per.collect()}
    assert {k: sum(r.end - r.begin for r in got if r.skey == k) for k in goal} == goal
    half = [r for r in got if r.slot < len(got) // 2]
    for k in ("sa", "sb"):
        n = sum(r.skey == k for r in got)
        assert abs(sum(r.skey == k for r in half) - n / 2) <= 6


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t, *_ in rows():
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        g = got[i]
        assert i is None or (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.kept and g.base_failed)
    assert quality_rules.apply_rules(empty).count() == 0


def test_repeated_windows_are_told_apart_by_words(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(7).cast("long"))  # all hashes clash
    texts = spark.createDataFrame([(1, "a b c d e f a b c g"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.with_statistics(texts).collect()} == {1: 6, 2: 0}


def test_cascade_order_changes_no_verdict(docs):
    stats = quality_rules.with_statistics(docs)
    a = stats.select("doc_id", quality_rules.cascade(list(quality_rules.RULES)).isNull().alias("kept"))
    b = stats.select("doc_id", quality_rules.cascade(list(reversed(quality_rules.RULES))).isNull().alias("kept"))
    assert a.exceptAll(b).count() == 0
    assert sorted(r.name for r in quality_rules.order(stats)) == sorted(r.name for r in quality_rules.RULES)
    share = {r.name: s for r, s, cost in quality_rules.measured(stats) if cost > 0}
    n = stats.count()
    assert share["few_words"] == stats.filter("n_words < 50").count() / n


def test_rules_run_by_rejections_per_cost(docs, monkeypatch):
    cost = {r.name: 1.0 for r in quality_rules.RULES} | {"symbols": 0.01, "few_words": 5.0}
    share = {r.name: 0.0 for r in quality_rules.RULES} | {"symbols": 0.1, "few_words": 0.6, "repeats": 0.3}
    monkeypatch.setattr(quality_rules, "measured", lambda sample, rules: [(r, share[r.name], cost[r.name]) for r in rules])
    assert [r.name for r in quality_rules.order(quality_rules.with_statistics(docs))][:3] == ["symbols", "repeats", "few_words"]


def test_held_out_language_accuracy(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(real)
    got = language_id.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    blank = next(i for i, t, *_ in rows() if t == "")
    assert odd[blank].lang_pred == "und" and odd[blank].score == 0
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    import corpus_pipeline

    r = random.Random(2)
    data = []
    for k in range(40):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(60)]
        data += [(100 * k + i, " ".join(r.choice(words) for _ in range(40)), f"l{k}") for i in range(8 + k)]
    data += [(9000 + i, " 12 ", "blank") for i in range(3)]
    many = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.identify(many, language_id.train(many)).collect()}
    assert all(got[i].lang_pred == v for i, _, v in data if v != "blank")
    assert {x.doc_id for x in corpus_pipeline.keep_languages(spark, many, "").collect()} == {i for i, _, v in data if v != "blank"}
    few = sampling.stratified(many, "doc_id", "lang", "text", 400, 10).groupBy("lang").count().collect()
    assert {x.lang for x in few} == {v for _, _, v in data}


def test_language_scores_do_not_sink_with_more_languages():
    import numpy as np

    model = language_id.Model([str(i) for i in range(3000)], np.ones((1, language_id.SPECTRUM), np.float32), np.vstack([np.zeros((1, 3000)), [[0.5] + [-1.0] * 2999]]).astype(np.float32))
    assert model.predict(["some text"])[1][0] > 0.9


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality_model, "quality")])
def test_held_out_classifiers(spark, docs, empty, module, column):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(real, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[column] for r in got) / len(got) > 0.88
    assert all(0 <= r.score <= 1 for r in got)
    none = labels.filter("false")
    for d in (docs, empty):
        assert module.classify(d, none).count() == d.count()
    assert module.classify(empty, labels).count() == 0
    assert module.classify(docs.filter("doc_id > 20"), labels.filter("doc_id <= 20")).count() == docs.filter("doc_id > 20").count()
    assert module.classify(docs, spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")).count() == docs.count()


def test_statistics_do_not_depend_on_neighbours():
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()] + ["extraordinarily long words uninterruptedly", "incomprehensible", "short one"]
    each = np.concatenate([quality_model.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(quality_model.statistics(pa.array(texts, pa.string())), each)
    spread = [[len(w.encode()) > 12 for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    assert np.allclose(each[:, quality_model.NAMES.index("word_spread")], [(sum(v) / max(len(v), 1)) ** 0.5 for v in spread])


@pytest.mark.parametrize("text", ["1d10t", "i d i o t", "idiooot", "cl0wn", "s.c.u.m", "m0r0n", "idi07", "i  d - i  o / t", "s/c/u/m", "s c u m", "idi0t!", "m0r0n,"])
def test_restored_words(spark, text):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = test_restored_words.__dict__.setdefault("model", None) or toxicity.Restorer(toxicity.language_model(real))
    test_restored_words.model = r
    assert r.restore(f"You are {text} today").split()[2].strip(",!") in ("idiot", "clown", "scum", "moron")


def test_plain_texts_keep_their_words(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = toxicity.Restorer(toxicity.language_model(real))
    for t in ("He said: no! (See page 12.) It cost 5 euros, or 10$ at most.", "A b and C", "end.\nNew line - and more", ""):
        assert toxicity.words_of(t, r) == set(re.findall(r"[^\W\d_]+", t.lower()))


def viterbi_brute(cost, s: str) -> float:
    """The least cost of any reading of s, by trying all."""
    import itertools

    best = 1e300
    options = []
    for ch in s + " ":
        if ch.isalpha():
            options.append([(ch, 0.0)])
        elif ch in toxicity.LEET:
            options.append([(v, toxicity.COST_SWAP) for v in toxicity.LEET[ch]] + [(" ", toxicity.COST_BREAK if ch not in "!*|+(" else 1.0)])
        else:
            options.append([(" ", 0.0), ("", toxicity.COST_DROP)])
    for reading in itertools.product(*options):
        for said in itertools.product((True, False), repeat=len(reading)):
            a, b, last, total, ok = 0, 0, "", 0.0, True
            for k, ((out, extra), aloud) in enumerate(zip(reading, said, strict=True)):
                run = any(len({*s[j : j + 3]}) == 1 and len(s[j : j + 3]) == 3 for j in range(max(k - 2, 0), k + 1))
                if out == "" or out == " " and b == 0:
                    ok, total = ok and aloud, total + extra
                elif aloud:
                    v = toxicity.symbol(out)
                    total += extra + cost[a][b][v]
                    a, b, last = b, v, out
                else:  # the same letter again, unsaid
                    ok = ok and out == last and toxicity.symbol(out) > 0 and run
                    total += extra + toxicity.COST_REPEAT
            if ok:
                best = min(best, total)
    return best


@pytest.mark.parametrize("s", ["1d10", "a$$", "heee", "l|+", "4|l", "t00", "@bb", "0", "x!y"])
def test_viterbi_finds_the_cheapest_reading(s):
    import numpy as np

    model = -np.log(np.random.default_rng(4).dirichlet(np.ones(toxicity.SYMBOLS), size=(toxicity.SYMBOLS, toxicity.SYMBOLS)))
    r = toxicity.Restorer(model)
    assert abs(r.cheapest(s)[0] - viterbi_brute(model.tolist(), s)) < 1e-9


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><a href="/">Home</a> Site</header>
<nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>gone</p> --><article><h1>The &amp;amp; title</h1><p>The first of the paragraphs is
 here&nbsp;and it is long enough for a decision by itself, as that is what the rule asks of it.<br><p>Short one.</p><div class="ad">Buy the thing now</div>
<form><input><button>Send</button></form><p>The last of the words in the article are these and they end the text that was here for you.</p>
<section class="comments"><p>I am a reader and this is what I have to say about the article, and it is long too.</p></section></article>
<aside>The side of the page is not it and was never in the text of the article that you read here.</aside><footer>&copy; x</footer>"""


def test_main_text(spark):
    want = "The &amp; title The first of the paragraphs is here and it is long enough for a decision by itself, as that is what the rule asks of it. Short one. The last of the words in the article are these and they end the text that was here for you."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (4, "w", "< a <b"), (5, "z", "<p>" * 3000)], "page_id long, url string, html string")
    got = html_text.extract(pages).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and len(got) == 6
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.filter("false")).count() == 0


def test_main_text_without_an_article():
    long = "This is the text of the page and it has all of the words that a reader would want from it, as it was written for them. " * 3
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{long}</p><p>Brief but in it.</p><p>{long}</p></div><div><a href=3>Imprint</a></div></body>"
    assert html_text.main_text(page) == " ".join(f"{long} Brief but in it. {long}".split())


def test_main_text_beside_an_article_of_teasers():
    long = "This is the text of the page and it has all of the words that a reader would want from it, as it was written for them. " * 3
    card = "<article><a href=1>Other story</a><p>A teaser for a story that is on the site and that you may want to read next.</p></article>"
    page = f"<body><div><p>{long}</p><p>Brief but in it.</p><p>{long}</p></div><div>{card * 3}</div></body>"
    assert html_text.main_text(page) == " ".join(f"{long} Brief but in it. {long}".split())


def test_main_text_leaves_out_dull_blocks_of_an_article():
    long = "This is the text of the page and it has all of the words that a reader would want from it, as it was written for them. " * 3
    dull = "Laptops Tablets Phones Cameras Printers Monitors Keyboards Cables Batteries Chargers Speakers Headphones " * 4
    assert html_text.main_text(f"<article><p>{long}</p><p>{dull}</p><p>{long}</p></article>") == " ".join(f"{long} {long}".split())
    other = "Kissa istui ikkunalla ja katseli lintuja koko aamun, kunnes aurinko nousi korkealle talojen yläpuolelle. " * 3
    assert html_text.main_text(f"<article><p>{other}</p></article>") == other.strip()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    assert differences(registry.queries()[name](spark, sf), sf, registry.oracle_sql()[name]) == ""
