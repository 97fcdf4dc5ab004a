"""Quality rules as a short-circuit cascade.

Each rule is a predicate over document statistics that rejects; the base rules are rules like any other. On a random sample the share
that each rule rejects is counted and what it costs is timed; rules then run in order of rejections per cost, and a document that one
rejects reaches none after it. The order changes what is computed, never the verdict, which is the same for every order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, SPACES, discard, scratch, whole

SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample, about, and how often a rule is timed on it.
SAMPLE_ROWS, TIMES = 2000, 2
FINE = 1_000_000


@dataclass(frozen=True)
class Rule:
    """reject: SQL over the statistics and the text `t`, null-free."""

    name: str
    reject: str


BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: The two base rules, then what the method adds; the thresholds are far from what prose has.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("long_words", "word_chars > 18 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("same_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("few_letters", r"2 * regexp_count(t, '[^\\x20\\x09-\\x0D\\p{L}]') > word_chars"),
    Rule("shouting", r"2 * regexp_count(t, '\\p{Lu}') > word_chars"),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _same_words(words: Column, i: Column, j: Column) -> Column:
    return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))


def _covered(windows: Column) -> Column:
    """Words in the windows that start at the given places: each window adds three, less what the one before it has already."""
    steps = lambda w: F.zip_with(F.slice(w, 2, F.size(w) - 1), F.slice(w, 1, F.size(w) - 1), lambda b, a: F.least(F.lit(3), b - a))
    return _let(F.array_sort(F.array_distinct(windows)), lambda w: F.when(F.size(w) == 0, 0).otherwise(F.aggregate(steps(w), F.lit(3), lambda a, x: a + x)))


def _neighbours(keys: Column) -> Column:
    return F.arrays_zip(F.slice(keys, 1, F.size(keys) - 1).alias("a"), F.slice(keys, 2, F.size(keys) - 1).alias("b"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs again.

    A window is a number: its hash above, its place in the low bits. Sorted, windows of one hash are neighbours, and the words of all
    such neighbours are compared. Should two differ, the windows are sorted by their words instead.
    """
    last = F.size(words) - 3
    shift = F.ceil(F.log2(F.size(words) + 1)).cast("int")
    places = F.sequence(F.lit(0), last)
    code = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), shift).bitwiseOR(i.cast("long"))
    high = lambda k: F.call_function("shiftrightunsigned", k, shift)
    low = lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1).cast("int")
    near = _let(F.sort_array(F.transform(places, code)), lambda k: F.transform(F.filter(_neighbours(k), lambda p: high(p["a"]) == high(p["b"])), lambda p: F.struct(low(p["a"]).alias("a"), low(p["b"]).alias("b"))))
    key = lambda i: F.struct(*[F.get(words, i + k).alias(f"w{k}") for k in range(3)], i.alias("i"))
    by_words = _let(F.sort_array(F.transform(places, key)), lambda k: F.transform(F.filter(_neighbours(k), lambda p: (p["a"]["w0"] == p["b"]["w0"]) & (p["a"]["w1"] == p["b"]["w1"]) & (p["a"]["w2"] == p["b"]["w2"])), lambda p: F.struct(p["a"]["i"].alias("a"), p["b"]["i"].alias("b"))))
    both = lambda pairs: F.concat(pairs["a"], pairs["b"])
    count = _let(near, lambda n: F.when(F.size(n) == 0, 0).when(F.forall(n, lambda p: _same_words(words, p["a"], p["b"])), _covered(both(n))).otherwise(_covered(both(by_words))))
    return F.when(last < 1, 0).otherwise(count)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row.

    Null texts count as empty. Repeated rows each get a row; only the two named columns are read.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t"))
    t = t.withColumn("words", F.filter(F.split("t", SPACES), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != ""))
    return t.select(
        "doc_id", "t", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), repeated_words).cast("long").alias("n_repeat_words"),
    )


def measured(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, share of rows that it rejects, seconds for a row): each rule alone, timed beside a rule that does nothing."""

    def run(condition: str) -> tuple[float, int, int]:
        best = 1e9
        for _ in range(TIMES):
            began = time.perf_counter()
            n, rejected = sample.agg(F.count("*"), F.count_if(F.expr(condition))).first()
            best = min(best, time.perf_counter() - began)
        return best, n, rejected

    idle, n, _ = run("false")
    out = []
    for r in rules:
        took, _, rejected = run(r.reject)
        out.append((r, rejected / max(n, 1), max(took - idle, 1e-4) / max(n, 1)))
    return out


def order(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejections per cost on a random sample, the most useful first; ties keep the given order."""
    rows = stats.select("doc_id").count()
    here = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "t"), F.lit(FINE)) < F.lit(FINE) * min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = scratch(stats.filter(here), "rule-sample")
    worth = [(-share / cost, i, r) for i, (r, share, cost) in enumerate(measured(sample, rules))]
    discard(sample)
    return [r for *_, r in sorted(worth, key=lambda x: x[:2])]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; CASE stops at the first."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(F.expr(r.reject), F.lit(r.name))
    return out


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the four statistics, n_words, base_failed and kept for every row.

    Null and empty texts have no words and fail the base. Repeated rows each get a row, with one verdict. Only the two named columns
    are read, so other names can't clash; texts of any length are judged whole; an empty table gives an empty result.
    """
    stats = with_statistics(docs, id_col, text_col)
    first = cascade(order(stats, rules))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(BASE).alias("base_failed"), first.isNull().alias("kept"),
    )


_DUCK = {
    "few_letters": r"2 * len(regexp_extract_all(t, '[^\x20\x09-\x0D\p{L}]')) > word_chars",
    "shouting": r"2 * len(regexp_extract_all(t, '\p{Lu}')) > word_chars",
}
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
n AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
s AS (SELECT doc_id, t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, {BASE} AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(_DUCK.get(r.name, r.reject) for r in RULES)}) AS kept
FROM b
"""
