"""Toxicity of texts that may hide their words.

Noisy channel: a writer had a word in mind and swapped letters for look-alikes, spaced it out or drew letters out. Suspicious
stretches become lattices of what each character may have been, and Viterbi finds the reading that a character trigram model of
the corpus and the costs of the channel make likeliest. The restored text is then scored: each word and word beginning has a
log-odds weight learnt from labelled documents, and a logistic model turns a document's strongest weights into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold_batches, one_of_each, scratch
from tessera.llm.sampling import remainder

HELD_OUT_PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled documents that the weights are learnt from, of each class at most.
FIT_PER_CLASS = 6000
#: A feature is kept if so many of these toxic documents have it and its odds ratio is at least this.
LEAST_DOCS, LEAST_RATIO = 3, 6.0
BEGINNINGS = range(4, 9)
SYMBOLS = 32
#: Look-alikes.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
COST_SWAP, COST_BREAK, COST_DROP, COST_REPEAT = 1.0, 7.0, 0.3, 0.2
#: Look-alikes that after a letter are more often punctuation.
CLOSING = "!|+*("
#: Code points of the letters that the model tells apart besides a to z.
ACCENTED = "äöüß"

_LETTER = r"[^\W\d_]"
#: At least three single characters, spaced out by one to three separators each.
_SPACED = re.compile(r"(?<![^\W_])(?<![@$!|+*])(?:(?:[^\W_]|[@$!|+*])[ .\-_~/]{1,3}+){2,}(?:[^\W_]|[@$!|+*])(?![^\W_])(?![@$!|+*])")
_WORD = re.compile(rf"{_LETTER}+")
#: A character three times over or more: a letter that was drawn out.
_DRAWN = re.compile(r"(\S)\1{2,}")
_SEPARATORS = " .-_~/"
MEMO = 100_000


def symbol(ch: str) -> int:
    """0 for a break, 1 to 26 for a to z, then accented ones, last any other letter."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    at = ACCENTED.find(ch)
    return 27 + at if at >= 0 and ch else (31 if ch.isalpha() else 0)


_TABLE = np.array([symbol(chr(i).lower()[:1]) for i in range(0x3000)], dtype=np.int64)


def trigrams(text: str) -> np.ndarray:
    """Numbers of the trigrams of symbols of the text, runs of breaks as one."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    s = np.where(x < len(_TABLE), _TABLE[np.minimum(x, len(_TABLE) - 1)], 31)
    s = np.concatenate([[0], s[(s > 0) | np.append(True, s[:-1] > 0)], [0]])
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, dtype=np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for t in batch.column(0):
            g = trigrams(t.as_py() or "")
            if len(g):
                total += np.bincount(g, minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log-probabilities [a, b, c] of symbol c after a and b, from the counts of all texts; the alphabet bounds what is collected."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.full(SYMBOLS**3, 0.1)
    for r in counts:
        n[r.gram] += r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    low = n.sum(axis=0)
    smooth = low / low.sum(axis=1, keepdims=True)
    n = n + 5 * smooth[None]
    return -np.log(n / n.sum(axis=2, keepdims=True))


#: Kinds of code points: letter, look-alike, separator, white space.
_IS_LETTER, _IS_LEET, _IS_SEPARATOR, _IS_SPACE, _IS_CLOSING = 1, 2, 4, 8, 16
_KIND = np.array(
    [(chr(i).isalpha()) * _IS_LETTER | (chr(i) in LEET) * _IS_LEET | (chr(i) in _SEPARATORS) * _IS_SEPARATOR | chr(i).isspace() * _IS_SPACE | (chr(i) in CLOSING) * _IS_CLOSING for i in range(0x3000)],
    dtype=np.uint8,
)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return x, np.where(x < len(_KIND), _KIND[np.minimum(x, len(_KIND) - 1)], _IS_LETTER)


class Restorer:
    """Viterbi over character lattices; readings are remembered by stretch."""

    def __init__(self, model: np.ndarray):
        self.cost = model.tolist()
        self.memo: dict[str, str] = {}

    def restore(self, text: str) -> str:
        """The lower-cased text with its suspicious stretches as they were most likely meant: runs of spaced-out characters, and
        tokens with a look-alike beside a letter or with a letter three times over."""
        text = text.lower()
        x, kind = _codes(text)
        gap = np.concatenate([[True], kind & (_IS_SEPARATOR | _IS_SPACE) > 0, [True]])
        single = np.flatnonzero(gap[:-2] & ~gap[1:-1] & gap[2:])
        if len(single) > 2 and (single[2:] - single[:-2] <= 8).any():
            text = _SPACED.sub(lambda m: self.decode(m[0]), text)
            x, kind = _codes(text)
        if len(x) < 3:
            return text
        letter, leet = kind & _IS_LETTER > 0, kind & _IS_LEET > 0
        core = np.zeros(len(x), dtype=bool)
        core[:-1] = leet[:-1] & letter[1:]
        core[1:] |= leet[1:] & letter[:-1] & (kind[1:] & _IS_CLOSING == 0)
        core[:-2] |= (x[:-2] == x[1:-1]) & (x[1:-1] == x[2:]) & letter[2:]
        if not core.any():
            return text
        space = np.concatenate([[-1], np.flatnonzero(kind & _IS_SPACE > 0), [len(x)]])
        out, at = [], 0
        for k in np.unique(np.searchsorted(space, np.flatnonzero(core))).tolist():
            start, end = int(space[k - 1]) + 1, int(space[k])
            out += [text[at:start], self.decode(text[start:end])]
            at = end
        return "".join([*out, text[at:]])

    def decode(self, s: str) -> str:
        if (known := self.memo.get(s)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            known = self.memo[s] = self._decode(s)
        return known

    def _decode(self, s: str) -> str:
        path, out = self.cheapest(s)[1], []
        while path is not None:
            path, ch = path
            out.append(ch)
        return "".join(reversed(out)).strip()

    def cheapest(self, s: str) -> tuple[float, tuple | None]:
        """Cost and linked outputs of the likeliest reading, by Viterbi over what each character may have been."""
        spaced = bool(re.match(r"\S[ .\-_~/]+\S[ .\-_~/]+\S(?:[ .\-_~/]|$)", s))
        # state: last two symbols and the last output letter -> (cost, linked list of outputs)
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        drawn = {i for m in _DRAWN.finditer(s) for i in range(*m.span())}
        for i, ch in enumerate(s + " "):
            if ch.isalpha():
                choices = [(ch, 0.0)]
            elif ch in LEET:
                choices = [(v, COST_SWAP) for v in LEET[ch]] + [(" ", COST_BREAK if ch not in "!*|+(" else 1.0)]
            elif ch in _SEPARATORS:
                choices = [(" ", 0.0 if not spaced else 1.0), ("", COST_DROP)]
            else:
                choices = [(" ", 0.0)]
            new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            for (a, b, last), (cost, path) in states.items():
                row = self.cost[a][b]
                for out, extra in choices:
                    if out == "" or (out == " " and b == 0):
                        key, c, p = (a, b, last), cost + extra, path
                    else:
                        v = symbol(out)
                        key, c, p = (b, v, out), cost + extra + row[v], (path, out)
                        if out == last and v and i in drawn:  # the same letter again, unsaid
                            k2, c2 = (a, b, last), cost + extra + COST_REPEAT
                            if c2 < new.get(k2, (1e300,))[0]:
                                new[k2] = (c2, path)
                    if c < new.get(key, (1e300,))[0]:
                        new[key] = (c, p)
            states = new
        return min(states.items(), key=lambda x: (x[1][0], x[0]))[1]


def words_of(text: str | None, restorer: Restorer) -> set[str]:
    out: set[str] = set()
    for token in set(restorer.restore(text).split()) if text else ():
        if token.isalpha():
            out.add(token)
        else:
            out.update(_WORD.findall(token))
    return out


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a hyphen."""
    return [word, *[word[:k] + "-" for k in BEGINNINGS if k <= len(word)]]


def _words(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """y, text -> y, words of the restored text."""
        restorer = Restorer(model.value)
        for batch in batches:
            words = [sorted(words_of(t.as_py(), restorer)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["y", "words"])

    return run


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y, words -> feature, toxic documents, others."""
    for batch in batches:
        seen = (Counter(), Counter())
        for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen[y].update({f for w in words.as_py() for f in features_of(w)})
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "pos", "neg"])


class Model:
    """weights: feature -> (toxic documents, others) of n_pos and n_neg; coefficients of the logistic model over summary()."""

    def __init__(self, weights: dict[str, tuple[int, int]], n_pos: int, n_neg: int, language: np.ndarray):
        self.weights, self.n, self.language = weights, (n_pos, n_neg), language
        self.coefficients = np.array([-2.0, 0.6, 0.2, 0.3, 0.0])
        self.starts = {f[: BEGINNINGS[0]] if len(f) > BEGINNINGS[0] else f for f in weights}

    def weight(self, pos: float, neg: float, n_pos: float, n_neg: float) -> float:
        return float(np.log((pos + 0.3) / (n_pos + 0.6)) - np.log((neg + 0.3) / (n_neg + 0.6)))

    def summary(self, words: set[str], own: int | None = None) -> list[float]:
        """1, the two strongest word weights, the share and the number of words with a weight; own: the class that this document added to."""
        n_pos, n_neg = self.n[0] - (own == 1), self.n[1] - (own == 0)
        found = []
        for w in words:
            if w[: BEGINNINGS[0]] not in self.starts:
                continue
            best = 0.0
            for f in features_of(w):
                if (c := self.weights.get(f)) is not None:
                    pos, neg = c[0] - (own == 1), c[1] - (own == 0)
                    if pos > 0:
                        best = max(best, self.weight(pos, neg, n_pos, n_neg))
            if best > 0:
                found.append(best)
        found.sort(reverse=True)
        strong = sum(x > 3 for x in found)
        return [1.0, found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, float(np.log1p(strong)), float(np.sqrt(strong / max(len(words), 1)))]

    def score(self, summary: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.coefficients, summary), -30, 30))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes weigh as in the whole, where `share` of the documents is toxic."""
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    b, reg = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    reg[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + reg + 1e-9 * np.eye(x.shape[1]), x.T @ (w * (y - p)) - reg @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from at most FIT_PER_CLASS labelled documents of each class that aren't held out, the same ones in every run.

    Labels other than 0 and 1 and null ids are left out; of several rows with one id one text is learnt from. If no labelled document
    of a class is in docs, the model has the coefficients that it starts with, moved towards the class that there is.
    """
    spark = docs.sparkSession
    hold_batches(spark)
    language = language_model(docs, text_col)
    may = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder("doc_id", HELD_OUT_PARTS) != HELD_OUT))
    counts = {r.y: r["count"] for r in may.groupBy("y").count().collect()}
    place = F.xxhash64(F.lit("toxic"), "doc_id")
    take = lambda y: may.filter(F.col("y") == y).orderBy(place, "doc_id").limit(FIT_PER_CLASS)
    ids = take(0).unionByName(take(1))  # at most 2 * FIT_PER_CLASS ids
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
    shared = spark.sparkContext.broadcast(language)
    known = scratch(one_of_each(picked, [F.col("doc_id"), F.col("y")]).select("y", "text").mapInArrow(_words(shared), "y int, words array<string>"), "toxic-words")
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    seen = known.mapInArrow(_learnt, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = (F.col("pos") + 0.3) / (n_pos + 0.6) / ((F.col("neg") + 0.3) / (n_neg + 0.6))
    kept = seen.filter(F.col("pos") >= LEAST_DOCS).filter(ratio >= LEAST_RATIO).collect()  # of the words of FIT_PER_CLASS documents
    model = Model({r.feature: (r.pos, r.neg) for r in sorted(kept)}, n_pos, n_neg, language)
    if not n_pos or not n_neg:
        model.coefficients = np.array([2.0 if n_pos else -2.0, 0, 0, 0, 0])
        return model
    sent = spark.sparkContext.broadcast(model)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(0).to_pylist()
            rows = [sent.value.summary(set(words.as_py()), y) for y, words in zip(ys, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    rows = sorted((r.y, r.x) for r in known.mapInArrow(summaries, "y int, x array<double>").collect())  # at most 2 * FIT_PER_CLASS
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], dtype=float)
    model.coefficients = _fit_logistic(x, y, counts[1] / (counts[0] + counts[1]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts have no words and score accordingly. Repeated rows each
    get a row; only the two named columns are read; an empty table gives an empty result."""
    hold_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.language)
        for batch in batches:
            s = [m.score(m.summary(words_of(t.as_py(), restorer))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, with a model learnt from labels (doc_id, toxic).

    Null and empty texts have no words and score accordingly. Repeated rows each get a row, with one score. Without labels of a class,
    or if no labelled document is in docs, all scores follow from the rest. Only the two named columns of docs are read, so other
    names can't clash; texts of any length are scored whole; an empty table gives an empty result.
    """
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
