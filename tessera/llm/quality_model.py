"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass over the texts gives each document a few statistics, made near normal by logarithms and square roots. Each class is a
normal density whose covariance is shrunk towards its diagonal and that of all; means and covariances come from moments of all
labelled rows, added up where the rows are. The score is the difference of log-densities and priors, from Mahalanobis distances
by the classes' Cholesky factors, which are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import hold_batches, scratch
from tessera.llm.sampling import remainder

NAMES = (
    "words", "word_bytes", "word_spread", "symbols", "upper", "digits", "stops", "shouts", "bars", "other_punctuation",
    "vocabulary", "top_word", "repeated_windows", "same_lines", "line_words", "short_lines",
)
SHRINK_OWN = 0.10
SHRINK_ALL = 0.05
FLOOR = 1e-4
TEMPERATURE = 4.0
THRESHOLD = 0.3
HELD_OUT_PARTS, HELD_OUT = 5, 0


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = np.array([
    _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b".,"), _mask(b"!?"), _mask(b"|"),
    _mask(b"-_/\\()[]{}=+:;\"'`~@^"), _mask(b" \t\n\x0b\f\r"), _mask(bytes(range(128, 192))),
], dtype=np.int64)


def _counted(data: np.ndarray) -> np.ndarray:
    """How often each class of bytes occurs."""
    total = np.zeros(256, dtype=np.int64)
    for a in range(0, len(data), shingles.BLOCK):
        total += np.bincount(data[a : a + shingles.BLOCK], minlength=256)
    return _CLASSES @ total


def _repeats(hashes: np.ndarray) -> tuple[int, int, int]:
    """(distinct values, rows of the commonest, rows of values that occur again)."""
    _, n = np.unique(hashes, return_counts=True)
    return len(n), int(n.max()), int(n[n > 1].sum())


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    out = [np.zeros((0, len(NAMES)))]
    for at, to, data, cuts in shingles.texts_of(column):
        n = to - at
        x = np.zeros((n, len(NAMES)))
        out.append(x)
        if not len(data):
            continue
        words, text, start, end = shingles.word_hashes(data, cuts)
        ends = np.searchsorted(text, np.arange(n + 1))
        windows = shingles.mixed(words[:-2] * shingles._WORD[0] + words[1:-1] * shingles._WORD[1] + words[2:] * shingles._WORD[2]) if len(words) > 2 else words[:0]
        for i in range(n):
            a, b = int(ends[i]), int(ends[i + 1])
            w = b - a
            if not w:
                continue
            own = data[cuts[i] : cuts[i + 1]]
            symbols, upper, digits, stops, shouts, bars, other, spaces, inner = _counted(own).tolist()
            chars = max(len(own) - spaces - inner, 1.0)
            letters = max(chars - symbols - digits - stops - shouts - other, 1.0)
            different, top, _ = _repeats(words[a:b])
            again = _repeats(windows[a : b - 2])[2] / (w - 2) if w > 3 else 0.0
            # lines that hold a word
            feeds = np.flatnonzero(own == 10)
            line = np.unique(np.searchsorted(feeds, start[a:b] - cuts[i]))
            begin, stop = np.concatenate([[0], feeds + 1])[line], np.concatenate([feeds, [len(own)]])[line]
            lines = len(np.unique(shingles.span_hashes(own, begin, stop)))
            x[i] = (
                np.log1p(w), np.log(chars / w), np.sqrt((end[a:b] - start[a:b] > 12).sum() / w), np.sqrt(symbols / chars), np.sqrt(upper / letters), np.sqrt(digits / chars),
                np.sqrt(stops / w), np.sqrt(shouts / w), np.sqrt(bars / w), np.sqrt(other / chars),
                np.log(different) / np.log(w + 1.0), np.sqrt(top / w), np.sqrt(again), np.sqrt(1 - lines / len(line)),
                np.log1p(w / len(line)), (stop - begin < 30).sum() / len(line),
            )
    return np.concatenate(out)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (the statistics) of every row."""
    hold_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, label -> label, place, value: sums of (1, x) (1, x)' of each label."""
    d = len(NAMES) + 1
    total = {}
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        x = np.hstack([np.ones((len(x), 1)), x])
        for v in np.unique(y):
            total[int(v)] = total.get(int(v), np.zeros((d, d))) + x[y == v].T @ x[y == v]
    for v, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, v)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["label", "place", "value"])


class Model:
    """Class densities; a class without rows makes every score the share of the other."""

    def __init__(self, moments: dict[int, np.ndarray]):
        self.classes, counts = {}, {v: m[0, 0] for v, m in moments.items()}
        rows = sum(counts.values())
        self.prior = (counts.get(1, 0) + 1) / (rows + 2)
        if len([c for c in counts.values() if c > 1]) < 2:
            return
        both = sum(moments.values())
        mean = both[0, 1:] / rows
        spread = np.diag(both[1:, 1:] / rows - np.outer(mean, mean)).clip(FLOOR)
        for v, m in moments.items():
            mu = m[0, 1:] / counts[v]
            s = (m[1:, 1:] / counts[v] - np.outer(mu, mu)) * counts[v] / max(counts[v] - 1, 1)
            few = min(1.0, SHRINK_OWN + len(mu) / counts[v])
            s = (1 - few) * s + few * np.diag(np.diag(s))
            s = (1 - SHRINK_ALL) * s + SHRINK_ALL * np.diag(spread)
            factor = np.linalg.cholesky(s + 1e-9 * np.eye(len(mu)))
            self.classes[v] = (mu, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(counts[v] / rows))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if set(self.classes) != {0, 1}:
            return np.full(len(x), self.prior)
        d = {v: -0.5 * ((((x - mu) @ inv.T) ** 2).sum(axis=1) + logdet) + logp for v, (mu, inv, logdet, logp) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip((d[0] - d[1]) / TEMPERATURE, -700, 700)))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """From all labelled rows that aren't held out; labels other than 0 and 1 are left out."""
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("long").alias("label")).filter("label IN (0, 1)")
    rows = stats.filter(remainder("doc_id", HELD_OUT_PARTS) != HELD_OUT).join(known, "doc_id").select("x", "label")
    sums = rows.mapInArrow(_moments, "label long, place long, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    d, found = len(NAMES) + 1, {}
    for r in sums.collect():  # two classes of d * d sums
        found.setdefault(r.label, np.zeros(d * d))[r.place] = r.value
    return Model({v: np.round(m, 6).reshape(d, d) for v, m in sorted(found.items())})


def score(stats: DataFrame, model: Model) -> DataFrame:
    rows = stats.select("doc_id", (remainder("doc_id", HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), "x")
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, with a model learnt from labels.

    Null and empty texts have all statistics 0 and are scored as such. Repeated rows each get a row. Without labels of both
    classes every score is 0.5 or the only class's share. Only the two named columns of docs are read; an empty table gives
    an empty result.
    """
    stats = scratch(with_statistics(docs, id_col, text_col), "quality-statistics")
    return score(stats, train(stats, labels))
