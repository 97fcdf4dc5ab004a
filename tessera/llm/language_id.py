"""Language identification with string kernels.

A text's blended spectrum is the set of its letter n-grams of 1 to 3, hashed to SPECTRUM places. The kernel of two texts is the
number of places they share over the geometric mean of what each has. Nyström: MARKS landmark texts span the space; with
K_mm = U S U', K(x, marks) U S^-1/2 are a text's coordinates, on which a ridge regression for each language against the rest is
solved in closed form. A batch of texts is scored by two matrix products: spectra by landmarks, kernels by weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold_batches
from tessera.llm.sampling import remainder, stratified

SPECTRUM = 1 << 14
ORDERS = (1, 2, 3)
MARKS = 96
RIDGE = 1e-3
SHARPNESS = 8.0
#: Characters of a text that are looked at together.
PIECE = 1 << 16
#: A score weighs the best language against so many others at most, so that it doesn't sink as languages are added.
RIVALS = 31
#: Labelled texts that the model is fitted on: about so many of each language, fewer if all would be over FIT_ROWS, but one at least.
FIT_PER_LANGUAGE = 400
FIT_ROWS = 12_800
UNKNOWN = "und"
HELD_OUT_PARTS, HELD_OUT = 4, 2
ROWS_AT_ONCE = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """0 for code points that are no letters, else the code point of the lower-case letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):  # no list of all of them
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def places(text: str) -> np.ndarray:
    """The places of the text's spectrum; empty without a letter. Long texts go piece by piece, with the last symbols of the piece before."""
    seen, tail, letters = np.zeros(SPECTRUM, dtype=bool), np.zeros(0, dtype=np.uint32), False
    for at in range(0, len(text), PIECE):
        x = _letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), dtype=np.uint32)]
        letters = letters or bool(x.any())
        x = np.concatenate([tail, x])
        x = x[(x > 0) | np.append(True, x[:-1] > 0)]  # one break between words
        for n in ORDERS:
            h = np.zeros(max(len(x) - n + 1, 0), dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)] + np.uint64(n)
            h ^= h >> np.uint64(29)
            seen[((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64)] = True
        tail = x[1 - max(ORDERS) :]
    return np.flatnonzero(seen) if letters else np.zeros(0, dtype=np.int64)


def spectra(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of unit length for each text, which texts have a letter)."""
    x = np.zeros((len(texts), SPECTRUM), dtype=np.float32)
    for i, t in enumerate(texts):
        if t:
            x[i, places(t)] = 1.0
    size = x.sum(axis=1)
    return x / np.sqrt(np.maximum(size, 1.0))[:, None], size > 0


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Unit spectra from rows of packed bits."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1), 1.0))[:, None]


def fit(bits: np.ndarray, labels: np.ndarray, marks: int = MARKS, ridge: float = RIDGE) -> tuple[list, np.ndarray, np.ndarray]:
    """(languages, landmarks, weights) from packed spectra and their languages; landmarks are dealt evenly to the languages."""
    languages = sorted(set(labels.tolist()))
    each = [np.flatnonzero(labels == v) for v in languages]
    turn = [rows[k] for k in range(max(map(len, each))) for rows in each if k < len(rows)]
    z = unpacked(bits[turn[: max(marks, len(languages))]])
    s, u = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = s > 1e-6 * s.max()
    root = u[:, keep] / np.sqrt(s[keep])
    sizes = dict(zip(languages, map(len, each), strict=True))
    share = np.array([1 / sizes[v] for v in labels])
    gg, gy = 0.0, 0.0
    for i in range(0, len(bits), 256):  # all rows at once would grow with rows times languages
        g = unpacked(bits[i : i + 256]) @ z.T @ root
        g = np.hstack([g, np.ones((len(g), 1))])
        y = np.where(labels[i : i + 256, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
        gw = g * share[i : i + 256, None]
        gg, gy = gg + gw.T @ g, gy + gw.T @ y
    reg = ridge * np.eye(len(gg))
    reg[-1, -1] = 1e-9
    w = np.linalg.solve(gg + reg, gy)
    return languages, z, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)


class Model:
    def __init__(self, languages: list[str], marks: np.ndarray, weights: np.ndarray):
        self.languages, self.marks, self.weights = languages, marks, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; `und` and 0 without a letter or a learnt language."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names, scores = [], []
        for a in range(0, len(texts), ROWS_AT_ONCE):
            x, known = spectra(texts[a : a + ROWS_AT_ONCE])
            s = (x @ self.marks.T) @ self.weights[:-1] + self.weights[-1]
            e = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)) / 2)
            best = s.argmax(axis=1)
            rest = (e.sum(axis=1) - 1.0) * min(1.0, RIVALS / max(len(self.languages) - 1, 1))
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, 1.0 / (1.0 + rest), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, bits of the spectrum."""
    for batch in batches:
        out = []
        for t in batch.column(1):
            flags = np.zeros(SPECTRUM, dtype=bool)
            flags[places(t.as_py() or "")] = True
            out.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "bits"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample of the rows that have a language and a letter and aren't held out; every language among them is
    learnt. Only spectra of 2 KB come to the driver, FIT_ROWS of them about and no text of a language twice. A null or repeated id or an
    extra column is no matter; without a row to learn from the model knows no language."""
    hold_batches(docs.sparkSession)
    may = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (remainder(id_col, HELD_OUT_PARTS) != HELD_OUT))
    sample = stratified(may.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "id", "lang", "text", FIT_PER_LANGUAGE, FIT_ROWS)
    rows = sample.select("lang", "text").mapInArrow(_packed, "lang string, bits binary").orderBy("lang", "bits").collect()
    bits = np.array([np.frombuffer(r.bits, dtype=np.uint8) for r in rows], dtype=np.uint8).reshape(len(rows), SPECTRUM // 8)
    some = bits.any(axis=1)
    labels = np.array([r.lang for r in rows], dtype=object)
    if not some.any():
        return Model([], np.zeros((0, SPECTRUM), np.float32), np.zeros((1, 0), np.float32))
    order = np.random.default_rng(7).permutation(np.flatnonzero(some))
    return Model(*fit(bits[order], labels[order]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; null texts and those without a letter are `und` with score 0.

    Repeated rows each get a row; only the two named columns are read; an empty table gives an empty result.
    """
    hold_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", languages: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns as they were, in one of `languages` (any learnt one if None) with at least the score `least`.

    Null and empty texts and those without a letter go, as do all rows if no language was learnt. Repeated rows share one fate. No
    column name can clash. An empty table gives an empty result.
    """
    hold_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least and (languages is None or n in languages) for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
