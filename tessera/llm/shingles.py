"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and the fast similarity sketch of such a set.

Everything works on the bytes of many texts at once. A word's hash is a polynomial over its lower-cased bytes, read off prefix
sums of blocks, so that a long text needs a few numbers for each word but none for each byte; a shingle's hash mixes those of its
words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
COORDINATES = 128
ROWS = 4
BANDS = COORDINATES // ROWS
#: Bytes of short texts that are looked at together, and of a block in which hashes are summed.
CHUNK_BYTES, BLOCK = 1 << 19, 1 << 18

U = np.uint64
_rng = np.random.default_rng(20240229)
_BASE = int(_rng.integers(1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
_WORD = _rng.integers(1 << 63, size=SIZE + 1, dtype=np.uint64) * U(2) + U(1)
_ROUND = _rng.integers(1 << 63, size=2 * COORDINATES, dtype=np.uint64)
_ROW = _rng.integers(1 << 63, size=ROWS, dtype=np.uint64) * U(2) + U(1)
_BAND = _rng.integers(1 << 63, size=BANDS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_tables: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse for the places of a block."""
    if not _tables:
        for b in (_BASE, _INVERSE):
            p = np.full(BLOCK + 1, b, dtype=np.uint64)
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
    return _tables


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased bytes of the spans, which rise and don't overlap: sums of value times base to the place in the span."""
    power, inverse = _powers()
    h = np.zeros(len(start), dtype=np.uint64)
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        lo, hi = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, b))
        if lo >= hi:
            continue
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data[a:b]] * power[: b - a], out=total[1:])
        s, e = np.maximum(start[lo:hi], a) - a, np.minimum(end[lo:hi], b) - a
        part = (total[e] - total[s]) * inverse[s]
        if start[lo] < a:  # a span that goes on from the block before
            part[:1] *= np.array([pow(_BASE, int(a - start[lo]), 1 << 64)], dtype=np.uint64)
        h[lo:hi] += part
    return mixed(h + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of the text it is in, its start, its end); text i is data[cuts[i]:cuts[i + 1]]."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = cuts[:-1][cuts[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = cuts[1:][cuts[1:] > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, start, end), (np.searchsorted(cuts, start, side="right") - 1).astype(np.int32), start, end


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, cuts) of pieces of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def sets_of(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: of all its words if it has fewer than `size`, none without words."""
    for at, to, data, cuts in texts_of(column):
        if not len(data):
            yield from (np.zeros(0, dtype=np.uint64) for _ in range(at, to))
            continue
        words, text, _, _ = word_hashes(data, cuts)
        ends = np.searchsorted(text, np.arange(to - at + 1))
        n = max(len(words) - size + 1, 0)
        joined = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            joined += words[k : k + n] * _WORD[k]
        joined = mixed(joined)
        for i in range(to - at):
            a, b = int(ends[i]), int(ends[i + 1])
            if b - a >= size:
                yield np.unique(joined[a : b - size + 1])
            elif b > a:
                short = words[a:b]
                yield mixed((short * _WORD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _WORD[size:] * U(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketch(x: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch: round i < t throws every element into a random bin with the value (i, random); round t + b throws all
    into bin b. A bin keeps its least value. Rounds go on until all bins are filled, at the latest by the last; two sketches
    agree in a coordinate with the Jaccard similarity as chance."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, -(-8 * t // len(x)))
    for i in range(0, 2 * t, step):
        rounds = np.arange(i, min(i + step, 2 * t))
        h = mixed(x[None, :] ^ _ROUND[rounds][:, None])
        bins = np.where(rounds[:, None] < t, (h >> U(57)).astype(np.int64) % t, rounds[:, None] - t)
        np.minimum.at(out, bins.ravel(), ((rounds.astype(np.uint64) << U(48))[:, None] | (h & U((1 << 48) - 1))).ravel())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """int64 keys, one for each band of ROWS coordinates."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS) * _ROW
    return mixed(mixed(parts).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)
