"""Byte-level BPE by a monoid tree reduction.

Encoding is two such reductions, one above the other.

1. Pieces. A text is halved down to leaves, which the pattern cuts into pieces. At a join the cut is made anew in a window that starts at
   the last piece of the left half which ends REACH characters before the seam, and grows piece by piece until it meets a border of
   the right half. To the left of the window nothing changes, since no choice of the pattern looks further; to the right nothing
   changes, since the pattern never looks back: from a common border on, both cuts are the same.
2. Tokens. The bytes of a piece of over MEMO_CHARS characters are halved down to leaves, which are merged by rank; shorter pieces are leaves. At a join the tokens next to the seam are merged anew
   in a window that doubles until its first and last token agree with their neighbours outside. Two tokens agree if merging the
   bytes of both gives the two again. A row of tokens in which all neighbours agree is what merging the whole gives: up to the first
   merge across a border both sides develop as they would alone, so that merge would happen in the bytes of the two tokens too.

Tokens never cross pieces, so a text's ids are those of its pieces in order. Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold_batches, in_pieces

LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 1 << 10, 1 << 7, 1 << 12
#: By pattern, how many characters past its end the choice of a piece may depend on. Texts are not halved for patterns that aren't here.
REACH = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": 2}
#: Pieces and pairs of tokens that are remembered, and the longest such piece.
MEMO, MEMO_CHARS = 1 << 16, 32


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Memo(dict):
    """Ids by piece, worked out when first asked for; emptied when full."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> Sequence[int]:
        if len(piece) > MEMO_CHARS:
            return self.codec.piece(piece.encode())
        if len(self) >= MEMO:
            self.clear()
        ids = self[piece] = tuple(self.codec.leaf(piece))  # no work for the garbage collector
        return ids


class Codec:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.pattern, self.reach = regex.compile(pattern), REACH.get(pattern)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        #: Short pieces are leaves that the library merges; its pattern takes any text as one piece.
        self.leaf = tiktoken.Encoding("ranks", pat_str="(?s).+", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.memo, self.agreed = _Memo(self), {}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text, 0, len(text)))))

    # 1. pieces

    def pieces(self, text: str, lo: int, hi: int) -> list[str]:
        """The pieces of text[lo:hi]."""
        if self.reach is None or hi - lo <= self.leaf_chars:
            return self.pattern.findall(text, lo, hi)
        mid = (lo + hi) // 2
        return self.join_pieces(text, mid, hi, self.pieces(text, lo, mid), self.pieces(text, mid, hi))

    def join_pieces(self, text: str, mid: int, hi: int, left: list[str], right: list[str]) -> list[str]:
        """The pieces of a stretch up to hi from those of its parts up to mid and from there."""
        keep, at = len(left), mid
        while keep and at > mid - self.reach:
            keep -= 1
            at -= len(left[keep])
        skip, border, window = 0, mid, []
        while at != border:
            if at < border:
                piece = self.pattern.match(text, at, hi)[0]
                window.append(piece)
                at += len(piece)
            else:
                border += len(right[skip])
                skip += 1
        return left[:keep] + window + right[skip:]

    # 2. tokens

    def piece(self, b: bytes) -> list[int]:
        """The ids of a piece."""
        known = self.ranks.get(b)
        return [known] if known is not None else self.tokens(b)

    def tokens(self, b: bytes) -> list[int]:
        if len(b) <= self.leaf_bytes:
            return self.merged(b)
        half = self.leaf_bytes
        while 2 * half < len(b):
            half *= 2
        return self.join_tokens(self.tokens(b[:half]), self.tokens(b[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        size = 0
        while True:
            keep = max(len(left) - size, 0)
            window = self.merged(b"".join([self.bytes_of[i] for i in left[keep:] + right[:size]]))
            row = left[max(keep - 1, 0) : keep] + window + right[size : size + 1]
            if all(map(self.agree, row, row[1:])):
                return left[:keep] + window + right[size:]
            size = 2 * size or 1

    def agree(self, a: int, b: int) -> bool:
        known = self.agreed.get((a, b))
        if known is None:
            if len(self.agreed) >= MEMO:
                self.agreed.clear()
            known = self.agreed[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def merged(self, b: bytes) -> list[int]:
        """The neighbours whose joint bytes have the least rank become one, the leftmost first, until none has a rank."""
        ranks, n = self.ranks, len(b)
        end, before, whole = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not whole[i] or j >= n or end[j] != to:  # one of the two has changed meanwhile
                continue
            whole[j], end[i] = 0, to
            if to < n:
                before[to] = i
                if (r := ranks.get(b[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (h := before[i]) >= 0 and (r := ranks.get(b[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        return [ranks[b[i : end[i]]] for i in range(n) if whole[i]]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self.bytes_of[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _clash(docs: DataFrame, *names: str | None) -> None:
    if clash := {n.lower() for n in names if n} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{sorted(clash)} are columns already")


def _lists(rows: list[list[int]]) -> pa.Array:
    """Ids as one Arrow array, without a Python number for each."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_documents(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, ids_col: str = "token_ids", digest_col: str | None = None) -> DataFrame:
    """docs with the ids of each whole text in ids_col, and if named the SHA-256 of what the ids decode to in digest_col.

    Null texts count as empty, empty texts have no ids. Texts of any length are encoded whole. Repeated rows each get a row. All other
    columns pass through Python untouched; a new column with the name of another raises ValueError. An empty table gives an empty
    result.
    """
    ranks, pat = ranks_path or default_ranks(), pattern or default_pattern()
    _clash(docs, ids_col, digest_col)
    hold_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pat)
        for batch in (piece for b in batches for piece in in_pieces(b, at)):
            ids = [c.encode(t.as_py() or "") for t in batch.column(at)]
            new = [_lists(ids)]
            if digest_col:
                new.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, ids_col, *[digest_col] * bool(digest_col)])

    out = docs.withColumn(ids_col, F.array().cast("array<int>"))
    return docs.mapInArrow(run, (out.withColumn(digest_col, F.lit("")) if digest_col else out).schema)


def decode_documents(coded: DataFrame, ids_col: str = "token_ids", ranks_path: str | None = None, pattern: str | None = None, bytes_col: str = "decoded") -> DataFrame:
    """coded with the bytes of each row's ids in bytes_col; null and empty ids decode to nothing, an id without a token raises IndexError.

    Repeated rows each get a row; other columns pass through; a new column with the name of another raises ValueError. An empty table
    gives an empty result.
    """
    ranks, pat = ranks_path or default_ranks(), pattern or default_pattern()
    _clash(coded, bytes_col)
    hold_batches(coded.sparkSession)
    at = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pat)
        for batch in batches:
            out = pa.array([c.decode(ids.as_py() or []) for ids in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, bytes_col])

    return coded.mapInArrow(run, coded.withColumn(bytes_col, F.lit(b"")).schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids alone, in one pass.

    Null texts count as empty. Repeated rows each get a row; only the two named columns are read; an empty table gives an empty result.
    """
    ranks, pat = ranks_path or default_ranks(), pattern or default_pattern()
    hold_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pat)
        name = list(map(str, range(len(c.bytes_of))))
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(name.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
