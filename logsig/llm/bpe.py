"""Byte-level BPE by tree reduction: encode halves, join neighbours, decode up the tree.

Two monoids are reduced. Over a text, an element is its list of pre-token pieces; two
neighbours are joined by scanning a window around their border again, which grows until
it meets a piece border of the right side (the pattern looks back at nothing, so the
scan goes on alike from there). Over one long piece, an element is its list of tokens;
two neighbours are joined by merging a window of border tokens again, which grows until
its outermost tokens come out unchanged: a token sequence is the encoding exactly if all
adjacent pairs are, and then all of them are.

Null and empty texts have no tokens. Rows are independent, so repeated rows, hot
sources and long texts need no exchange at all.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed, per_text, structs

LEAF_CHARS = 8192
LEAF_BYTES = 48
#: Characters after a piece that the pattern may look at before it ends it: an
#: apostrophe and two letters.
LOOK_AHEAD = 2
CACHED_PIECES = 100_000
CACHED_LENGTH = 40
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, of a file with a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked pair, leftmost first, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 4 * LEAF_BYTES:
        return _merge_heap(piece, ranks)
    get = ranks.get
    at = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == _NONE:
            break
        i = pairs.index(low)
        del at[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(piece[at[i - 1] : at[i + 1]], _NONE)
        if i < len(pairs):
            pairs[i] = get(piece[at[i] : at[i + 2]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def _merge_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long window, in n log n."""
    n, get = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= n or end[middle] != to:
            continue
        alive[middle] = False
        end[i] = to
        if to < n:
            before[to] = i
            if (r := get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        left = before[i]
        if left >= 0 and (r := get(piece[left:to])) is not None:
            heapq.heappush(heap, (r, left, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank file; small leaves are for tests."""

    def __init__(
        self,
        ranks: dict[bytes, int],
        pattern: str,
        leaf_chars: int = LEAF_CHARS,
        leaf_bytes: int = LEAF_BYTES,
    ):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 1), max(leaf_bytes, 1)
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token piece."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._tokens(piece)

    def _tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return merge(piece, self.ranks)
        half = len(piece) // 2
        return self.join_tokens(self._tokens(piece[:half]), self._tokens(piece[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 2
        while True:
            a, b = left[-width:], right[:width]
            window = merge(b"".join(self.tokens[t] for t in a + b), self.ranks)
            if (len(a) == len(left) or window[0] == a[0]) and (
                len(b) == len(right) or window[-1] == b[-1]
            ):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2

    def pieces(self, text: str) -> list[str]:
        """Pre-token pieces of a text."""
        if len(text) <= self.leaf_chars:
            return self.find(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        # What ends close to the border was found without seeing what follows.
        open_chars, keep = 0, len(left)
        while keep and open_chars < LOOK_AHEAD:
            keep -= 1
            open_chars += len(left[keep])
        tail, width = "".join(left[keep:]), 2
        while True:
            taken = right[:width]
            window = tail + "".join(taken)
            sure = len(window) if len(taken) == len(right) else len(window) - LOOK_AHEAD
            borders, at = {len(tail): 0}, len(tail)
            for i, piece in enumerate(taken, 1):
                at += len(piece)
                borders[at] = i
            found, at = self.find(window), 0
            for n, piece in enumerate(found, 1):
                at += len(piece)
                if at > sure:
                    break
                if at in borders:
                    return left[:keep] + found[:n] + right[borders[at] :]
            width *= 2

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get, out = self.packed.get, []
        for piece in self.pieces(text):
            ids = get(piece)
            if ids is None:
                ids = self._pack(piece)
                get = self.packed.get
            out.append(ids)
        return b"".join(out)

    def _pack(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.pack(self.encode_piece(piece.encode()))
        if len(piece) <= CACHED_LENGTH:
            # The pieces before the last ones are kept as long again.
            if len(self.packed) >= CACHED_PIECES:
                self.older, self.packed = self.packed, {}
            self.packed[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: leaves are looked up, neighbours concatenated up the tree."""
        if len(ids) > self.leaf_chars:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def codec_column(
    spark: SparkSession, path: str, pattern: str, make_row, fields: list[tuple[str, pa.DataType]], schema: str
):
    """A column function over texts; the rank file (a fixed vocabulary) is broadcast."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    def work():
        codec = Codec(ranks.value, pattern)

        def batch(texts: list[str]) -> pa.Array:
            rows = [make_row(codec, t) for t in texts]
            return structs(fields, [[r[i] for r in rows] for i in range(len(fields))])

        return batch

    return per_text(work, schema)


def _digests(codec: Codec, text: str):
    packed = codec.encode(text)
    decoded = codec.decode(np.frombuffer(packed, "<u4"))
    return (
        len(packed) // 4,
        hashlib.sha256(packed).hexdigest(),
        hashlib.sha256(decoded).hexdigest(),
    )


def _ids(codec: Codec, text: str):
    return (np.frombuffer(codec.encode(text), "<u4").astype(np.int32),)


def _checked_ids(codec: Codec, text: str):
    packed = codec.encode(text)
    ids = np.frombuffer(packed, "<u4")
    if codec.decode(ids) != text.encode():
        raise ValueError("token ids do not decode to their text")
    return (ids.astype(np.int32),)


def encoded(
    df: DataFrame, text: str | Column, path: str, pattern: str, check: bool = False
) -> DataFrame:
    """``df`` with ``token_ids array<int>``, the BPE ids of its text column. With ``check``, ids
    that do not decode to the bytes of their text are an error."""
    column = codec_column(
        df.sparkSession, path, pattern, _checked_ids if check else _ids, [("token_ids", pa.list_(pa.int32()))],
        "token_ids array<int>",
    )
    return computed(df, column(F.col(text) if isinstance(text, str) else text))


def decoded(df: DataFrame, ids: str, path: str) -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of an ids column (null: no bytes).

    An id without a token is an error."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(ranks.value, "")
        for batch in batches:
            rows = (np.array(row or [], np.int64) for row in batch.to_pylist())
            yield pa.array([codec.decode(row) for row in rows], pa.binary())

    return df.withColumn("decoded", run(F.col(ids)))


def round_trip(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """``df`` with token count and digests of the ids and of the bytes decoded from them."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    column = codec_column(
        df.sparkSession, path, pattern, _digests, fields,
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
    return computed(df, column(F.col(text)))
