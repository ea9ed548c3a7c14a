"""Hashes of stretches of arrays, and what is known of hashes in a bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a map of hashes at most, and bits for each hash below that.
MOST_BITS, BITS_EACH = 1 << 26, 16
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_FIRST)
    return (h ^ (h >> np.uint64(29))) * np.uint64(_SECOND)


def unmixed(h: np.ndarray) -> np.ndarray:
    """What ``mixed`` has made ``h`` of."""
    h = h * np.uint64(pow(_SECOND, -1, 1 << 64))
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * np.uint64(pow(_FIRST, -1, 1 << 64))
    return h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))


class Powers:
    """Powers of an odd multiplier modulo 2^64, and of its inverse, as many as were needed."""

    def __init__(self, seed: int):
        self.base = (0x5851F42D4C957F2D + 2 * seed * 0x9E3779B9) % (1 << 64) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(n, b % (1 << 64), np.uint64)])
                for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


def hashed(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each stretch of bytes, eight at a time; ``data`` has eight more at its end."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    made = mixed(sizes.astype(np.uint64) + np.uint64(seed * 0x9E3779B9 + 1))
    at, on = starts, np.arange(len(starts))
    left = sizes
    while len(on):
        held = np.minimum(left, 8).astype(np.uint64)
        part = eights[at] & (~np.uint64(0) >> (np.uint64(64) - held * np.uint64(8)))
        made[on] = mixed((made[on] ^ part) + np.uint64(0x632BE59BD9B4E019))
        more = left > 8
        at, on, left = at[more] + 8, on[more], left[more] - 8
    return made


def firsts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of each different value."""
    order = np.argsort(values)
    held = values[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return order[first], np.diff(np.append(first, len(held)))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def place_keys(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mixed(keys.view(np.uint64) + mixed(places.astype(np.uint64)))


def bit_map(keys: DataFrame, name: str) -> np.ndarray:
    """Bits set at the remainders of ``keys``; of bounded size, whatever their number.

    Its 32-bit words are put together in pieces by Spark, so the driver gets the pieces alone.
    """
    wanted = math.ceil(math.log2(max(keys.count(), 1) * BITS_EACH))
    size = 1 << max(18, min(wanted, int(math.log2(MOST_BITS))))
    at = F.col(name).bitwiseAND(size - 1)
    words = (
        keys.select(
            F.shiftright(at, 5).cast("int").alias("at"),
            F.expr(f"shiftleft(1L, cast({name} & 31 as int))").alias("bit"),
        )
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
    )

    def piece(key, table):
        made = np.zeros(PIECE, np.uint32)
        places = table["at"].to_numpy() - key[0].as_py() * PIECE
        made[places] = table["bits"].to_numpy().astype(np.uint32)
        return pa.table({"piece": [key[0].as_py()], "bits": [made.tobytes()]}, PIECES)

    pieces = words.groupBy(F.shiftright("at", PIECE_BITS).alias("piece")).applyInArrow(
        piece, "piece int, bits binary"
    )
    made = np.zeros(size // 32, np.uint32)
    for row in pieces.collect():
        made[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(row["bits"], np.uint32)
    return made


#: Words of a piece of a bit map.
PIECE_BITS = 13
PIECE = 1 << PIECE_BITS
PIECES = pa.schema([("piece", pa.int32()), ("bits", pa.binary())])


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 32 - 1)
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1
