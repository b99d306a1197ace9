"""CRC-32C, which Spark has no function for, over many values at once and in lanes of long ones."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The polynomial, reflected, and the mask that goes in and out.
POLYNOMIAL, ALL = 0x82F63B78, 0xFFFFFFFF
#: Values up to so many bytes are taken together; a longer one is cut in lanes, of more bytes from each bound on.
SHORT, LANES = 256, ((0, 16), (4096, 64), (65536, 256))


@lru_cache(maxsize=1)
def _step() -> np.ndarray:
    """Remainder of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def _advance(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States of the rows after each has taken its row of bytes."""
    table = _step()
    for column in block.T:
        state = table[(state ^ column) & 255] ^ state >> np.uint32(8)
    return state


@lru_cache(maxsize=len(LANES))
def _skip(lane: int) -> list[list[int]]:
    """What each byte of a state becomes by ``lane`` zero bytes."""
    return [_advance(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), np.zeros((256, lane), np.uint8)).tolist() for k in range(4)]


def crc32c(data: bytes) -> int:
    """The checksum of one value: its lanes advance side by side and are then joined."""
    if len(data) < 4:
        return int(_advance(np.array([ALL], np.uint32), np.frombuffer(data, np.uint8)[None])[0]) ^ ALL
    lane = next(n for least, n in reversed(LANES) if len(data) >= least)
    pad = -len(data) % lane
    body = np.zeros(pad + len(data), np.uint8)
    body[pad:] = np.frombuffer(data, np.uint8)
    body[pad : pad + 4] ^= 255  # zeros in front leave a zero state alone, so the mask enters here
    (a, b, c, d), state = _skip(lane), 0
    for x in _advance(np.zeros(len(body) // lane, np.uint32), body.reshape(-1, lane)).tolist():
        state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ x
    return state ^ ALL


def crc32c_many(values: list) -> list[int | None]:
    """Checksums of values that may be null: short ones together, a byte of all of them at a time."""
    out: list = [None] * len(values)
    short = [i for i, v in enumerate(values) if v is not None and len(v) <= SHORT]
    short.sort(key=lambda i: -len(values[i]))
    size = np.array([len(values[i]) for i in short], np.int64)
    start, body, state = np.cumsum(size) - size, np.frombuffer(b"".join(bytes(values[i]) for i in short), np.uint8), np.full(len(short), ALL, np.uint32)
    table = _step()
    for at in range(int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -at, "left"))  # values longer than this
        state[:m] = table[(state[:m] ^ body[start[:m] + at]) & 255] ^ state[:m] >> np.uint32(8)
    for i, x in zip(short, (state ^ np.uint32(ALL)).tolist(), strict=True):
        out[i] = x
    for i, v in enumerate(values):
        if v is not None and out[i] is None:
            out[i] = crc32c(bytes(v))
    return out


@F.pandas_udf(LongType())
def checksum(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values; null stays null."""
    return pd.Series(crc32c_many(data.tolist()), dtype="Int64")
