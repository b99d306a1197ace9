"""Words of whole Arrow columns without a row loop: exact codes, hashes of words and shingles.

Distinct words come from Arrow's dictionary encoding, which compares bytes: two words never share a
code. A word's 64-bit hash takes its bytes eight at a time, each eight mixed whole into the state, so that
no sum of bytes or powers can make two words meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes worked on at once.
PIECE = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different byte strings among the spans ``buf[start:end]``, in the order in which they come
    first, and the place of each span's string among them. Spans are in order and do not overlap."""
    size = ends - starts
    if len(starts) and int(size.sum()) != len(buf):
        steps = np.empty(2 * len(starts) + 1, np.int64)  # gap, span, gap, span, ..., gap
        steps[1::2], steps[0::2] = size, np.append(starts, len(buf)) - np.insert(ends, 0, 0)
        buf = buf[np.repeat(np.arange(len(steps)) % 2 == 1, steps)]
    offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = spans.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are in order and do not overlap."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eights = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    out = mix((ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0xD6E8FEB86659FD93))
    at, own = starts, np.arange(len(starts))
    while len(own):
        left = ends[own] - at
        mask = U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.clip(left, 1, 8).astype(U64)))
        lane = np.where(left > 0, eights[at] & mask, U64(0))
        out[own] = mix((out[own] ^ lane) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D))
        more = left > 8
        own, at = own[more], at[more] + 8
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:
        lengths = np.where(valid, np.diff(off), 0)
        if (lengths != np.diff(off)).any():  # a null may own bytes
            column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
            return flat(column)[0], flat(column)[1], valid
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0], valid


def blocks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole rows with at most ``most`` bytes each; a longer row is a run of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than ASCII white space: starts, ends, and words per row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _runs(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each run of ``size`` words inside a row, and the number of runs per row.
    A row with fewer words, but one at least, is one run."""
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.repeat(first, own) + np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    return at, np.repeat(np.minimum(counts, size), own), own


def shingles(word_hash: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words inside a row, and their number per row. A row with
    fewer words, but one at least, has its whole sequence as its only shingle."""
    n = len(word_hash)
    if not n:
        return np.zeros(0, U64), np.zeros(len(counts), np.int64)
    at, length, own = _runs(counts, size)
    out = mix(length.astype(U64) + U64(0x2545F4914F6CDD1D))
    for k in range(size):
        step = mix(out * U64(0x9E3779B97F4A7C15) + word_hash[np.minimum(at + k, n - 1)])
        out = np.where(k < length, step, out)
    return out, own


def exact_shingles(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingles`, from the words' exact codes: equal numbers stand for equal runs, no hash decides."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    at, length, own = _runs(counts, size)
    base = int(codes.max()) + 2
    out = codes[at]
    for k in range(1, size):
        more = np.where(k < length, codes[np.minimum(at + k, n - 1)] + 1, 0)
        out = np.unique(out * base + more, return_inverse=True)[1]
    return out, own
