"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

``encode`` splits texts into pre-tokens, keeps for each chunk of documents (at most ``chunk_bytes``
of text, or one longer document) its distinct pre-tokens and, per document, the positions as indices
into them. Distinct pre-tokens are shuffled by buckets of their hash, so each distinct word of the
corpus is encoded once; the ids return to their chunk, where documents are reassembled by position. ``decode`` joins the token-byte table on the map side: its size is that of the vocabulary.

Rows: a null text counts as empty and gives no ids; repeated rows are encoded each; extra columns
are left out of the result and may have any name; an empty table gives an empty result. The chunks
are runs of the input's rows, which must come in a repeatable order (a scan, a checkpoint); a chunk
whose parts disagree raises an error, no row is ever dropped silently.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import PIECE, blocks, distinct, flat
from .memory import released

#: Bits of a bucket of word hashes, at least and at most, and documents for which one more is spent: words of
#: a bucket are encoded together. The number of a chunk's row of frequencies. Pre-tokens of documents in one row, about.
LEAST_BITS, MOST_BITS, DOCUMENTS = 10, 14, 1 << 24
MARK, GROUP = 1 << 20, 1 << 16
#: Distinct words of a bucket that a task remembers.
KNOWN = 1 << 20
#: Classes of characters in the splitting pattern.
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: The endings that the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the token's bytes and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point, from the regex library's Unicode tables."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, chars):
                out[low + m.start() : low + m.end()] = kind
    return out


def _code_points(buf: np.ndarray, lead: np.ndarray) -> np.ndarray:
    first = buf[lead].astype(np.uint32)
    wide = np.flatnonzero(first >= 0x80)
    if len(wide):
        at, b0 = lead[wide], first[wide]
        get = lambda k: (buf[np.minimum(at + k, len(buf) - 1)] & 0x3F).astype(np.uint32)
        two = ((b0 & 0x1F) << 6) | get(1)
        three = ((b0 & 0x0F) << 12) | (get(1) << 6) | get(2)
        four = ((b0 & 0x07) << 18) | (get(1) << 12) | (get(2) << 6) | get(3)
        first[wide] = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return first


def split(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """:func:`_split` in pieces of whole rows that stay in the processor's cache."""
    return np.concatenate([np.zeros(0, np.int64), *(_split(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) + offsets[i] for i, j in blocks(offsets, PIECE))])


def _split(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens of the rows begin, by the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    The pattern never needs more context than runs of one class: a run of white space before
    something else gives its last character away, to the next run if it is a space; and a lone
    apostrophe that no space precedes takes an ending from the letters after it.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = _code_points(buf, lead)
    kind = char_classes()[cp]
    n = len(lead)
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(lead, offsets)] = True
    row[n] = True
    begin = row[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin[0] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    k = kind[start]
    keep = begin
    inner = (k == WHITE) & ~row[end]  # white space with something after it in its row
    last = end[inner] - 1
    space = cp[last] == 32
    keep[last] = True
    keep[end[inner][space]] = False
    lone = (k == OTHER) & (end - start == 1) & (cp[start] == 39) & ~row[end]
    lone[:-1] &= k[1:] == LETTER
    lone[-1:] = False
    before = np.maximum(start - 1, 0)
    lone &= row[start] | (cp[before] != 32)
    at = np.flatnonzero(lone)
    if len(at):
        s, stop = start[at] + 1, end[at + 1]
        c0, c1 = cp[s], np.where(s + 1 < stop, cp[np.minimum(s + 1, n - 1)], 0)
        took = np.where(np.isin(c0, [ord(x) for x in ENDINGS if len(x) == 1]), 1, 0)
        for x in ENDINGS:
            if len(x) == 2:
                took = np.where((took == 0) & (c0 == ord(x[0])) & (c1 == ord(x[1])), 2, took)
        s, stop, took = s[took > 0], stop[took > 0], took[took > 0]
        keep[s] = False
        rest = s + took
        keep[rest[rest < stop]] = True
    return lead[keep]


def _pack(*numbers: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays below 2**32, each as four planes of bytes, most of which are nearly empty, and a tail."""
    planes = [np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbers]
    return zlib.compress(np.array([len(x) for x in numbers], "<u4").tobytes() + b"".join(planes) + tail, 1)


def _unpack(data: bytes, arrays: int) -> tuple:
    """The arrays and the tail that :func:`_pack` took."""
    raw = zlib.decompress(data)
    at, out = 4 * arrays, []
    for n in np.frombuffer(raw, "<u4", arrays).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, -1).T).view("<u4").ravel())
        at += 4 * n
    return (*out, raw[at:])


def _chunk(buf: np.ndarray, offsets: np.ndarray, ids: pa.Array, chunk: int, want: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk: its distinct words, one row per bucket of their hashes, or its documents.

    Words are compared by their bytes; a hash only deals them to buckets. They are in the order of their
    buckets; documents refer to them in the order of how often they occur (to a power of two), so that
    indices are small. The row ``MARK`` has those powers.
    """
    starts = split(buf, offsets)
    found, codes = distinct(buf, starts, np.append(starts[1:], len(buf)))
    words, n = found.to_pylist(), len(found)
    bucket = np.array([zlib.crc32(w) for w in words], np.int64) >> (32 - bits)
    dealt = np.argsort(bucket, kind="stable")
    if want == "words":
        cut = np.searchsorted(bucket[dealt], np.arange((1 << bits) + 1)).tolist()
        some = [k for k in range(1 << bits) if cut[k] < cut[k + 1]]
        own = [[words[i] for i in dealt[cut[k] : cut[k + 1]].tolist()] for k in some]
        yield _rows(chunk, some, n, ids.type, [None] * len(some), [_pack(np.array([len(w) for w in x]), tail=b"".join(x)) for x in own])
        return
    power = np.frexp(np.bincount(codes, minlength=n))[1][dealt]
    place = np.empty(n, np.int64)
    place[dealt[np.argsort(-power, kind="stable")]] = np.arange(n)
    index, cut = place[codes], np.searchsorted(starts, offsets)
    yield _rows(chunk, [MARK], n, ids.type, [None], [_pack(power)])
    for no, (i, j) in enumerate(blocks(cut, GROUP)):
        yield _rows(chunk, [MARK + 1 + no], n, ids.type, [ids[i:j].to_pylist()], [_pack(np.diff(cut[i : j + 1]), index[cut[i] : cut[j]])])


def _rows(chunk: int, no: list[int], words: int, kind: pa.DataType, ids: list, payload: list[bytes]) -> pa.RecordBatch:
    m = len(no)
    return pa.RecordBatch.from_arrays([pa.array([chunk] * m, pa.int64()), pa.array(no, pa.int32()), pa.array([words] * m, pa.int32()), pa.array(ids, pa.list_(kind)), pa.array(payload, pa.binary())], names=["chunk", "no", "words", "ids", "payload"])


def _name(buf: np.ndarray, offsets: np.ndarray, ids: pa.Array) -> int:
    """A chunk's name follows from its content, so that both passes over the input give the same."""
    h = hashlib.blake2b(buf, digest_size=8)
    h.update(offsets.tobytes())
    h.update(repr(ids.to_pylist()).encode())
    return int.from_bytes(h.digest(), "little", signed=True)


def _splitter(chunk_bytes: int, want: str, bits: int):
    """Chunks of a partition. ``want``: 'words' or 'documents', the other kind is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = flat(batch.column(1))
            for i, j in blocks(off, chunk_bytes):
                part, own, ids = buf[off[i] : off[j]], off[i : j + 1] - off[i], batch.column(0)[i:j]
                yield from _chunk(part, own, ids, _name(part, own, ids), want, bits)

    return run


def _encoder(path: str, pattern: str):
    """Buckets of words, sorted by bucket -> the words' numbers of ids and the ids. A word is always in
    the same bucket, so each distinct word of the corpus is encoded once; a task remembers ``KNOWN`` words
    of a bucket at a time, beyond which a word may be encoded again, to the same ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bucket, known = _encoding(path, pattern)._core_bpe, None, {}
        for batch in batches:
            out = []
            for no, payload in zip(batch.column("no").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if no != bucket:
                    bucket, known = no, {}
                size, data = _unpack(payload, 1)
                stop = np.cumsum(size.astype(np.int64)).tolist()
                found = []
                for a, b in zip([0, *stop[:-1]], stop, strict=True):
                    w = data[a:b]
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        ids = known[w] = enc.encode_single_piece(w)
                    found.append(ids)
                out.append(_pack(np.array([len(x) for x in found]), np.array([i for x in found for i in x], np.int64)))
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(out, pa.binary()))

    return run


def _assembler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's words, in order, then its documents: ids by position."""
    chunk, parts, last, sizes, begin, table = None, [], -1, None, None, None
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for c, no, words, ids, payload in zip(*(batch.column(x).to_pylist() for x in ("chunk", "no", "words", "ids", "payload")), strict=True):
            if c != chunk:
                chunk, parts, last, table = c, [], -1, None
            if no <= MARK:
                if no == last:  # the input holds the same rows again
                    continue
                last = no
                if no < MARK:
                    parts.append(_unpack(payload, 2)[:2])
                    continue
                sizes = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]).astype(np.int64)
                power = _unpack(payload, 1)[0].astype(np.int64)
                if len(sizes) != words or len(power) != words:
                    raise RuntimeError(f"chunk {c} has {len(sizes)} of {words} words: the input's order isn't repeatable")
                table = np.concatenate([np.zeros(0, "<u4"), *(p[1] for p in parts)]).astype("<u4")
                order = np.argsort(-power, kind="stable")
                begin = (np.cumsum(sizes) - sizes)[order]
                sizes, parts = sizes[order], []
                continue
            if table is None:
                raise RuntimeError(f"chunk {c} lacks its words")
            count, index, _ = _unpack(payload, 2)
            n = sizes[index]
            flat_ids = table[np.repeat(begin[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            upto = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(count.astype(np.int64))))].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([flat_ids[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary())], names=["id", "ids"])


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20, bucket_bits: int | None = None) -> DataFrame:
    """``(id_col, ids, n_tokens)``: ``ids`` is binary, little-endian unsigned 32-bit integers.

    Special tokens are ordinary text. ``ranks_path`` must be readable on the executors, and
    ``pattern`` must be the one that :func:`split` implements. The buckets of words, each a unit of work, are
    so many that follow from the number of documents, unless ``bucket_bits`` is given.
    """
    bits = bucket_bits if bucket_bits is not None else min(MOST_BITS, LEAST_BITS + (df.count() // DOCUMENTS).bit_length())
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("payload", T.BinaryType())])
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = source.mapInArrow(released(_splitter(chunk_bytes, "words", bits)), schema)
    documents = source.mapInArrow(released(_splitter(chunk_bytes, "documents", bits)), schema)
    encoded = words.repartition("no").sortWithinPartitions("no").mapInArrow(released(_encoder(ranks_path, pattern)), schema)
    together = encoded.union(documents).repartition("chunk").sortWithinPartitions("chunk", "no")
    out = together.mapInArrow(released(_assembler), T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType())]))
    return out.select(F.col("id").alias(id_col), "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        table: list = [None] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [None if x is None else b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ``ids`` as :func:`encode` makes them; null stays null.
    An id outside the table is an error."""
    return df.mapInArrow(released(_decoder(ranks_path)), T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))
