"""Byte codecs as Column expressions: integers, key shortening, block entries, hash, Bloom filter.

Integers are given as upper-case hex. Keys, text or binary, are taken byte by byte: a key is read as a
string with one character per byte, so that no expression meets a character of several bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import ordered

#: Seed and multiplier of the byte hash, bits per key of a filter, probes, and the
#: restart interval of blocks.
SEED, MULTIPLIER, BITS_PER_KEY, PROBES, RESTART = 0xBC9F1D34, 0xC6A4A793, 10, 6, 16
MASK = 0xFFFFFFFF


def varint_length(v: str) -> Column:
    """Bytes of a non-negative integer, 7 bits a byte."""
    return F.expr(f"size(filter(sequence(1, 9), i -> i = 1 or {v} >= shiftleft(1L, 7 * (i - 1))))")


def varint_hex(v: str) -> Column:
    """Low 7 bits first, the top bit set on all bytes but the last."""
    return F.expr(_varint(v))


def varint_decode(h: str) -> Column:
    """The integer at the start of hex bytes; null if they end inside it."""
    byte = f"cast(conv(substr({h}, 2 * i - 1, 2), 16, 10) as bigint)"
    ends = f"array_min(filter(sequence(1, greatest(1, length({h}) div 2)), i -> length({h}) >= 2 * i and {byte} < 128L))"
    return F.expr(f"if({ends} is null or {ends} > 9, null, aggregate(sequence(1, {ends}), 0L, (a, i) -> a + shiftleft({byte} & 127L, 7 * (i - 1))))")


def fixed_hex(v: str, size: int) -> Column:
    """Little-endian bytes; null if the value takes more of them."""
    return F.expr(f"if(length(hex({v})) > {2 * size}, null, array_join(reverse(transform(sequence(1, {size}), i -> substr(lpad(hex({v}), {2 * size}, '0'), 2 * i - 1, 2))), ''))")


def fixed_decode(h: str, size: int) -> Column:
    return F.expr(f"cast(conv(array_join(reverse(transform(sequence(1, {size}), i -> substr({h}, 2 * i - 1, 2))), ''), 16, 10) as bigint)")


def trailer_hex(seq: str, kind: str) -> Column:
    """The eight bytes after a key: its kind, then the 56 bits of its sequence, little-endian; null for a larger one."""
    return F.concat(fixed_hex(kind, 1), fixed_hex(seq, 7))


def trailer_decode(h: str) -> Column:
    """Sequence and kind of a trailer; a kind other than the two is null."""
    kind = F.conv(F.expr(f"left({h}, 2)"), 16, 10).cast("int")
    return F.struct(fixed_decode(f"substr({h}, 3)", 7).alias("seq"), F.when(kind.isin(0, 1), kind).alias("vtype"))


def slice_hex(h: str) -> Column:
    """A length-prefixed slice: the length as a variable-length integer, then the bytes ``h``."""
    n = f"cast(length({h}) div 2 as bigint)"
    return F.concat(F.expr(f"transform(array({n}), n -> {_varint('n')})[0]"), F.expr(h))


def slice_decode(h: str) -> Column:
    """The bytes of the slice at the start of ``h``, null if it ends before them."""
    cut = f"get(filter(sequence(1, 5), i -> length({h}) >= 2 * i and conv(substr({h}, 2 * i - 1, 2), 16, 10) < 128), 0)"
    n = varint_decode(h)
    body = F.expr(f"substr({h}, 2 * {cut} + 1)")
    return F.when(F.length(body) >= 2 * n, F.substr(body, F.lit(1), (2 * n).cast("int")))


def _varint(v: str) -> str:
    n = f"size(filter(sequence(1, 9), i -> i = 1 or {v} >= shiftleft(1L, 7 * (i - 1))))"
    byte = f"(shiftright({v}, 7 * (i - 1)) & 127L) + if(i < {n}, 128L, 0L)"
    return f"array_join(transform(sequence(1, {n}), i -> lpad(hex({byte}), 2, '0')), '')"


def octets(k: str) -> str:
    """SQL for the bytes of a key as characters."""
    return f"decode(cast({k} as binary), 'ISO-8859-1')"


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _two(a: str, b: str) -> str:
    return f"named_struct('a', {octets(a)}, 'b', {octets(b)})"


def _common(a: str, b: str) -> str:
    """SQL for the number of equal characters at the start of two strings."""
    n = f"least(length({a}), length({b}))"
    differs = f"array_position(transform(sequence(1, {n}), i -> substr({a}, i, 1) = substr({b}, i, 1)), false)"
    return f"if({n} = 0, 0, {let(differs, 'p', f'if(p = 0, {n}, cast(p - 1 as int))')})"


def shared_prefix(a: str, b: str) -> str:
    """SQL for the bytes that two keys have in common at their start."""
    return let(_two(a, b), "t", _common("t.a", "t.b"))


def separator(a: str, b: str) -> Column:
    """A short key in [a, b), as binary: the byte after the common prefix plus one, if that stays below b's."""
    x, y = (f"ascii(substr(t.{c}, d + 1, 1))" for c in "ab")
    short = f"if(d < least(length(t.a), length(t.b)) and {x} + 1 < {y}, concat(left(t.a, d), chr({x} + 1)), t.a)"
    return F.expr(f"encode({let(_two(a, b), 't', let(_common('t.a', 't.b'), 'd', short))}, 'ISO-8859-1')")


def successor(a: str) -> Column:
    """A short key at or above ``a``, as binary: its first byte below 255 plus one, and nothing after it."""
    short = "if(d = length(t), t, concat(left(t, d), chr(ascii(substr(t, d + 1, 1)) + 1)))"
    full = "length(t) - length(ltrim(chr(255), t))"
    return F.expr(f"encode({let(octets(a), 't', let(full, 'd', short))}, 'ISO-8859-1')")


def shortened_seq(key: str, short: str, seq: str) -> Column:
    """The sequence of a shortened internal key: the largest one if the key lost bytes, so that it sorts first."""
    return F.expr(f"if(octet_length({short}) < octet_length({key}), {2**56 - 1}L, {seq})")


def block_entries(rows: DataFrame, interval: int = RESTART) -> DataFrame:
    """Keys of one sorted run -> bytes shared with the key before, or none at a restart point, of which there
    is one every ``interval`` keys of the whole run."""
    out = ordered(rows).withColumn("restart", F.col("n") % interval == 0)
    shared = F.when(F.col("restart"), 0).otherwise(F.expr(shared_prefix("k", "coalesce(prev, '')")))
    return out.withColumn("shared", shared).withColumn("unshared", F.octet_length("k") - F.col("shared")).drop("n", "prev", "nxt")


def _times(h: str) -> str:
    """32-bit product, in halves so that no step leaves 64 bits."""
    return f"(({h} * {MULTIPLIER & 0xFFFF}L + shiftleft(({h} * {MULTIPLIER >> 16}L) & 65535L, 16)) & {MASK}L)"


def byte_hash(k: str, seed: int = SEED) -> Column:
    """32-bit hash of the bytes of ``k``: words of four bytes, then the rest."""
    byte = lambda at: f"cast(ascii(substr(s, {at}, 1)) as bigint)"
    n = "length(s)"
    word = " + ".join(f"shiftleft({byte(f'4 * i + {j + 1}')}, {8 * j})" for j in range(4))
    mixed = lambda value, shift: let(value, "x", let(_times("x"), "m", f"m ^ shiftright(m, {shift})"))
    words = f"aggregate(if({n} < 4, cast(array() as array<int>), sequence(0, greatest(0, {n} div 4 - 1))), {seed}L ^ {_times(f'cast({n} as bigint)')}, (h, i) -> {mixed(f'(h + {word}) & {MASK}L', 16)})"
    rest = " + ".join(f"if({n} % 4 > {j}, shiftleft({byte(f'({n} div 4) * 4 + {j + 1}')}, {8 * j}), 0L)" for j in range(3))
    return F.expr(let(octets(k), "s", let(words, "g", f"if({n} % 4 = 0, g, {mixed(f'(g + {rest}) & {MASK}L', 24)})")))


def shard(h: Column) -> Column:
    """Cache shard of a hash: its top four bits."""
    return F.shiftright(h, 28).cast("int")


def _bits(keys: DataFrame, bits: str) -> DataFrame:
    h = keys.withColumn("_h", byte_hash("k"))
    step = "(shiftright(_h, 17) | (shiftleft(_h, 15) & 4294967295L))"
    return h.withColumn("bit", F.explode(F.expr(f"transform(sequence(0, {PROBES - 1}), i -> ((_h + i * {step}) & {MASK}L) % {bits})"))).drop("_h")


def bloom_build(keys: DataFrame, by: str) -> DataFrame:
    """``keys(by, k)`` -> per group its number of bits and the 64-bit words that have any."""
    sizes = keys.groupBy(by).agg(F.expr(f"(greatest(64L, count(*) * {BITS_PER_KEY}) + 7) div 8 * 8").alias("bits"))
    words = _bits(keys.join(sizes, by), "bits").groupBy(by, F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    return words.join(sizes, by)


def bloom_match(keys: DataFrame, filters: DataFrame, by: str) -> DataFrame:
    """``keys(by, k)`` -> with ``may_match``: false only for keys that the group cannot hold."""
    sizes = filters.groupBy(by).agg(F.max("bits").alias("bits"))
    probes = _bits(keys.join(sizes, by), "bits").withColumn("word", F.expr("bit div 64"))
    hit = probes.join(filters.select(by, "word", "mask"), [by, "word"], "left")
    ok = F.expr("coalesce(mask & shiftleft(1L, cast(bit % 64 as int)), 0L) <> 0")
    return hit.groupBy(by, "k").agg(F.bool_and(ok).alias("may_match"))
