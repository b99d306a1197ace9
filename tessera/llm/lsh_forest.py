"""Near-duplicates by MinHash and an LSH forest, confirmed on full shingle sets.

1. One pass over the texts gives each row its number of distinct shingles, a 128-bit digest of the
   set and a MinHash signature. Rows with equal sets are one class, named by its smallest id; the
   rest works on classes, so a group of copies of any size is aggregated map-side and then one row.
2. Each of ``orders`` sorted orders reads the signature from another place. In sorted order the
   neighbours of a class are those with the longest common prefix, of up to ``reach`` values: a class is paired with its next
   ``width`` rows if at least ``prefix`` values agree, or, where that region is crowded, as many values
   as leave a region of ``crowd`` rows; and with the head of its region of ``depth`` values. Pairs so grow
   in proportion to the rows; those whose set sizes rule out a link are not made. Orders are range-partitioned, a crowded region is cut anywhere; the rows at the
   partitions' edges are paired in a second small pass.
3. Pairs are confirmed on full sets of words, from the texts of the classes concerned: first for
   each class its best partner and its smallest, then those pairs whose classes are not yet connected.
4. The sweep makes the width no cap: in every region of ``prefix`` values with more rows than ``width``
   pairs exhaustively, the rows outside the region's largest component so far are compared with all its
   rows of other components, by their ``low`` smallest shingle hashes (of most texts the whole set; of all, if
   ``low`` is None); what may link is confirmed like the rest. So each two rows that share a region end
   connected if they link. A task holds some of those rows as an index from hashes to rows and lets the
   region's rows pass. Of a region with d such rows and m in all each row is sent max(64, d / ``HELD``) times at
   most, and each of the d 64 times; arithmetic grows with the pairs that share a hash.

Words are runs of anything but ASCII white space, A-Z lower-cased. Rows: texts without words (null,
empty) have empty sets and link with nothing; rows that share an id are one node; a row with a null id
links with nothing, has a null component and is kept; extra columns may have any name; an empty table
gives an empty result. Links are confirmed on the words themselves; sets are held for equal by a 128-bit
digest of their shingles' 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import LOWER, U64, blocks, distinct, exact_shingles, flat, shingles, span_hashes, words
from .memory import released
from .store import saved

#: Bytes of text worked on at once.
BLOCK = 1 << 20
#: Rows of an Arrow batch of texts or sets.
BATCH = 1000
#: Rows of the sieve table that is broadcast, at most: 64 bits each, 4 MB in all.
SIEVE = 1 << 18
#: Rows on each side of a tile of the sweep at least, those that it holds at most, and tiles along a side up to that;
#: rows that pass at once, and entries of the index that they meet.
SIDE, HELD, ALONG, PASS, HITS = 1024, 4096, 64, 128, 1 << 20
#: Hashed sets down to one part in so many below the bound are compared word by word.
NEAR = 20
#: Tasks among which the pairs of one text are dealt.
SPREAD = 256
#: Parts into which a region's rows are dealt where its figures are joined to them.
SALTS = 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes."""
    low = LOWER[buf]
    starts, ends, count = words(low, offsets)
    hashes, own = shingles(span_hashes(low, starts, ends), count, size)
    stop = np.cumsum(own)
    for a, b in zip((stop - own).tolist(), stop.tolist(), strict=True):
        part = np.sort(hashes[a:b])
        if b - a > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        yield part


def _permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, (k, 1), dtype=np.uint64) * U64(2) + U64(1), r.integers(0, 2**63, (k, 1), dtype=np.uint64)


def minhash(values: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """32-bit signature of a set of 64-bit hashes."""
    best = None
    for i in range(0, len(values), 512):
        part = (values[None, i : i + 512] * mult + add).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return (best >> U64(32)).astype(np.uint32)


def _sign(size: int, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _permutations(k, seed)
        for batch in batches:
            buf, off, _ = flat(batch.column(1))
            for i, j in blocks(off, BLOCK):
                n, digest, sig = [], [], []
                for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(minhash(s, mult, add).astype(">u4").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "digest", "sig"])

    return run


def _neighbours(prefix: int, depth: int, reach: int, width: int, crowd: int, per: int, of: int):
    """Rows sorted by (o, key, id) -> pairs (kind 0: a, b), the partition's edge rows (kind 1) and the
    regions of ``prefix`` values that hold more rows than are paired exhaustively (kind 2: o, key)."""
    names = ["kind", "o", "key", "n", "a", "b"]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        m = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)

    def edges(o: np.ndarray, keys: np.ndarray, n: np.ndarray, ids: np.ndarray, kind: int = 1) -> pa.RecordBatch:
        m = len(o)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(o.astype(np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n), pa.array(ids), pa.nulls(m, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o0, k0, n0, i0 = np.zeros(0, np.int32), np.zeros((0, reach), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        heads: dict[int, tuple[int, int, int]] = {}  # per depth: id and size of the region's head, rows since
        near = lambda x, y: of * np.minimum(x, y) >= per * np.maximum(x, y)  # noqa: E731  sets too unlike in size can't link
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            key = np.frombuffer(flat(batch.column("key"))[0], np.uint32).reshape(m, reach)
            o, n, ids = (batch.column(c).to_numpy() for c in ("o", "n", "id"))
            if not heads:
                yield edges(o[:width], key[:width], n[:width], ids[:width])
            h = len(o0)
            o, key, n, ids = np.concatenate((o0, o)), np.concatenate((k0, key)), np.concatenate((n0, n)), np.concatenate((i0, ids))
            at = np.arange(h, len(o))
            agree = np.zeros((m, depth), bool)  # with the row before
            x = at[at >= 1]
            agree[x - h] = (key[x, :depth] == key[x - 1, :depth]) & (o[x] == o[x - 1])[:, None]
            common = np.cumprod(agree, axis=1).sum(axis=1)
            need = np.full(m, depth)  # the depth at which a row's region is no crowd
            for d in range(depth, prefix - 1, -1):
                begin = np.maximum.accumulate(np.where(common < d, np.arange(m), -1))
                head, size, since = heads.get(d, (int(ids[h]), int(n[h]), 0))
                old, place = begin < 0, np.arange(m) - begin
                first = ids[h:][np.maximum(begin, 0)]
                first, size_of, place = np.where(old, head, first), np.where(old, size, n[h:][np.maximum(begin, 0)]), np.where(old, since + np.arange(m), place)
                far = (place > width) & (first != ids[h:]) & near(size_of, n[h:])
                if d == depth and far.any():
                    yield pairs(first[far], ids[h:][far])
                need[place <= crowd] = d
                full = place == width
                if d == prefix and full.any():  # a region cut by a partition's end has its mark on one side or in the pass over edges
                    yield edges(o[h:][full], key[h:][full, :prefix], n[h:][full], ids[h:][full], 2)
                heads[d] = int(first[-1]), int(size_of[-1]), int(place[-1]) + 1
            for lag in range(1, width + 1):
                x = at[at >= lag]
                equal = np.cumprod((key[x, :depth] == key[x - lag, :depth]) & (o[x] == o[x - lag])[:, None], axis=1).sum(axis=1)
                same = (equal >= need[x - h]) & (ids[x] != ids[x - lag]) & near(n[x], n[x - lag])
                if same.any():
                    yield pairs(ids[x[same] - lag], ids[x[same]])
            o0, k0, n0, i0 = o[-width:], key[-width:], n[-width:], ids[-width:]
        if len(o0):
            yield edges(o0, k0, n0, i0)

    return run


def candidates(classes: DataFrame, orders: int, prefix: int, depth: int, reach: int, width: int, crowd: int, per: int, of: int) -> tuple[DataFrame, DataFrame]:
    """``classes(id, n, sig)`` -> pairs ``(a, b, found)``, a < b, with the number of orders that found them,
    and the crowded regions ``(region)``."""
    key = f"substr(concat(sig, sig), o * {4 * prefix} + 1, {4 * reach})"
    forest = classes.select("id", "n", F.explode(F.expr(f"transform(sequence(0, {orders - 1}), o -> named_struct('o', o, 'key', {key}))")).alias("x")).select(F.col("x.o").cast("int").alias("o"), "x.key", "n", "id")
    schema = "kind byte, o int, key binary, n long, a long, b long"
    walk = _neighbours(prefix, depth, reach, width, crowd, per, of)
    found = saved(forest.repartitionByRange("o", "key", "id").sortWithinPartitions("o", "key", "id").mapInArrow(released(walk), schema), "forest")
    borders = found.where("kind = 1").select("o", "key", "n", F.col("a").alias("id")).distinct()
    # a few rows per partition of the pass before
    more = saved(borders.coalesce(1).sortWithinPartitions("o", "key", "id").mapInArrow(released(walk), schema), "borders")
    both = found.union(more)
    return both.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("found")), both.where("kind = 2").select(F.xxhash64("o", "key").alias("region")).distinct()


def _sieved(df: DataFrame, wanted: DataFrame, col: str = "id", bits: int = SIEVE) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be in ``wanted(col)``: one hash into a bitmap of at most
    ``SIEVE`` rows of 64 bits, whatever the number of values. It only spares a later join; it decides nothing."""
    h = F.xxhash64(col)
    mark = F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({col}), 32) & 63L as int))")
    word = F.pmod(h, F.lit(bits))
    table = wanted.select(word.alias("_w"), mark.alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_m"))
    return df.withColumns({"_w": word, "_b": mark}).join(F.broadcast(table), "_w").where("(_m & _b) <> 0").drop("_w", "_m", "_b")


def _lowest(size: int, low: int | None):
    """Texts -> number of shingles and the ``low`` smallest of their hashes, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = flat(batch.column(1))
            for i, j in blocks(off, BLOCK):
                sets = list(shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:low].tobytes() for s in sets], pa.binary())], names=["id", "n", "low"])

    return run


class _Tile:
    """Strays of a region, as an index from shingle hashes."""

    def __init__(self, batches: list[pa.RecordBatch], per: int, of: int, low: int | None):
        self.per, self.of = per, of
        self.least = per / of - 5 * (per / of * (1 - per / of) / (low or 1)) ** 0.5
        self.ids, self.comp, self.n, self.count, values = (np.concatenate(c) for c in zip(*map(self.parts, batches), strict=True))
        order = np.argsort(values, kind="stable")
        self.values, self.rows = values[order], np.repeat(np.arange(len(self.ids), dtype=np.int32), self.count)[order]
        self.sets = np.split(values, np.cumsum(self.count)[:-1])

    @staticmethod
    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Ids, components, set sizes, known hashes and those hashes, one row after the other."""
        buf, off, _ = flat(batch.column("low"))
        return (*(batch.column(c).to_numpy() for c in ("id", "component", "n")), np.diff(off) // 8, np.frombuffer(buf.tobytes(), U64))

    def parts_of(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in runs of rows that meet at most ``HITS`` entries of the index, or of one row."""
        values, count = self.parts(batch)[4], self.parts(batch)[3]
        hits = np.searchsorted(self.values, values, "right") - np.searchsorted(self.values, values, "left")
        met = np.concatenate(([0], np.cumsum(hits)))[np.concatenate(([0], np.cumsum(count)))]
        for i, j in blocks(met, HITS):
            yield batch.slice(i, j - i)

    def pairs(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Strays and passing rows of other components that may link: exactly those that do where both sets are
        whole, else those within five standard deviations of the bound on the hashes that both know."""
        ids, comp, n, count, values = self.parts(batch)
        lo, hi = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        hits = hi - lo
        at = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
        row = np.repeat(np.repeat(np.arange(len(ids)), count), hits)
        key, common = np.unique(row * len(self.ids) + self.rows[at], return_counts=True)
        r, x = key // len(self.ids), key % len(self.ids)
        keep = (comp[r] != self.comp[x]) & (ids[r] != self.ids[x])
        r, x, common = r[keep], x[keep], common[keep]
        union = count[r] + self.count[x] - common
        ok = self.of * common >= self.per * union
        part = np.flatnonzero((n[r] > count[r]) | (self.n[x] > self.count[x]))
        begin = np.cumsum(count) - count
        for k in part.tolist():
            mine, theirs = values[begin[r[k]] : begin[r[k]] + count[r[k]]], self.sets[x[k]]
            top = min(mine[-1] if n[r[k]] > count[r[k]] else U64(2**64 - 1), theirs[-1] if self.n[x[k]] > self.count[x[k]] else U64(2**64 - 1))
            known = int(np.searchsorted(mine, top, "right") + np.searchsorted(theirs, top, "right") - common[k])
            ok[k] = common[k] >= self.least * known
        return np.minimum(ids[r[ok]], self.ids[x[ok]]), np.maximum(ids[r[ok]], self.ids[x[ok]])


def _sweep(low: int | None, per: int, of: int):
    """Rows sorted by (region, x, y, kind): kind 0 a tile's strays, then kind 1 the rows that pass -> pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tile = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("region", "x", "y", "kind")), strict=True))
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo][:3] != now:
                    now, held, tile = keys[lo][:3], [], None
                if keys[lo][3] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if tile is None and held:
                    tile, held = _Tile(held, per, of, low), []
                for k in range(lo, hi, PASS) if tile is not None else ():
                    for part in tile.parts_of(batch.slice(k, min(PASS, hi - k))):
                        a, b = tile.pairs(part)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def stray_pairs(classes: DataFrame, texts: DataFrame, regions: DataFrame, components: DataFrame, orders: int, prefix: int, size: int, low: int | None, per: int, of: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``classes(id, sig)`` that share one of ``regions``, lie in different
    ``components(node, component)`` and may link: one of the two is outside the region's largest component.
    Regions go by a 64-bit hash; two that share it are swept as one."""
    key = f"transform(sequence(0, {orders - 1}), o -> xxhash64(o, substr(sig, o * {4 * prefix} + 1, {4 * prefix})))"
    dealt = classes.select("id", F.explode(F.expr(key)).alias("region"))
    crowded = _sieved(dealt, regions, "region").join(components.select(F.col("node").alias("id"), "component"), "id", "left")
    crowded = saved(crowded.select("region", "id", F.coalesce("component", "id").alias("component")), "crowded")
    parts = crowded.groupBy("region", "component").agg(F.count("*").alias("m")).join(regions, "region", "left_semi")
    figures = parts.groupBy("region").agg(F.max_by("component", F.struct("m", -F.col("component"))).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m")).where("m > most")
    tiles = lambda rows, most: F.ceil(F.expr(rows) / F.greatest(F.lit(SIDE), F.least(F.lit(most), F.ceil(F.expr(rows) / ALONG)))).cast("int")
    figures = figures.select("region", "main", tiles("m", 2**62).alias("across"), tiles("m - most", HELD).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = saved(crowded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(figures, ["region", "salt"]), "swept")
    lowest = _sieved(texts, rows.select("id")).select("id", "text").mapInArrow(released(_lowest(size, low)), "id long, n long, low binary")
    side = lambda hashed, out_of: F.pmod(F.xxhash64(F.col("id"), F.lit(hashed)), F.col(out_of)).cast("int")
    every = lambda out_of: F.explode(F.sequence(F.lit(0), F.col(out_of) - 1))
    held = ["region", "id", "component"]
    all_rows = rows.select(*held, F.lit(1).alias("kind"), side(1, "across").alias("x"), every("down").alias("y"))
    strays = rows.where("component <> main").select(*held, F.lit(0).alias("kind"), every("across").alias("x"), side(2, "down").alias("y"))
    place = ["region", "x", "y"]
    dealt = all_rows.unionByName(strays).join(lowest, "id").select(*place, "kind", "id", "component", "n", "low").repartition(*place).sortWithinPartitions(*place, "kind")
    return dealt.mapInArrow(released(_sweep(low, per, of)), "a long, b long").distinct()


def exact_jaccard(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the shingle sets of two columns' texts, row by row, from the
    words themselves."""
    n = len(left)
    buf, off, _ = flat(pa.concat_arrays([left, right]))
    low = LOWER[buf]
    starts, ends, count = words(low, off)
    codes, own = exact_shingles(distinct(low, starts, ends)[1], count, size)
    most = int(codes.max(initial=0)) + 1
    keys = np.unique(np.repeat(np.arange(2 * n), own) * most + codes)  # sorted by row
    cut = np.searchsorted(keys, n * most)
    sizes = np.bincount(keys // most, minlength=2 * n)
    both = np.intersect1d(keys[:cut], keys[cut:] - n * most, assume_unique=True)
    common = np.bincount(both // most, minlength=n)
    return common, sizes[:n] + sizes[n:] - common


def _confirm(size: int, per: int, of: int):
    """Pairs with both texts -> those with ``of`` * intersection >= ``per`` * union. Pairs whose hashed sets are
    farther apart than ``NEAR`` below the bound go first; the rest is decided by the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            for i, j in blocks(flat(ta)[1] + flat(tb)[1], BLOCK):
                left, right = ta[i:j], tb[i:j]
                buf, off, _ = flat(pa.concat_arrays([left, right]))
                sets = list(shingle_sets(buf, off, size))
                near = np.zeros(j - i, bool)
                for r, (s, t) in enumerate(zip(sets[: j - i], sets[j - i :], strict=True)):
                    if of * min(len(s), len(t)) >= (per - of / NEAR) * max(len(s), len(t)):
                        both = np.sort(np.concatenate((s, t)))
                        common = int((both[1:] == both[:-1]).sum())
                        near[r] = common > 0 and of * common >= (per - of / NEAR) * (len(both) - common)
                some = batch.slice(i, j - i).select(["a", "b"]).filter(pa.array(near))
                if some.num_rows:
                    common, union = exact_jaccard(left.filter(pa.array(near)), right.filter(pa.array(near)), size)
                    yield some.filter(pa.array((of * common >= per * union) & (common > 0)))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, per: int, of: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that hold on the full sets of ``texts(id, text)``, word by word. A text that many
    pairs begin with goes to them in ``SPREAD`` copies at most, dealt by the other id, so no task has all of them."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int").alias("salt"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    some = _sieved(texts, wanted).select("id", "text")
    left = some.join(dealt.select(F.col("a").alias("id"), "salt").distinct(), "id").select(F.col("id").alias("a"), "salt", F.col("text").alias("ta"))
    both = dealt.join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "salt"])
    return both.select("a", "b", "ta", "tb").mapInArrow(released(_confirm(size, per, of)), "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per: int = 80, of: int = 100,
    orders: int = 20, prefix: int = 4, depth: int = 6, reach: int = 16, width: int = 3, crowd: int = 32, low: int | None = 1024, seed: int = 7,
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row per input row. Rows link if
    ``of * intersection >= per * union``. With 20 orders of prefix 4 a pair at a similarity of 0.8
    escapes all of them with a probability below 0.0001."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = saved(texts.mapInArrow(released(_sign(words, orders * prefix, seed)), "id long, n long, digest binary, sig binary"), "signatures", BATCH)
    known = signed.where("n > 0 and id is not null")
    classes = saved(known.groupBy("digest").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("n", "sig"))), "classes")
    pairs, regions = candidates(classes, orders, prefix, depth, reach, width, crowd, per, of)
    pairs = saved(pairs, "pairs")
    texts = texts.where("id is not null")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("found", -F.col("a"))).alias("x"), F.min("a").alias("y"))
    best = saved(best.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"), "best")
    first = saved(confirmed(best, texts, words, per, of), "links", BATCH)
    known_so_far = connected_components(first)
    side = lambda c: known_so_far.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = saved(rest.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "rest")
    joined = saved(connected_components(first.union(saved(confirmed(rest, texts, words, per, of), "links", BATCH))), "joined")
    strays = stray_pairs(classes, texts, regions, joined, orders, prefix, words, low, per, of)
    strays = saved(confirmed(saved(strays, "strays", BATCH), texts, words, per, of), "links", BATCH)
    links = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(strays)
    copies = known.select("id", "digest").join(classes.select("digest", F.col("id").alias("rep")), "digest").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = _attach(links, copies)
    out = signed.select("id", "n").join(found.select(F.col("node").alias("id"), F.col("component")), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def _attach(links: DataFrame, copies: DataFrame) -> DataFrame:
    """Components of links and copies together: copies hang on their class, which is enough unless
    an id has several texts; then all edges count alike."""
    copies = saved(copies.distinct(), "copies")
    if copies.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").isEmpty() and copies.join(copies.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and copies.join(links.select("a").union(links.select("b")).distinct(), "a", "left_semi").isEmpty():
        roots = connected_components(links)
        hung = copies.join(roots.select(F.col("node").alias("b"), "component"), "b", "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
        return roots.union(hung)
    return connected_components(links.union(copies))
