"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts by recursive spectral bisection with
swaps; their number grows with the root of the rows, up to ``PARTS``. A small network learns in which parts
a vector's neighbours lie. It places every row of the index in its most probable part, and sends a query to
as many of its most probable parts as held the target recall, less a standard error, on a held-out part of
the sample; the rows found there are ranked by exact cosine.

A part is searched in tiles: a task holds up to ``HELD`` of its queries and lets up to ``STREAM`` of its rows
pass, keeping the best k of each query. So a row is copied once per ``HELD`` queries of its part, and a query
once per ``STREAM`` rows.

Rows: null, zero and non-finite vectors and null ids take no part; vectors of another length than
most meet all vectors of their own length; a query's own id is no candidate; rows that repeat are
candidates each; extra columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .vectors import from_bytes, matrix, sample, scaled, unit, valid

#: Vectors that the parts and the network are learned from, at most.
SAMPLE = 16_384
#: Parts at most, sampled vectors of a part at least.
PARTS, LEAST = 512, 24
#: Queries that a task holds, rows that it lets pass, and those of either that are compared at once.
HELD, STREAM, QUERIES, ROWS = 16_384, 262_144, 1024, 1024
NEIGHBOURS, HIDDEN, EPOCHS, TARGET = 10, 96, 20, 0.93


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -2
        out[lo : lo + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Part of each node; sizes differ by a few. ``parts`` is a power of two."""
    r = np.random.default_rng(seed)
    label = np.zeros(len(near), np.int64)
    for _ in range(int(parts).bit_length() - 1):
        fresh = label * 2
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            inside = np.full(len(near), -1)
            inside[own] = np.arange(len(own))
            nb = inside[near[own]]
            there = nb >= 0
            v = r.standard_normal(len(own))
            for _ in range(30):  # second eigenvector of the smoothed graph
                pull = np.where(there, v[np.maximum(nb, 0)], 0).sum(axis=1)
                back = np.bincount(nb[there], weights=np.repeat(v[:, None], nb.shape[1], 1)[there], minlength=len(own))
                v = v + (pull + back) / nb.shape[1]
                v -= v.mean()
                v /= np.abs(v).max() or 1
            side = np.zeros(len(own), np.int64)
            side[np.argsort(v, kind="stable")[len(own) // 2 :]] = 1
            for _ in range(4):  # swap the nodes that gain most on either side
                sign = 2 * side - 1
                pull = np.where(there, sign[np.maximum(nb, 0)], 0).sum(axis=1) + np.bincount(nb[there], weights=np.repeat(sign[:, None], nb.shape[1], 1)[there], minlength=len(own))
                gain = -sign * pull
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
                m = min(len(a), len(b), max(1, len(own) // 20))
                good = (gain[a[:m]] + gain[b[:m]]) > 0
                side[a[:m][good]], side[b[:m][good]] = 1, 0
            fresh[own] += side
        label = fresh
    return label


@dataclass
class Router:
    """A network of one hidden layer over unit vectors, and the number of parts to probe."""

    dim: int
    parts: int
    weights: list[np.ndarray]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def _train(x: np.ndarray, goal: np.ndarray, seed: int) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    d, p = x.shape[1], goal.shape[1]
    w = [r.standard_normal((d, HIDDEN)) * (2 / d) ** 0.5 * d**0.5 / 2, np.zeros(HIDDEN), r.standard_normal((HIDDEN, p)) * HIDDEN**-0.5, np.zeros(p)]
    m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for lo in range(0, len(order), 128):
            b = order[lo : lo + 128]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - goal[b]) / len(b)
            dh = (dz @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return w


def fit(vectors: np.ndarray, dim: int, rows: int, k: int, target: float = TARGET, seed: int = 0) -> Router:
    """A router for ``rows`` rows, learned from a sample; the last tenth of it only sets the probes."""
    wish = np.ceil(np.log2(max(1.0, rows**0.5)))
    parts = 1 << int(np.clip(min(wish, np.floor(np.log2(max(1.0, len(vectors) / LEAST)))), 0, np.log2(PARTS)))
    if parts == 1:
        return Router(dim, 1, [np.zeros((max(dim, 1), 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    x = unit(vectors)
    held = x[-max(50, len(x) // 10) :]
    x = x[: len(x) - len(held)]
    near = _graph(x, NEIGHBOURS)
    label = balanced_parts(near, parts, seed)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), label), NEIGHBOURS / 2)
    for c in range(NEIGHBOURS):
        np.add.at(goal, (np.arange(len(x)), label[near[:, c]]), 1)
    router = Router(dim, parts, _train(x, goal / goal.sum(axis=1, keepdims=True), seed), parts)
    home = router.logits(x).argmax(axis=1)
    true = np.argsort(-(held @ x.T), axis=1)[:, :k]
    order = np.argsort(-router.logits(held), axis=1)
    place = np.argsort(order, axis=1)
    at = np.take_along_axis(place, home[true], axis=1)
    for n in range(1, parts + 1):
        hit = (at < n).mean()
        if hit - (hit * (1 - hit) / at.size) ** 0.5 >= target:
            router.probes = n
            break
    return router


def _placer(router: Router, sizes: dict[int, int] | None, k: int):
    """(id, v) -> (id, dim, parts, x): the part of a row, or with ``sizes`` the parts of a query, more
    of them while they hold too few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                values, off = matrix(part.column("v"))
                n, dims = part.num_rows, np.diff(off)
                to: list[list[int]] = [[0]] * n
                fits = np.flatnonzero(dims == router.dim)
                if len(fits):
                    order = np.argsort(-router.logits(unit(np.stack([values[off[i] : off[i + 1]] for i in fits]))), axis=1, kind="stable")
                    for row, i in zip(order.tolist(), fits.tolist(), strict=True):
                        if sizes is None:
                            to[i] = row[:1]
                            continue
                        m, held = router.probes, sum(sizes.get(p, 0) for p in row[: router.probes])
                        while m < len(row) and held < k + 1:
                            held += sizes.get(row[m], 0)
                            m += 1
                        to[i] = row[:m]
                raw = [values[off[i] : off[i + 1]].astype("<f8").tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(dims.astype(np.int32)), pa.array(to, pa.list_(pa.int32())), pa.array(raw, pa.binary())], names=["id", "dim", "parts", "x"])

    return run


class _Tile:
    """Queries of a tile and the k nearest of each among the rows that have passed."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, keys: list[np.ndarray], k: int):
        self.unit, self.q, self.ids, self.keys, self.k = unit(q), scaled(q), ids, keys, k
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        self.score, self.found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Rows that pass. What the rough product lets through is compared by its exact cosine."""
        ux, sx = unit(x), scaled(x)
        nx = np.sqrt((sx * sx).sum(axis=1))
        for lo in range(0, len(self.q), QUERIES):
            hi = min(lo + QUERIES, len(self.q))
            rough = self.unit[lo:hi] @ ux.T
            i, j = np.nonzero((rough >= self.score[lo:hi, -1:] - 1e-9) & (self.ids[lo:hi, None] != ids[None]))
            if not len(i):
                continue
            exact = np.concatenate([np.einsum("ij,ij->i", sx[j[a : a + 65536]], self.q[lo + i[a : a + 65536]]) for a in range(0, len(i), 65536)]) / (nx[j] * self.norm[lo + i])
            rows = np.unique(i)
            who = np.concatenate((i, np.repeat(rows, self.k)))
            score, found = np.concatenate((exact, self.score[lo + rows].ravel())), np.concatenate((ids[j], self.found[lo + rows].ravel()))
            order = np.lexsort((found, -score, who))
            first = np.searchsorted(who[order], rows)
            best = order[first[:, None] + np.arange(self.k)]
            self.score[lo + rows], self.found[lo + rows] = score[best], found[best]

    def rows(self) -> pa.RecordBatch:
        i, c = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), *(pa.array(h[i]) for h in self.keys), pa.array(self.found[i, c]), pa.array(self.score[i, c])], names=["q", "h1", "h2", "id", "score"])


def _searcher(k: int):
    """Rows sorted by (dim, part, qtile, rtile, kind, id): kind 0 the tile's queries, then kind 1 rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tile = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "part", "qtile", "rtile", "kind")), strict=True))
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo][:4] != now:
                    if tile is not None:
                        yield tile.rows()
                    now, held, tile = keys[lo][:4], [], None
                for a in range(lo, hi, ROWS):
                    part = batch.slice(a, min(ROWS, hi - a))
                    x, i = from_bytes(part.column("x"), now[0]), part.column("id").to_numpy()
                    if keys[lo][4] == 0:
                        held.append((x, i, part.column("h1").to_numpy(), part.column("h2").to_numpy()))
                        continue
                    if tile is None and held:
                        q, ids, h1, h2 = (np.concatenate(c) for c in zip(*held, strict=True))
                        held, tile = [], _Tile(q, ids, [h1, h2], k)
                    if tile is not None:
                        tile.add(x, i)
        if tile is not None:
            yield tile.rows()

    return run


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, target: float = TARGET, seed: int = 0) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each row where ``queries`` holds (an expression over
    ``df``), its nearest rows of ``df``; ties go to the smaller id."""
    ok = df.where(F.col(id_col).isNotNull() & valid(vector_col))
    rows = ok.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = ok.where(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropDuplicates()
    total = rows.count()
    dim, vectors = sample(rows.withColumn("h", F.xxhash64("id", "v")), "h", "v", total, SAMPLE)
    router = fit(vectors, dim, total, k, target, seed)
    schema = "id long, dim int, parts array<int>, x binary"
    index = saved(rows.mapInArrow(_placer(router, None, k), schema), "index").withColumn("part", F.col("parts")[0])
    counts = index.groupBy("dim", "part").count()
    held = {r["part"]: r["count"] for r in counts.where(F.col("dim") == dim).collect()}  # at most PARTS rows
    sent = saved(asked.mapInArrow(_placer(router, held, k), schema), "queries").withColumn("part", F.explode("parts"))
    tiles = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = counts.join(sent.groupBy("dim", "part").agg(F.count("*").alias("asked")), ["dim", "part"]).select("dim", "part", tiles("asked", HELD).alias("across"), tiles("count", STREAM).alias("down"))
    dealt = lambda n: F.pmod(F.xxhash64("id", "x"), n).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    columns = ["dim", "part", "qtile", "rtile", "kind", "id", "h1", "h2", "x"]
    none = F.lit(0).cast("long")
    members = index.join(sizes, ["dim", "part"]).withColumns({"rtile": dealt("down"), "kind": F.lit(1), "h1": none, "h2": none}).withColumn("qtile", every("across"))
    asking = sent.join(sizes, ["dim", "part"]).withColumns({"qtile": dealt("across"), "kind": F.lit(0), "h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")}).withColumn("rtile", every("down"))
    place = columns[:4]
    cells = asking.select(*columns).union(members.select(*columns)).repartition(*place).sortWithinPartitions(*place, "kind", "id")
    found = cells.mapInArrow(_searcher(k), "q long, h1 long, h2 long, id long, score double")
    best = Window.partitionBy("q", "h1", "h2").orderBy(F.desc("score"), "id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
