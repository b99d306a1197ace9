"""Embedding near-duplicates by product quantisation, within a label.

Equal vectors of a label are one class. Coarse centroids and residual codebooks are learned from a
bounded sample; each class lies in the inverted list of its nearest centroid with a code per subspace
and the length of what the code leaves out. A class asks every list that can hold a vector within
the radius: list c is left out only if the plane between c and the class's own centroid is farther
than the radius. In a list, table-lookup distances drop a member only if its distance to the coded
point exceeds the radius by more than the code's own error; the rest are compared by exact cosine.
Both bounds are inequalities of geometry, so no link is lost, whatever the data.

Lists that follow each other in a fixed order are a region, of about ``BLOCK`` members in the largest label. A
task holds a region of a label, lists and codes, and the classes that ask any of its lists pass by once. So
a class travels once as a member, and once for each region that it asks: all of them where vectors have no
structure, few where they have. A region with more members is cut into blocks, each with its own copy of the
queries, so a label's members beyond ``BLOCK`` are sent m / ``BLOCK`` times if nothing tells them apart. A block
returns sums per class and a spanning forest of its links, never its pairs.

Rows: null, zero and non-finite vectors, null labels and null ids link with nothing (a null id has a
null component and is kept); vectors of different lengths do not link; rows that repeat are vectors
of their own; extra columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import saved
from .vectors import from_bytes, kmeans, matrix, sample, unit, valid

#: Vectors that centroids and codebooks are learned from, at most.
SAMPLE = 8192
#: Members of a block, queries compared at once, lists at most, sampled vectors of a list at least.
BLOCK, BATCH, LISTS, LEAST = 16_384, 256, 1024, 8
SUBSPACES, CODES = 8, 256
#: Slack of the bounds, for rounding.
SLACK = 1e-7


@dataclass
class Quantiser:
    """Centroids, in an order in which neighbours follow each other, the region of each, and codebooks."""

    dim: int
    coarse: np.ndarray
    region: np.ndarray
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]

    def assign(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Own list, lists to ask, codes, and lengths left out, of unit vectors."""
        c = self.coarse
        d = (c * c).sum(axis=1)[None] - 2 * x @ c.T
        own = d.argmin(axis=1)
        rows = np.arange(len(x))
        apart = np.sqrt(np.maximum(((c[own][:, None] - c[None]) ** 2).sum(axis=2), 1e-300))
        far = (d - d[rows, own][:, None]) / (2 * apart)
        far[rows, own] = 0
        ask = [np.flatnonzero(f <= radius + SLACK) for f in far]
        rest = x - c[own]
        codes, left = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, a:b]
            e = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None] - 2 * part @ book.T
            codes[:, m] = e.argmin(axis=1)
            left += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return own, ask, codes, np.sqrt(left)

    def distances(self, q: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Of each query to each coded member of a list, by table lookup."""
        rest = q - self.coarse[lst]
        total = np.zeros((len(q), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, a:b]
            table = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None] - 2 * part @ book.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def fit(vectors: np.ndarray, dim: int, lists: int, regions: int, seed: int = 0) -> Quantiser:
    x = unit(vectors) if len(vectors) else np.zeros((1, max(dim, 1)))
    coarse = kmeans(x, lists, seed=seed)
    own = ((coarse * coarse).sum(axis=1)[None] - 2 * x @ coarse.T).argmin(axis=1)
    main = np.linalg.svd(coarse - coarse.mean(axis=0), full_matrices=False)[2][0]
    order = np.argsort(coarse @ main, kind="stable")
    size = np.bincount(own, minlength=len(coarse))[order]
    region = ((np.cumsum(size) - size) * regions // max(1, size.sum())).astype(np.int32)
    rest = x - coarse[own]
    edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return Quantiser(dim, coarse[order], region, cuts, [kmeans(rest[:, a:b], min(CODES, len(x)), 6, seed) for a, b in cuts])


def _assigner(model: Quantiser, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                flat_values, off = matrix(part.column("v"))
                n = part.num_rows
                dims = np.diff(off)
                own, ask, code, err = np.zeros(n, np.int32), [[0]] * n, [b""] * n, np.full(n, 1e9)
                home, to = np.zeros(n, np.int32), [[0]] * n
                fits = np.flatnonzero(dims == model.dim)
                if len(fits):
                    x = unit(np.stack([flat_values[off[i] : off[i + 1]] for i in fits]))
                    o, a, c, e = model.assign(x, radius)
                    own[fits], err[fits], home[fits] = o, e, model.region[o]
                    for k, i in enumerate(fits.tolist()):
                        ask[i], code[i], to[i] = a[k].tolist(), c[k].tobytes(), np.unique(model.region[a[k]]).tolist()
                raw = [flat_values[off[i] : off[i + 1]].astype("<f8").tobytes() for i in range(n)]
                rest = [part.column(c) for c in ("h1", "h2", "rep", "n", "label")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(dims.astype(np.int32)), pa.array(home), pa.array(to, pa.list_(pa.int32())), pa.array(own), pa.array(ask, pa.list_(pa.int32())), pa.array(code, pa.binary()), pa.array(err), pa.array(raw, pa.binary())], names=["h1", "h2", "rep", "n", "label", "dim", "region", "regions", "list", "ask", "code", "err", "x"])

    return run


class _Cell:
    """Members of one block, by list, and the forest of the links found so far."""

    def __init__(self, model: Quantiser, dim: int):
        self.model, self.dim = model, dim
        self.parts: list[tuple] = []
        self.ready = False

    def add(self, b: pa.RecordBatch) -> None:
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        self.parts.append((unit(from_bytes(b.column("x"), self.dim)), code, *(b.column(c).to_numpy() for c in ("err", "rep", "n", "h1", "h2", "list"))))

    def _close(self, q: np.ndarray, ask: list[list[int]], radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) that the lists asked and the coded distances leave."""
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not self.code.shape[1]:  # of another length than most: no codes
            return np.repeat(np.arange(len(q)), len(self.x)), np.tile(np.arange(len(self.x)), len(q))
        who = np.repeat(np.arange(len(q)), [len(a) for a in ask])
        lists = np.array([x for a in ask for x in a], np.int64)
        for k, lst in enumerate(self.names.tolist()):
            rows, lo, hi = who[lists == lst], self.cut[k], self.cut[k + 1]
            if len(rows):
                near = self.model.distances(q[rows], lst, self.code[lo:hi]) - self.err[None, lo:hi] <= radius + SLACK
                a, b = np.nonzero(near)
                i.append(rows[a])
                j.append(lo + b)
        i, j = np.concatenate(i), np.concatenate(j)
        order = np.argsort(i, kind="stable")
        return i[order], j[order]

    def links(self, b: pa.RecordBatch, least: float, radius: float) -> Iterator[tuple]:
        """(h1, h2, members linked) and (a, b) edges of a batch of queries."""
        if not self.ready:
            parts = [np.concatenate(p) for p in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0)] * 8
            order = np.argsort(parts[-1], kind="stable")
            self.x, self.code, self.err, self.rep, self.n, self.h1, self.h2, lists = (p[order] for p in parts)
            self.names, cut = np.unique(lists, return_index=True)
            self.cut, self.ready, self.root = np.append(cut, len(order)), True, np.arange(len(order))
        if not len(self.x):
            return
        q, rep, h1, h2 = unit(from_bytes(b.column("x"), self.dim)), b.column("rep").to_numpy(), b.column("h1").to_numpy(), b.column("h2").to_numpy()
        i, j = self._close(q, b.column("ask").to_pylist(), radius)
        keep = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", q[i[k : k + 65536]], self.x[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536))])
        i, j = i[keep], j[keep]
        other = (h1[i] != self.h1[j]) | (h2[i] != self.h2[j])
        i, j = i[other], j[other]
        sums = np.bincount(i, weights=self.n[j], minlength=len(q)).astype(np.int64)
        some = np.flatnonzero(sums)
        edges = []
        stop = np.searchsorted(i, some, "right")
        for row, a, z in zip(some.tolist(), np.searchsorted(i, some).tolist(), stop.tolist(), strict=True):
            roots, first = np.unique(self.root[j[a:z]], return_index=True)
            edges += [(int(rep[row]), int(self.rep[m])) for m in j[a:z][first]]
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
        yield h1[some], h2[some], sums[some], edges


def _prober(model: Quantiser, least: float, radius: float):
    """Rows sorted by (label, dim, region, block, kind): kind 0 members, then kind 1 queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        names = ["h1", "h2", "links", "a", "b"]
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "region", "block", "kind")), strict=True))
            cut = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo][:4] != now:
                    now = keys[lo][:4]
                    cell = _Cell(model, now[1])
                for k in range(lo, hi, BATCH):
                    part = batch.slice(k, min(BATCH, hi - k))
                    if keys[lo][4] == 0:
                        cell.add(part)
                        continue
                    for h1, h2, sums, edges in cell.links(part, least, radius):
                        m, e = len(h1), len(edges)
                        a = pa.array([x[0] for x in edges], pa.int64())
                        b = pa.array([x[1] for x in edges], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(sums), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                        yield pa.RecordBatch.from_arrays([pa.nulls(e, pa.int64()), pa.nulls(e, pa.int64()), pa.nulls(e, pa.int64()), a, b], names=names)

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, seed: int = 0) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per input row; ``least`` is the cosine of a link."""
    radius = float(np.sqrt(2 * (1 - least)))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & valid("v")
    hashed = base.select("id", "label", F.when(ok, F.col("v")).alias("v")).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "label", "v")})
    live = hashed.where("v is not null")
    classes = saved(live.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    per = classes.groupBy("label").count()
    total, labels, most = per.agg(F.sum("count"), F.count("*"), F.max("count")).first()
    dim, vectors = sample(classes, "h1", "v", total or 0, SAMPLE)
    lists = int(np.clip(np.ceil(((total or 0) / max(1, labels)) ** 0.5), 1, min(LISTS, max(1, len(vectors) // LEAST))))
    model = fit(vectors, dim, lists, -(-(most or 1) // BLOCK), seed)
    label = classes.schema["label"].dataType.simpleString()
    schema = f"h1 long, h2 long, rep long, n long, label {label}, dim int, region int, regions array<int>, list int, ask array<int>, code binary, err double, x binary"
    placed = saved(classes.mapInArrow(_assigner(model, radius), schema), "lists")
    place = ["label", "dim", "region"]
    sizes = placed.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    columns = [*place, "block", "kind", "h1", "h2", "rep", "n", "list", "ask", "code", "err", "x"]
    members = placed.withColumn("ask", F.lit(None).cast("array<int>")).join(sizes, place).withColumns({"block": F.pmod("h2", "blocks").cast("int"), "kind": F.lit(0)})
    queries = placed.withColumns({"region": F.explode("regions"), "code": F.lit(None).cast("binary")}).join(sizes, place).withColumns({"block": F.explode(F.expr("sequence(0, blocks - 1)")), "kind": F.lit(1)})
    cells = members.select(*columns).union(queries.select(*columns)).repartition(*place, "block").sortWithinPartitions(*place, "block", "kind")
    found = saved(cells.mapInArrow(_prober(model, least, radius), "h1 long, h2 long, links long, a long, b long"), "links")
    linked = found.where("links is not null").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a is not null").select("a", "b"))
    named = classes.select("h1", "h2", "rep", "n").join(linked, ["h1", "h2"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = hashed.select("id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2")).join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
