"""What both vector operators need: valid rows, a bounded sample, clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import flat


def valid(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    v = f"`{vector}`"
    return F.expr(f"coalesce({v} is not null and size({v}) > 0 and forall({v}, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists({v}, e -> e <> 0), false)")


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of a list column without nulls, one after the other, and row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.float64), off - off[0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over their largest absolute component: a cosine stays, and no square overflows."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def from_bytes(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(flat(column)[0].tobytes(), np.float64).reshape(-1, dim)


def sample(df: DataFrame, key: str, vector: str, rows: int, most: int) -> tuple[int, np.ndarray]:
    """About ``most`` of ``rows`` vectors, by a bound on their hash, of the most frequent length: that
    length and the vectors. No more than ``most`` are used."""
    share = min(1.0, most / max(1, rows))
    got = df.where(F.pmod(F.col(key), F.lit(1 << 30)) < int(share * (1 << 30))).select(key, vector).toPandas()
    if not len(got):
        return 0, np.zeros((0, 0))
    dims = got[vector].map(len)
    dim = int(dims.mode().min())
    got = got[dims == dim].sort_values(key, kind="stable").head(most)
    return dim, np.stack([np.asarray(v, np.float64) for v in got[vector]])


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids; fewer if there are fewer different rows."""
    r = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    c = start[r.permutation(len(start))[:k]]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c
