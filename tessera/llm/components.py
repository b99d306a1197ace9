"""Connected components of a distributed edge table by alternating large and small stars.

Each round is a pair of min-aggregations and joins on the edge table alone, and its result is
written to the shared folder; nothing but a count and two sums reaches the driver. A hub with any number of
edges is aggregated map-side and its join is an ordinary one that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, saved


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node with an edge to another one; the
    component is its smallest node. Loops, repeats and nulls are ignored."""
    e = saved(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(rounds if mark[0] else 0):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, saved(small.union(low).distinct(), "edges")
        discard(old)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _mark(e: DataFrame) -> tuple:
    """Count and two sums of hashes of the edges, by which a round that changed nothing is known: then every
    node points to its root."""
    h = lambda k: F.sum(F.pmod(F.xxhash64(F.lit(k), "u", "v"), F.lit(1 << 40)))
    return tuple(e.agg(F.count("*"), h(1), h(2)).first())
