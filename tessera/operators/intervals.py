"""Order and intervals without a nested loop and without one task for all rows.

Keys are dealt to at most ``BUCKETS`` ranges, whose bounds are a uniform sample of the keys themselves; only
rows of one range are sorted together, and what a range needs from those before it (a count, a last row)
is a table of one row per range. The bounds are the only thing that the driver holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; a key's range is found in two steps of the square root of that.
STEP = 32
BUCKETS = STEP * STEP


@dataclass(frozen=True)
class Ranges:
    """Sorted bounds: a key is in the range numbered by how many bounds are at or below it."""

    bounds: list

    def of(self, key: Column) -> Column:
        if not self.bounds:
            return F.lit(0)
        pieces = [self.bounds[i : i + STEP] for i in range(0, len(self.bounds), STEP)]
        below = lambda values: F.size(F.filter(values, lambda b: b <= key))
        coarse = below(F.lit([p[0] for p in pieces]))
        inner = F.element_at(F.array(*[F.lit(p) for p in pieces]), F.greatest(coarse, F.lit(1)))
        return F.when(coarse == 0, 0).otherwise((coarse - 1) * STEP + below(inner)).cast("int")


def ranges(df: DataFrame, key: str, most: int = BUCKETS) -> Ranges:
    """Bounds from the keys with the smallest hashes: a uniform sample of different keys, the same in every run."""
    found = df.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(most - 1).collect()
    return Ranges(sorted(r["k"] for r in found))


def asof(rows: DataFrame, marks: DataFrame, over: Ranges, groups: list[str] | None = None) -> DataFrame:
    """Adds ``mark`` to ``rows(k, *groups, ...)``: that of the last of ``marks(k, *groups, mark)`` at or below
    ``k`` in its group, else null. ``mark`` is a struct."""
    groups = groups or []
    keys = [*groups, "_range"]
    placed = marks.select(*groups, "k", "mark").withColumn("_range", over.of(F.col("k")))
    ends = placed.groupBy(*keys).agg(F.max_by("mark", "k").alias("_end"))
    before = Window.partitionBy(*groups).orderBy("_range")
    # one row per range and group
    last = len(over.bounds)
    reach = ends.withColumn("_next", F.coalesce(F.lead("_range").over(before), F.lit(last))).where(F.col("_range") < last)
    reach = reach.select(*groups, "_end", F.explode(F.sequence(F.col("_range") + 1, F.col("_next"))).alias("_range"))
    every = rows.withColumn("_range", over.of(F.col("k"))).withColumn("_kind", F.lit(1)).unionByName(placed.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys).orderBy("k", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("_last", F.last("mark", ignorenulls=True).over(inside)).where("_kind = 1").drop("mark")
    return found.join(reach, keys, "left").withColumn("mark", F.coalesce("_last", "_end")).drop("_last", "_end", "_kind", "_range")


def covering(keys: DataFrame, files: DataFrame) -> DataFrame:
    """``keys(k, ...)`` with ``level, number`` of each file whose range holds ``k``. Files of a level below the
    first are disjoint, so a key's only candidate is the last one that starts at or below it; level 0,
    where an engine stops writers at a dozen runs, is joined range by range."""
    over = ranges(files, "smallest")
    files = files.select("level", "number", "smallest", "largest")
    deep = files.where("level > 0").select("level", F.col("smallest").alias("k"), F.struct("number", "largest").alias("mark"))
    asked = keys.withColumn("level", F.explode(F.lit(list(range(1, 7)))))
    below = asof(asked, deep, over, ["level"]).where("mark.largest >= k").select(*keys.columns, "level", F.col("mark.number").alias("number"))
    top = files.where("level = 0").withColumn("_range", F.explode(F.sequence(over.of(F.col("smallest")), over.of(F.col("largest")))))
    first = keys.withColumn("_range", over.of(F.col("k"))).join(top, "_range").where("k between smallest and largest")
    return below.unionByName(first.select(*keys.columns, "level", "number"))


def overlapping(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of ``left(id, smallest, largest, *on)`` and ``right(r_*)`` that agree in ``on`` and touch. A pair is
    made in one range only, the one in which the later of the two begins."""
    over = ranges(left.select("smallest").union(right.select("r_smallest")), "smallest")
    spread = lambda df, a, b: df.withColumn("_range", F.explode(F.sequence(over.of(F.col(a)), over.of(F.col(b)))))
    both = spread(left, "smallest", "largest").join(spread(right, "r_smallest", "r_largest"), [*on, "_range"])
    return both.where((F.col("smallest") <= F.col("r_largest")) & (F.col("largest") >= F.col("r_smallest")) & (over.of(F.greatest("smallest", "r_smallest")) == F.col("_range"))).drop("_range")


def ordered(df: DataFrame, key: str = "k") -> DataFrame:
    """Adds ``n`` (place from 0), ``prev`` and ``nxt`` (the keys beside it) in the order of ``key`` over all rows;
    keys differ."""
    over = ranges(df, key)
    placed = df.withColumn("_range", over.of(F.col(key)))
    inside = Window.partitionBy("_range").orderBy(key)
    line = Window.orderBy("_range")  # one row per range
    per = placed.groupBy("_range").agg(F.count("*").alias("_m"), F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    per = per.select("_range", F.coalesce(F.sum("_m").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"), F.lag("_hi").over(line).alias("_before"), F.lead("_lo").over(line).alias("_after"))
    out = placed.withColumns({"_r": F.row_number().over(inside), "_p": F.lag(key).over(inside), "_x": F.lead(key).over(inside)}).join(per, "_range")
    return out.withColumns({"n": F.col("_n0") + F.col("_r") - 1, "prev": F.coalesce("_p", "_before"), "nxt": F.coalesce("_x", "_after")}).drop("_range", "_n0", "_r", "_p", "_x", "_before", "_after")
