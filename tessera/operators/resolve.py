"""Reads of an operation log: which version of a key is visible, in what order, and what may go.

A key's newest version with seq <= snapshot decides; if it is a tombstone the key has no row. The
version is chosen before tombstones are dropped: the other order would bring deleted keys back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import covering

#: Kinds of operations and the largest sequence.
DELETE, INSERT = 0, 1
MAX_SEQ = 2**56 - 1


def normalized(log: DataFrame) -> DataFrame:
    """An empty value is a deletion, and a deletion has no value."""
    empty = F.coalesce(F.col("v"), F.lit("")) == ""
    return log.withColumn("vtype", F.when(empty, DELETE).otherwise(F.col("vtype"))).withColumn("v", F.when(F.col("vtype") == INSERT, F.col("v")))


def first_of_duplicates(log: DataFrame, order: str = "pos") -> DataFrame:
    """An operation whose key and sequence exist already is ignored."""
    w = Window.partitionBy("k", "seq").orderBy(order)
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible operation of each key, tombstones included."""
    seen = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    w = Window.partitionBy("k").orderBy(F.desc("seq"))
    return seen.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The state: newest versions that are no tombstones."""
    return newest(log, snapshot).where(F.col("vtype") == INSERT)


def deleted(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return newest(log, snapshot).where(F.col("vtype") == DELETE)


def get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    """One row, or none if the key was deleted or never written. The filter reaches the scan."""
    seen = log.where(F.col("k") == key)
    seen = seen if snapshot is None else seen.where(F.col("seq") <= snapshot)
    return seen.orderBy(F.desc("seq")).limit(1).where(F.col("vtype") == INSERT)


def multi_get(log: DataFrame, keys: list[str], snapshot: int | None = None) -> DataFrame:
    return latest(log.where(F.col("k").isin(keys)), snapshot)


def scan(log: DataFrame, low: str | None = None, high: str | None = None, snapshot: int | None = None) -> DataFrame:
    """The state of keys in [low, high]; the bounds apply before versions are resolved."""
    rows = log if low is None else log.where(F.col("k") >= low)
    return latest(rows if high is None else rows.where(F.col("k") <= high), snapshot)


def seek(log: DataFrame, target: str, snapshot: int | None = None) -> DataFrame:
    """The first live entry at or after ``target``."""
    return scan(log, low=target, snapshot=snapshot).orderBy("k").limit(1)


def first_n(log: DataFrame, n: int) -> DataFrame:
    return latest(log).orderBy("k").limit(n)


def last_n(log: DataFrame, n: int) -> DataFrame:
    return latest(log).orderBy(F.desc("k")).limit(n)


def history(log: DataFrame) -> DataFrame:
    """Versions in internal order: key ascending, sequence descending; ``version`` 1 is the newest."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq"))).cast("long"))


def merge(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs as one: an entry with the same key and sequence in several runs comes from the
    earliest of them. Adds ``run``, the place of the run it came from."""
    rows = None
    for i, run in enumerate(runs):
        run = run.withColumn("run", F.lit(i))
        rows = run if rows is None else rows.unionByName(run)
    if rows is None:
        raise ValueError("no runs")
    return first_of_duplicates(rows, "run")


def collectable(log: DataFrame, snapshot: int) -> DataFrame:
    """Adds ``dropped``: a version goes when the next newer one of its key is visible at the oldest snapshot."""
    newer = F.lag("seq").over(Window.partitionBy("k").orderBy(F.desc("seq")))
    return log.withColumn("dropped", F.coalesce(newer <= snapshot, F.lit(False)))


def compacted(log: DataFrame, snapshot: int) -> DataFrame:
    return collectable(log, snapshot).where(~F.col("dropped")).drop("dropped")


def elide_tombstones(rows: DataFrame, deeper: DataFrame, snapshot: int) -> DataFrame:
    """Drops tombstones at or below the snapshot that hide nothing: no file of a deeper level holds
    their key. A file's range stands for its keys, as the data itself isn't read."""
    old = rows.where((F.col("vtype") == DELETE) & (F.col("seq") <= snapshot)).select("k", "seq")
    hides = covering(old, deeper).select("k", "seq").distinct().withColumn("_hides", F.lit(True))
    out = rows.join(hides, ["k", "seq"], "left")
    return out.where((F.col("vtype") == INSERT) | (F.col("seq") > snapshot) | F.col("_hides")).drop("_hides")

