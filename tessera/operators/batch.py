"""Write batches: contiguous sequences, sizes, group commit and rotation of the write buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a batch header, and the caps of a commit group.
HEADER, GROUP_CAP, SMALL_LEADER = 12, 1 << 20, 128 << 10


def varint_length(col: str) -> str:
    """SQL for the bytes of a variable-length integer: 7 bits a byte."""
    return f"case when {col} < 128 then 1 when {col} < 16384 then 2 when {col} < 2097152 then 3 when {col} < 268435456 then 4 when {col} < 34359738368 then 5 when {col} < 4398046511104 then 6 when {col} < 562949953421312 then 7 when {col} < 72057594037927936 then 8 else 9 end"


def sized(log: DataFrame) -> DataFrame:
    """Adds ``bytes``: the tag, and key and value with their lengths; a deletion has no value."""
    n, m = "octet_length(k)", "octet_length(v)"
    value = f"if(vtype = 1, {varint_length(m)} + {m}, 0)"
    return log.withColumn("bytes", F.expr(f"cast(1 + {varint_length(n)} + {n} + {value} as bigint)"))


def expand(batches: DataFrame) -> DataFrame:
    """``(base, ops array<struct<k, vtype, v>>)`` -> operations with seq = base + position."""
    return batches.select("base", F.posexplode("ops").alias("pos", "op")).select((F.col("base") + F.col("pos")).alias("seq"), "op.k", "op.vtype", "op.v", "pos")


def collect(log: DataFrame) -> DataFrame:
    """Operations of a batch as one row with its base sequence; a batch is bounded by its writer."""
    ops = F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "vtype", "v"))), lambda x: F.struct(x["k"].alias("k"), x["vtype"].alias("vtype"), x["v"].alias("v")))
    return log.groupBy("batch_id").agg(F.min("seq").alias("base"), ops.alias("ops"))


def extend(batches: DataFrame, by: str) -> DataFrame:
    """``(by, base, ops)``: the batches of each group as one, in the order of their bases; it begins at the first."""
    parts = F.array_sort(F.collect_list(F.struct("base", "ops")))
    return batches.groupBy(by).agg(F.min("base").alias("base"), F.flatten(F.transform(parts, lambda x: x["ops"])).alias("ops"))


def stats(log: DataFrame) -> DataFrame:
    """Per batch: first and last sequence, count, bytes with the header."""
    return sized(log).groupBy("batch_id").agg(F.min("seq").alias("base"), F.max("seq").alias("last_seq"), F.count("*").alias("ops"), (F.sum("bytes") + HEADER).alias("bytes"))


def commit_group(batches: DataFrame, leader: int) -> DataFrame:
    """The batches, from ``leader`` on, that one log write takes: while the running size stays within the cap,
    and, if there is a column ``sync`` and the leader's is false, up to the first that wants it. A batch has
    a header at least, so only so many batches are looked at as headers fit in the cap."""
    cap = f"if(first_bytes <= {SMALL_LEADER}, first_bytes + {SMALL_LEADER}, {GROUP_CAP})"
    w = Window.orderBy("batch_id")
    queue = batches.where(F.col("batch_id") >= leader).orderBy("batch_id").limit(GROUP_CAP // HEADER + 2)
    sync = F.col("sync") if "sync" in batches.columns else F.lit(False)
    out = queue.withColumns({"running": F.sum("bytes").over(w), "first_bytes": F.first("bytes").over(w), "stops": F.max(sync).over(w) & ~F.first(sync).over(w)})
    return out.where(F.expr(f"(running <= {cap} and not stops) or batch_id = {leader}")).drop("first_bytes", "stops")


def rotations(log: DataFrame, buffer_bytes: int, stripes: int = 1) -> DataFrame:
    """The write buffer each operation lands in: by running bytes in the order of sequences."""
    charge = F.expr("bytes + 8")
    return running(sized(log).withColumn("charge", charge), "seq", "charge").withColumn("buffer", F.expr(f"cast((running - charge) div {buffer_bytes} as bigint)"))


def running(df: DataFrame, order: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Running sum over a dense integer order without one task for all rows: sums of stretches of
    ``width`` become offsets, and only a stretch is sorted together."""
    df = df.withColumn("_s", F.expr(f"{order} div {width}"))
    per = df.groupBy("_s").agg(F.sum(value).alias("_n"))
    ahead = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(ahead, "_s").withColumn("running", F.col("_before") + F.sum(value).over(w)).drop("_s", "_before")
