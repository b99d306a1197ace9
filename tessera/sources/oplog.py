"""Views of the driver's tables as an operation log, sorted runs and manifest edits.

An operation log has ``k string, seq bigint, vtype int (0 delete, 1 insert), v string, batch_id bigint``;
(k, seq) is unique. ``files`` describes sorted runs: ``level, number, smallest, largest, min_seq,
max_seq, entries, size``. ``edits`` are the manifest deltas that lead to such files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPLOG = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("vtype", T.IntegerType(), False), T.StructField("v", T.StringType()), T.StructField("batch_id", T.LongType())])
#: Operations of a batch in the views.
BATCH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: the user is the key, an error deletes."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("k"), (F.col("event_id") + 1).alias("seq"),
        F.when(gone, 0).otherwise(1).alias("vtype"), F.when(~gone, F.col("props")).alias("v"), F.expr(f"event_id div {BATCH}").alias("batch_id"),
    )


def orders_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of single versions."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("k"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(1).alias("vtype"), F.col("o_orderpriority").alias("v"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the run each operation lies in: level 0 has two runs a key range, deeper levels one."""
    log = oplog(spark, sf_dir).withColumn("level", (F.col("batch_id") % 4).cast("int"))
    part = F.expr("if(level = 0, (batch_id div 4) % 2, 0)")
    return log.withColumn("number", F.expr("level * 1000 + (cast(k as bigint) div (10 + 5 * level)) * 2 + 1") + part)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run its key range, sequences and bytes (keys, values and 8 bytes of trailer)."""
    return describe(placed(spark, sf_dir))


def describe(rows: DataFrame) -> DataFrame:
    """Zone map of the runs in ``rows(level, number, k, seq, v)``."""
    size = F.sum(F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0)) + 8)
    return rows.groupBy("level", "number").agg(F.min("k").alias("smallest"), F.max("k").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("entries"), size.alias("size"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run is added by an edit; edit 3 deletes a third of them and adds half of those again."""
    f = files(spark, sf_dir).select("level", "number")
    add = f.select((F.col("number") % 5 + 1).alias("edit_id"), F.lit(1).alias("is_add"), "level", "number")
    gone = f.where("number % 3 = 0").select(F.lit(3).cast("long").alias("edit_id"), F.lit(0).alias("is_add"), "level", "number")
    back = f.where("number % 6 = 0").select(F.lit(3).cast("long").alias("edit_id"), F.lit(1).alias("is_add"), "level", "number")
    return add.union(gone).union(back)
