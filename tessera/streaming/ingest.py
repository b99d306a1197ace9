"""Streams of operations: into a store, and as a running state.

No watermark is needed: sequences are given at ingest, so nothing is late. The state holds one row a
key and so grows with the distinct keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import running
from ..sources.store import Store


def read_ops(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder's Parquet files of that name as a stream; ``files_per_batch`` is the back-pressure."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(ops: DataFrame, store: Store, checkpoint: str, source: str, order: str = "seq") -> None:
    """Applies ``ops(k, v, order)`` batch by batch until the source is exhausted. A batch that is
    delivered again is not applied again: its id is committed with it."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        low = batch.agg(F.min(order)).first()[0]
        if low is not None:
            dense = running(batch.withColumn("_one", F.lit(1)), order, "_one").withColumn("pos", F.col("running") - 1)
            store.write_frame(dense.select("k", "v", "pos"), "pos", source, batch_id)

    ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_latest(ops: DataFrame) -> DataFrame:
    """Streaming state: per key its newest operation (update or complete mode)."""
    return ops.groupBy("k").agg(F.max_by(F.struct("seq", "vtype", "v"), "seq").alias("op")).select("k", "op.seq", "op.vtype", "op.v")
