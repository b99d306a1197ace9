"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order; a row's fractional rank is its place in that
order over its source's size. All rows sorted by fractional rank form a sequence in which any long
stretch has the sources in proportion, and shards are equal cuts of that sequence: row counts differ
by one at most. Only ids, sizes, checksums and keys are shuffled, never texts. Equal texts are rows like any
others: they may lie in different shards.

Rows: a null source is a stratum of its own; a null text counts as empty; rows that repeat are
placed each; null ids are placed like others; extra columns may have any name and are not carried;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import KEY_BITS, bucket_bits, ranked, uniform


def stratified_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot)``: slots count from 0 in each shard without gaps."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"),
        F.col(source_col).isNull().alias("s0"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s1"),
    ).withColumn("h", uniform(F.lit(seed), "id", "crc"))
    bits = bucket_bits(df.count())
    ties = ["id", "crc", "size"]
    one = ranked(rows, ["s0", "s1"], "h", ties, F.lit(0), F.shiftright("h", KEY_BITS - bits))
    one = one.select("id", "size", "crc", "s0", "s1", "h", ((2 * F.col("rank") + 1) / (2 * F.col("rows"))).alias("fraction")).withColumn("all", F.lit(0))
    two = ranked(one, ["all"], "fraction", ["s0", "s1", "h", *ties], F.lit(0), F.floor(F.col("fraction") * (1 << bits)))
    return _cut(two, shards).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _cut(df: DataFrame, shards: int) -> DataFrame:
    shard = F.expr(f"cast((rank * {shards}L) div rows as int)")
    first: Column = F.expr(f"(shard * rows + {shards - 1}L) div {shards}L")
    return df.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
