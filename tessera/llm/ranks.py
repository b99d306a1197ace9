"""Ranks and running sums inside strata of any size, with DataFrame functions only.

A row's key is uniform. Its leading bits name a bucket; per-bucket totals (at most strata x 2**bits rows)
become offsets, and only rows of one bucket of one stratum are sorted together. The number of bits
follows from that of the rows, so a stratum that holds a third of all rows is spread over as many groups as
keep each at a size that does not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a uniform key; rows of a bucket wanted; bits of a bucket, at least and at most.
KEY_BITS, ROWS, LEAST_BITS, MOST_BITS = 60, 1 << 17, 10, 24


def uniform(*parts: Column | str) -> Column:
    """A uniform key of ``KEY_BITS`` bits from the text of the parts, null as empty: the start of their MD5."""
    text = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *text)), 1, KEY_BITS // 4), 16, 10).cast("long")


def bucket_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (rows // ROWS).bit_length()))


def ranked(df: DataFrame, strata: list[str], key: str, ties: list[str], value: Column, bucket: Column) -> DataFrame:
    """Adds ``rank`` (from 0), ``before`` (sum of ``value`` in front of the row), ``rows`` and
    ``total`` (of the stratum). ``strata`` columns must not be null; ``bucket`` must not decrease
    with ``key``; rows equal in key and ties are interchangeable."""
    df = df.withColumn("_value", value.cast("long")).withColumn("_bucket", bucket)
    keys = [*strata, "_bucket"]
    per = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))
    upto = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*strata)
    offsets = per.select(*keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_sum0"), F.sum("_n").over(whole).alias("rows"), F.sum("_sum").over(whole).alias("total"))
    inside = Window.partitionBy(*keys).orderBy(key, *ties)
    out = df.join(offsets, keys).withColumn("rank", F.col("_n0") + F.row_number().over(inside) - 1)
    out = out.withColumn("before", F.col("_sum0") + F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value"))
    return out.drop("_value", "_bucket", "_n0", "_sum0")
