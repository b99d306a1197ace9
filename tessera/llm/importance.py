"""Quality by importance resampling: hashed n-gram generative models of target and raw text.

A document's log weight is the sum over its word n-grams (one and two words, A-Z lower-cased) of the
log ratio of the n-gram's bucket under the target model to that under the raw model. The raw model
counts every document; the target model counts those that a bounded sample of labelled ids marks
(``max_labels``) and is smoothed by the raw one. Documents are drawn without replacement, in proportion to
their weights: the k largest sums of log weight and standard Gumbel noise. Unless given, k is the share of
targets among all labelled documents times the number of documents with words, so that the sample is as
large as the target part of the corpus.

Rows: texts without words (null, empty) have no weight and are never drawn; documents that share an
id share their noise, and so do those without one; documents that tie at the k-th sum are all drawn; extra
columns may have any name; an empty table gives an empty result; without a labelled target every text with
words is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, U64, blocks, flat, shingles, span_hashes, words
from .memory import released

BLOCK = 1 << 20
#: Labelled ids that the target model is made from, at most; the table of them is broadcast (9 bytes an id).
MAX_LABELS = 60_000
BUCKETS = 1 << 14


def _grams(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-word n-grams, and the row of each."""
    low = LOWER[buf]
    starts, ends, count = words(low, offsets)
    h = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(count)), count)
    two, own = shingles(h, count, 2)
    row2 = np.repeat(np.arange(len(count)), own)
    pair = np.repeat(count > 1, own)
    both = np.concatenate((h, two[pair]))
    return (both >> U64(64 - buckets.bit_length() + 1)).astype(np.int64), np.concatenate((row, row2[pair]))


def _counter(buckets: int):
    """(text, is_target) -> per task the buckets' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off, _ = flat(batch.column(0))
            marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in blocks(off, BLOCK):
                b, row = _grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[marked[i:j][row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def _scorer(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = flat(batch.column(1))
            for i, j in blocks(off, BLOCK):
                b, row = _grams(buf[off[i] : off[j]], off[i : j + 1] - off[i], len(ratio))
                n = np.bincount(row, minlength=j - i)
                weight = np.bincount(row, weights=ratio[b], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n.astype(np.int64)), pa.array(np.where(n > 0, weight, np.nan), from_pandas=True, type=pa.float64())], names=["id", "n_grams", "log_weight"])

    return run


def targets(labels: DataFrame, id_col: str, target: Column, max_labels: int = MAX_LABELS) -> tuple[DataFrame, float | None]:
    """A sample ``(_t)`` of at most ``max_labels`` labelled targets, those with the lowest hashes, by a bound on the
    hash; and the share of targets among all labelled ids, None if there is no target."""
    ids = labels.where(F.col(id_col).isNotNull() & target.isNotNull()).groupBy(F.col(id_col).alias("_t")).agg(F.max(target).alias("_good"))
    total, good = ids.agg(F.count("*"), F.count_if("_good")).first()
    few = ids.where("_good").withColumn("_h", F.pmod(F.xxhash64(F.lit(3), "_t"), F.lit(1 << 30)))
    bound = 1.0 if good <= max_labels else max(0.0, (max_labels - 4 * max_labels**0.5) / good)
    return few.where(F.col("_h") < int(bound * (1 << 30))).select("_t").limit(max_labels), good / total if good else None


def fit(df: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smooth: float = 0.3, prior: float = 10.0) -> np.ndarray:
    """Log ratio of each bucket; ``sample`` as from :func:`targets`. The target model takes the raw one with the
    weight of ``smooth`` of its own n-grams and ``prior`` n-grams a bucket. ``buckets`` sums reach the driver."""
    marked = df.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), F.col("_i") == F.col("_t"), "left")
    counts = marked.select("text", F.col("_t").isNotNull().alias("target")).mapInArrow(released(_counter(buckets)), "bucket long, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    weight = smooth * target.sum() + prior * buckets
    return np.log((target + weight * p) / (target.sum() + weight)) - np.log(p)


def score(df: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_grams, log_weight)``; the weight of a text without words is null."""
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(_scorer(ratio)), f"id {kind}, n_grams long, log_weight double")
    return out.withColumnRenamed("id", id_col)


def noise(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise of an id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def cut(keys: DataFrame, k: int, bins: int = 1024, few: int = 1000) -> float | None:
    """The k-th largest of the finite ``key`` values, exactly: counts of equal bins narrow the range
    until ``few`` values are left in it, no row is moved. None if there are no more than k."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= k:
        return None
    if k <= 0:
        return float("inf")
    inside, above = n, 0  # values in [low, high], and beyond high
    while inside > few and low < high:
        step = (high - low) / bins
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        found = keys.where(F.col("key").between(F.lit(low), F.lit(high))).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect()
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high, inside = r["low"], r["high"], r["n"]
    if low == high:
        return low
    rest = keys.where(F.col("key").between(F.lit(low), F.lit(high))).groupBy("key").count().orderBy(F.desc("key")).limit(few + 1).collect()
    for r in rest:
        above += r["count"]
        if above >= k:
            return r["key"]
    raise RuntimeError("keys changed between reads")


def resample(weighted: DataFrame, id_col: str = "doc_id", share: float | None = None, k: int | None = None, seed: int = 0) -> DataFrame:
    """Adds ``key`` and ``selected``: Gumbel top-k, k by default ``share`` of the rows that have a weight, all without
    a share. ``weighted`` is read several times and should be a table."""
    keyed = weighted.withColumn("key", F.col("log_weight") + noise(id_col, seed))
    if k is None and share is not None:
        k = int(share * weighted.where("log_weight is not null").count() + 0.5)
    bound = None if k is None else cut(keyed.select("key"), k)
    chosen = F.col("key").isNotNull() if bound is None else F.col("key") >= F.lit(bound)
    return keyed.withColumn("selected", F.coalesce(chosen, F.lit(False)))
