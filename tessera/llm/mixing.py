"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected in [0, 1] so
that the mixture meets a target entropy or a repetition limit. A source's token budget is then made
of blocks: each block is a seeded permutation of the source's documents; whole blocks first, and of
the last one the longest prefix that fits. A prefix of a permutation by hash is a bound on the hash,
so documents are chosen and repeated where they are: texts are never shuffled, and read once for their
tokens. Tokens come from a column, or are taken as a fourth of the text's UTF-8 bytes, which holds for scripts
with and without spaces alike; shares of sources differ little by that from shares of real tokens.

Rows: more than ``MAX_SOURCES`` sources are an error; a null source is a source of its own; a null text or
number of tokens is none; documents that share an id
share their place in every permutation; extra columns are kept, under any name that does not begin
with ``_mix_``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import KEY_BITS, bucket_bits, ranked, uniform
from .store import saved

#: More sources than this are refused: the table of sources is held on the driver and broadcast.
MAX_SOURCES = 100_000
#: UTF-8 bytes of a token.
TOKEN_BYTES = 4
PLAN = T.StructType([T.StructField("_mix_s0", T.BooleanType()), T.StructField("_mix_s1", T.StringType()), T.StructField("_mix_full", T.LongType()), T.StructField("_mix_rest", T.LongType())])


@dataclass(frozen=True)
class Mixture:
    """alpha, and per source its tokens, weight and token budget. A null source has the key None."""

    alpha: float
    tokens: dict[str | None, int]
    weights: dict[str | None, float]
    budgets: dict[str | None, int]


def weights_at(tokens: dict, alpha: float) -> dict:
    total = sum(tokens.values())
    raw = {k: (v / total) ** alpha if v else 0.0 for k, v in tokens.items()}
    norm = sum(raw.values())
    return {k: v / norm for k, v in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w)


def solve(tokens: dict, target_entropy: float | None = None, max_repeat: float | None = None, budget: int | None = None) -> Mixture:
    """The flattest mixture within the limits. Without ``budget`` it is as large as needed for each
    source to be taken whole once, so no document is lost; sources without tokens are then kept once
    (they have no weight). ``target_entropy`` (nats) is met if shares allow it, else approached."""
    live = {k: v for k, v in tokens.items() if v}
    if not live:
        return Mixture(1.0, tokens, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0))

    def size(w: dict) -> float:
        return budget if budget is not None else max(live[k] / w[k] for k in live)

    def fits(alpha: float) -> bool:
        w = weights_at(live, alpha)
        b = size(w)
        return (target_entropy is None or entropy(w) <= target_entropy + 1e-12) and (max_repeat is None or max(w[k] * b / live[k] for k in live) <= max_repeat * (1 + 1e-12))

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    elif fits(1.0):
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    w = weights_at(live, high)
    b = size(w)
    least = (lambda k: live[k]) if budget is None else (lambda k: 0)
    return Mixture(high, tokens, {k: w.get(k, 0.0) for k in tokens}, {k: max(least(k), int(w[k] * b + 0.5)) if k in live else 0 for k in tokens})


def token_count(text: Column) -> Column:
    """Tokens of a text by its bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text.cast("string")) / TOKEN_BYTES), F.lit(0)).cast("long")


def source_tokens(df: DataFrame, source_col: str, tokens: Column) -> dict[str | None, int]:
    per = df.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.sum(tokens).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["s"]: int(r["n"] or 0) for r in sorted(per, key=lambda r: (r["s"] is not None, r["s"]))}


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, tokens_col: str | None = None, **limits) -> tuple[DataFrame, Mixture]:
    """The chosen rows, each as often as its source's blocks hold it, with the added columns
    ``_mix_tokens``, ``_mix_block`` (from 0) and ``_mix_key`` (order within the block), and the mixture."""
    spark = df.sparkSession
    tokens = token_count(F.col(text_col)) if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))
    counted = df.withColumn("_mix_tokens", tokens)
    narrow = saved(counted.select(F.col(id_col), F.col(source_col), "_mix_tokens"), "counted")
    found = solve(source_tokens(narrow, source_col, F.col("_mix_tokens")), **limits)
    keep = limits.get("budget") is None
    plan = [(k is None, k or "", found.budgets[k] // n if n else int(keep), found.budgets[k] % n if n else 0) for k, n in found.tokens.items()]
    plan_df = spark.createDataFrame(plan, PLAN)
    cut = _cuts(_keyed(narrow, source_col).join(F.broadcast(plan_df.where("_mix_rest > 0")), ["_mix_s0", "_mix_s1"]), id_col, seed, bucket_bits(narrow.count()))
    table = F.broadcast(plan_df.join(cut, ["_mix_s0", "_mix_s1"], "left"))
    placed = _keyed(counted, source_col).join(table, ["_mix_s0", "_mix_s1"])
    last = _key(seed, F.col("_mix_full"), id_col)
    blocks = F.sequence(F.lit(0).cast("long"), F.col("_mix_full") - F.when(last <= F.col("_mix_cut"), 0).otherwise(1))
    n = F.col("_mix_full") + F.when(last <= F.col("_mix_cut"), 1).otherwise(0)
    out = placed.where(n > 0).withColumn("_mix_block", F.explode(blocks)).withColumn("_mix_key", _key(seed, F.col("_mix_block"), id_col))
    return out.drop("_mix_s0", "_mix_s1", "_mix_full", "_mix_rest", "_mix_cut"), found


def _keyed(df: DataFrame, source_col: str) -> DataFrame:
    return df.withColumns({"_mix_s0": F.col(source_col).isNull(), "_mix_s1": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})


def _key(seed: int, block: Column, id_col: str) -> Column:
    return uniform(F.lit(seed), block.cast("long"), F.col(id_col))


def _cuts(df: DataFrame, id_col: str, seed: int, bits: int) -> DataFrame:
    """Per source the largest key whose documents, with all before them, fit in ``_mix_rest``."""
    strata = ["_mix_s0", "_mix_s1"]
    per = df.select(*strata, "_mix_rest", _key(seed, F.col("_mix_full"), id_col).alias("key"), F.col("_mix_tokens").alias("tokens"))
    per = per.groupBy(*strata, "key").agg(F.first("_mix_rest").alias("_mix_rest"), F.sum("tokens").alias("tokens"))
    placed = ranked(per, strata, "key", [], F.col("tokens"), F.shiftright("key", KEY_BITS - bits))
    return placed.where("before + tokens <= _mix_rest").groupBy(*strata).agg(F.max("key").alias("_mix_cut"))
