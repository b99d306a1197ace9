"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, importance, langid, lsh_forest, mixing, pii, pq_dedup, sharding, warc
from .oracles import ORACLES
from .store import saved

#: Production parameters.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SHARDS, K, MAX_REPEAT = 8, 5, 2.0


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path(TOKENIZER)
    out = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), path, tokenizers.PATTERN), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2  # unknown without an id: not learned from
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(_read(spark, sf_dir, "documents"), words=2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    out = warc.read_records(warc.write_archives(pages))
    return out.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_read(spark, sf_dir, "documents"))
    base = found.withColumn("base", F.expr(f"filter(spans, s -> s.kind in {pii.BASE})"))
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return base.select("doc_id", *map(count, pii.BASE), F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"), F.expr("coalesce(array_max(transform(spans, s -> s.score)), 0D)").alias("top_score"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their weights and whether the resampling draws them; targets have quality 1."""
    sample, share = importance.targets(labels, "doc_id", F.col("quality") == 1)
    return importance.resample(saved(importance.score(docs, importance.fit(docs, sample)), "weights"), share=share)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(_read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=K)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    out, _ = mixing.mix(saved(docs, "tokens"), tokens_col="n_tokens", max_repeat=MAX_REPEAT)
    return out.select("doc_id", "source", "n_tokens", F.col("_mix_block").alias("block"), F.col("_mix_key").alias("block_key"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_language_id, op3_embedding_dedup, op4_minhash_dedup, op5_warc, op6_pii, op7_quality, op8_sharding, op9_ann, op10_mixing, pipeline)}

__all__ = ["ORACLES", "QUERIES"]
