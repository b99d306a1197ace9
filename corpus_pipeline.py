"""A corpus pipeline of five stages: each takes the documents that the one before has written.

Stages return the columns of ``documents``, the last one token ids. A stage that filters keeps whole
rows; texts change only where personal data is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import ship
from tessera.llm import bpe, importance, lsh_forest, mixing, pii
from tessera.llm.queries import TOKENIZER
from tessera.llm.ranks import ranked
from tessera.llm.store import discard, saved, scratch

#: No source is taken more than so often by the mixture.
MAX_REPEAT = 1.25
#: Bytes of text that the tokens stage packs at once.
CHUNK = 4 << 20
#: Pairs of repeated ids and texts are numbered in so many buckets (as a power of two).
NODE_BITS = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling as in op7_quality; documents that are not drawn go. An id stays with all its
    rows if one of them is drawn; rows without an id are told apart, and decided, by their text."""
    ship(spark)
    sample, share = importance.targets(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", F.col("quality") == 1)
    marked = docs.withColumn("_text", F.when(F.col("doc_id").isNull(), F.sha2("text", 256)))
    weighted = importance.score(marked.withColumn("_row", F.struct("doc_id", "_text")), importance.fit(docs, sample), "_row")
    weighted = saved(weighted.select("_row.doc_id", "_row._text", "log_weight"), "weights")
    drawn = importance.resample(weighted, share=share).where("selected")
    drawn = drawn.select(F.col("doc_id").alias("_i"), F.col("_text").alias("_t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("_text").eqNullSafe(F.col("_t"))
    return marked.join(drawn, same, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash over five words; the smallest id of each group stays. Where an id repeats, each of its texts
    counts for itself: of a group the smallest id stays, of that id's texts in the group the one with the
    smallest digest, and of rows equal in both the first in the order of the other columns."""
    ship(spark)
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = saved(lsh_forest.near_duplicates(docs), "groups")
        kept = _only(docs, found.where("kept and doc_id is not null").select("doc_id"))
    else:
        kept = _texts_apart(known)
    return kept.unionByName(docs.where("doc_id is null"))


def _texts_apart(docs: DataFrame) -> DataFrame:
    """Rows that near_duplicates keeps of documents with repeated ids: each pair of id and text is numbered
    and stands as a node of its own."""
    marked = docs.withColumn("_text", F.coalesce(F.sha2("text", 256), F.lit("")))
    pairs = marked.select("doc_id", "_text").distinct().withColumn("_at", F.xxhash64("doc_id", "_text"))
    places = ranked(pairs, [], "_at", ["doc_id", "_text"], F.lit(1), F.shiftright("_at", 64 - NODE_BITS))
    nodes = saved(places.select("doc_id", "_text", F.col("rank").alias("_node")), "nodes")
    found = saved(lsh_forest.near_duplicates(saved(marked.join(nodes, ["doc_id", "_text"]).select("_node", "text"), "texts"), "_node"), "groups")
    groups = nodes.join(found.select("_node", "component_id").distinct(), "_node")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "_text")).alias("x")).select("x.*")
    order = Window.partitionBy("doc_id", "_text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    return marked.join(first, ["doc_id", "_text"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; the number of characters follows the text."""
    out = pii.redact(pii.find_spans(docs, out_col="_spans"), spans_col="_spans").drop("_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixing: no document is lost, those of small sources return."""
    out, _ = mixing.mix(docs, max_repeat=MAX_REPEAT)
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    import public_tokenizers as tokenizers

    ship(spark)
    path = tokenizers.path(TOKENIZER)
    out = bpe.decode(bpe.encode(docs, path, tokenizers.PATTERN, chunk_bytes=CHUNK), path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.distinct(), "doc_id", "left_semi").select(*docs.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's own working tables go when it is
    written, and its input with them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(saved(stage(spark, before, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
