"""The pipeline's stages: what each keeps and returns."""

import corpus_pipeline
from test_operators import base_spans, groups_of, tokens_of
from tessera.llm.store import saved


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf_dir), name)
        before, after = docs.collect(), out.collect()
        ids, left = {r["doc_id"] for r in before}, {r["doc_id"] for r in after}
        assert left <= ids
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "quality":
            kept = [i in left for i in ids if good.get(i) == 1]
            assert sum(kept) >= 0.95 * len(kept)
        elif name == "near_duplicates":
            _, comp = groups_of([r["doc_id"] for r in before], [r["text"] for r in before], 5)
            assert left == set(comp) and len(after) == len(left)
        elif name == "personal_data":
            assert left == ids and not any(base_spans(r["text"]) for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixture":
            assert left == ids
        else:
            assert len(after) == len(before)
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(r["n_tokens"] == len(tokens_of(texts[r["doc_id"]])) for r in after[:100])
        docs = out
