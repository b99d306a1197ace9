"""The pipeline's stages on rows that the given tables do not hold: null and repeated ids, odd texts."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import groups_of, tokens_of

from tessera.llm import importance, mixing
from tessera.llm.queries import quality
from tessera.llm.store import discard, saved, scratch
from tessera.sources import paths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
GOOD = "the river carries clear water past the old stone mill and the quiet green fields of summer"
BAD = "click buy now cheap win prize casino bonus free offer click here subscribe deal spam"


def row(doc_id, text, source="web"):
    return doc_id, text, "en", source, None if text is None else len(text)


def varied(words, i):
    w = words.split()
    return " ".join(w[(i * 5 + j * (i % 7 + 1)) % len(w)] for j in range(40))


@pytest.fixture
def labelled(spark, tmp_path):
    """Forty good and forty bad documents with labels."""
    rows = [row(i, varied(GOOD if i < 40 else BAD, i)) for i in range(80)]
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, str(tmp_path)


def test_quality_decides_rows_without_id(spark, labelled):
    rows, sf_dir = labelled
    odd = [row(None, varied(GOOD, 101)), row(None, varied(GOOD, 102)), row(None, varied(BAD, 103)), row(None, None), row(None, "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    out = corpus_pipeline.quality(spark, docs, sf_dir)
    assert out.columns == docs.columns
    left = [tuple(r) for r in out.collect()]
    assert [r for r in odd if r in left] == odd[:2]
    drawn = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("selected")
    assert len(left) == drawn.count()
    assert {r[0] for r in left} == {r["doc_id"] for r in drawn.collect()}


def test_near_duplicates_keeps_unlike_texts_of_an_id(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [
        row(1, a), row(1, b), row(1, b.upper()), row(2, b), row(3, c), row(3, c, "news"), row(3, a), row(4, d), row(4, f"{c} more"),
        row(5, None), row(5, ""), row(5, ""), row(6, "lone"), row(2**62, d), row(None, a), row(None, a),
    ]
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), str(tmp_path))
        left = sorted(([*r][:2] + [r["source"]] for r in out.collect()), key=str)
        one_b = [1, min((b, b.upper()), key=lambda t: hashlib.sha256(t.encode()).hexdigest()), "web"]
        want = [[1, a, "web"], one_b, [3, c, "news"], [4, d, "web"], [5, None, "web"], [5, "", "web"], [6, "lone", "web"], [None, a, "web"], [None, a, "web"]]
        assert left == sorted(want, key=str)


def test_working_tables_go(spark):
    with scratch(spark) as keep:
        gone, kept = saved(spark.range(3), "gone"), keep(saved(spark.range(4), "kept"))
        with scratch(spark) as inner:
            deep = inner(saved(spark.range(5), "deep"))
        assert gone.count() == 3 and deep.count() == 5
    there = lambda t: paths.names(spark, t._work_path) != []
    assert there(kept) and not there(gone) and not there(deep)
    discard(kept)
    discard(spark.range(1))
    assert not there(kept)


def hashes(spark, ids, *before):
    """Spark's hash of each id after other values."""
    d = spark.createDataFrame([(i,) for i in set(ids)], "i long").select("i", F.xxhash64(*before, "i").alias("h"))
    return {r["i"]: r["h"] for r in d.collect()}


def plain_weights(rows, targets):
    """Log weight of each (id, text), by the definition."""
    grams = []
    for _, t in rows:
        text = np.frombuffer((t or "").encode(), np.uint8)
        grams.append(importance._grams(text, np.array([0, len(text)]), importance.BUCKETS)[0].tolist())
    raw, target = Counter(), Counter()
    for (i, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        target.update(g if i in targets else [])
    n, m, size = raw.total(), target.total(), importance.BUCKETS
    p = lambda b: (raw[b] + 1) / (n + size)
    w = 0.3 * m + 10 * size
    ratio = lambda b: math.log((target[b] + w * p(b)) / (m + w)) - math.log(p(b))
    return [sum(map(ratio, g)) if g else None for g in grams]


def plain_draw(spark, ids, weights, share):
    """The documents with the largest sums of weight and noise."""
    noise = {i: -math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52))) for i, h in hashes(spark, ids, F.lit(0)).items()}
    keys = [None if w is None else w + noise[i] for i, w in zip(ids, weights, strict=True)]
    real = sorted((k for k in keys if k is not None), reverse=True)
    bound = real[int(share * len(real) + 0.5) - 1]
    return [k is not None and k >= bound - 1e-9 for k in keys]


def plain_quality(spark, rows, labels):
    weights = plain_weights([r[:2] for r in rows], {i for i, q in labels.items() if q == 1})
    drawn = plain_draw(spark, [r[0] for r in rows], weights, np.mean([q == 1 for q in labels.values()]))
    whole = {r[0] for r, d in zip(rows, drawn, strict=True) if d and r[0] is not None}
    return [r for r, d in zip(rows, drawn, strict=True) if d or r[0] in whole]


def test_quality_is_a_weighted_draw(spark):
    """Weights and draw by their definitions; the noise decides between weights that are near each other."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words[:20] if i % 3 else words[10:], r.integers(1, 5)))) for i in range(400)] + [(900, None), (901, ""), (902, " \t")]
    labels = {i: int(i % 3 > 0) for i in range(0, 400, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("selected", F.lit(2)).repartition(4)
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality(docs, table).collect()}
    weights = plain_weights(rows, {i for i, q in labels.items() if q == 1})
    share = np.mean(list(labels.values()))
    drawn = plain_draw(spark, [i for i, _ in rows], weights, share)
    for (i, _), w, d in zip(rows, weights, drawn, strict=True):
        assert (got[i]["log_weight"] is None) == (w is None) and (w is None or abs(got[i]["log_weight"] - w) < 1e-9)
        assert got[i]["selected"] == d
    best = sorted((w for w in weights if w is not None), reverse=True)[sum(drawn) - 1]
    moved = sum(d and w < best for w, d in zip(weights, drawn, strict=True))
    assert sum(drawn) == int(share * 400 + 0.5) and moved > 10
    assert all(x["selected"] == (x["log_weight"] is not None) for x in quality(docs, table.where("quality = 0")).collect())
    assert quality(docs.where("false"), table).count() == 0


def plain_near_duplicates(rows):
    digest = lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest()
    nodes = sorted({(r[0], digest(r[1]), r[1]) for r in rows if r[0] is not None}, key=lambda x: x[:2])
    _, comp = groups_of(range(len(nodes)), [t for _, _, t in nodes], 5)
    out = [r for r in rows if r[0] is None]
    for i, (doc_id, _, text) in enumerate(nodes):
        if comp[i] == i:
            out.append(min((r for r in rows if r[:2] == (doc_id, text)), key=lambda r: [(c is not None, c) for c in r[2:]]))
    return out


def plain_personal_data(rows):
    mask = lambda t: t and t.replace("bob@site.org", "[EMAIL]").replace("10.0.0.1", "[IP]")
    return [(r[0], mask(r[1]), *r[2:]) for r in rows]


def plain_mixture(rows):
    size = lambda r: -(-len((r[1] or "").encode()) // 4)
    total = Counter()
    for r in rows:
        total[r[3]] += size(r)
    found, out = mixing.solve(dict(total), max_repeat=corpus_pipeline.MAX_REPEAT), []
    for source, n in total.items():
        own = [r for r in rows if r[3] == source]
        full, rest = divmod(found.budgets[source], n) if n else (1, 0)
        order = {i: int(hashlib.md5(f"0:{full}:{'' if i is None else i}".encode()).hexdigest()[:15], 16) for i in (r[0] for r in own)}
        used, more = 0, set()
        for h in sorted(set(order.values())):
            used += sum(size(r) for r in own if order[r[0]] == h)
            if used > rest:
                break
            more.add(h)
        out += [r for r in own for _ in range(full + (rest > 0 and order[r[0]] in more))]
    return out


def test_run_is_plain_python(spark, labelled):
    rows, sf_dir = labelled
    own, twin = varied(GOOD, 300), varied(GOOD, 301)
    rows = [(*r[:3], None if i % 20 == 7 else "books" if i % 8 == 3 else "web", r[4]) for i, r in enumerate(rows)] + [
        row(None, varied(GOOD, 101)), row(None, varied(GOOD, 101)), row(None, varied(BAD, 103)), row(None, None), row(None, ""),
        row(200, own), row(200, own, "news"), row(200, twin), row(200, None), row(200, ""), row(201, twin), row(202, own.upper()), row(203, None), row(204, " \n"),
        row(205, f"{varied(GOOD, 302)} bob@site.org and 10.0.0.1", "news"), row(206, f"{varied(GOOD, 303)} é 中文 😀", None), row(207, varied(BAD, 304) * 50), row(208, varied(GOOD, 305), "news"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    steps = [lambda x: plain_quality(spark, x, labels), plain_near_duplicates, plain_personal_data, plain_mixture]
    want = rows
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps, strict=False):
        got = [tuple(r) for r in stage(spark, spark.createDataFrame(want, SCHEMA), sf_dir).collect()]
        want = plain(want)
        want = [(*r[:4], r[4] if r[1] is None else len(r[1])) for r in want]
        assert Counter(got) == Counter(want), name
    assert 0 < len({r[:2] for r in want}) < len({r[:2] for r in rows}) and len(want) > len(set(want))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    tokens = {r[1]: tokens_of(r[1]) for r in want}
    packed = [(r[0], len(tokens[r[1]]), np.array(tokens[r[1]], "<u4").tobytes(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in want]
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in out.collect()) == Counter(packed)
