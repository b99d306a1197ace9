"""Language identification in two levels: the family first, then linear one-versus-one support
vector machines among the languages of that family.

Features are hashed byte 1- to 4-grams of the lower-cased letters of the whole text, words framed by
spaces; counts are damped by square root and scaled to length one. Letters are lower-cased by Spark, in any
script. The learning set is a bounded sample of labelled rows per language (``per_language``, and ``in_all``
for all languages), chosen by a hash of id and text; only its feature vectors reach the driver, 16 KB a row. Every machine is trained by averaged stochastic subgradients with
a fixed seed.

Rows: a null text and a text without letters are ``und`` with score 0; rows that repeat are
predicted each; rows with a null language teach nothing; with no labelled rows all is ``und``; extra
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import blocks, flat

BLOCK = 1 << 20
BUCKETS = 1 << 12
#: Labelled rows that are learned from, at most: per language, and of all languages together, which are then
#: learned from fewer rows each; no language is left out.
PER_LANGUAGE, IN_ALL = 300, 60_000
#: Family of a language code; any other code is in the family ``other``.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh",),
    "semitic": ("ar", "he"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "iranian": ("fa", "ku", "ps"),
    "austroasiatic": ("vi", "km"),
    "austronesian": ("id", "ms", "tl", "jv"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "gd", "br"),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "hellenic": ("el",),
    "kra-dai": ("th", "lo"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), "other")


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Letters of a byte to lower case, other ASCII bytes to a space; bytes of longer characters stay."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in range(97, 123):
        out[c] = out[c - 32] = c
    return out


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Rows of unit length (float32), one per text."""
    n = len(offsets) - 1
    out = np.empty((n, buckets), np.float32)
    low = _fold()[buf].astype(np.uint32)
    shift = 32 - buckets.bit_length() + 1
    for r in range(n):
        total = np.zeros(buckets, np.float64)
        for a in range(int(offsets[r]), int(offsets[r + 1]), BLOCK):  # windows of a long text share 3 bytes
            b = min(a + BLOCK, int(offsets[r + 1]))
            part = low[max(a - 3, int(offsets[r])) : b]
            part = np.concatenate(([np.uint32(32)], part, [np.uint32(32)]))
            gram = np.zeros(len(part), np.uint32)
            for size in range(1, 5):
                if len(part) < size:
                    break
                gram = gram[: len(part) - size + 1] * np.uint32(0x01000193) ^ part[size - 1 :] * np.uint32(0x85EBCA6B)
                total += np.bincount((gram * np.uint32(0x9E3779B1)) >> np.uint32(shift), minlength=buckets)
        row = np.sqrt(total)
        norm = np.sqrt((row * row).sum())
        out[r] = row / norm if norm else 0
    return out


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, penalty: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear machine with hinge loss; y is -1 or 1; classes weigh alike."""
    r = np.random.default_rng(seed)
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for i in range(0, len(order), 16):
            part = order[i : i + 16]
            step += 1
            rate = 1 / (penalty * (step + 1 / penalty / 8))
            active = y[part] * (x[part] @ w) < 1
            w *= 1 - rate * penalty
            w += rate / len(part) * ((y[part] * share[part])[active] @ x[part][active])
            if epoch >= epochs // 2:
                mean += w
    return (mean / max(1, step - step * (epochs // 2) // epochs)).astype(np.float32)


@dataclass
class LanguageModel:
    """Weights: one machine per family against the rest, one per pair of languages of a family."""

    languages: list[str] = field(default_factory=list)
    families: dict[str, list[str]] = field(default_factory=dict)
    by_family: dict[str, np.ndarray] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    buckets: int = BUCKETS

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score, the product of the family's and the language's confidence."""
        squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        names = list(self.families)
        if len(names) > 1:
            margin = np.stack([x @ self.by_family[f][:-1] + self.by_family[f][-1] for f in names], axis=1)
            family, score = margin.argmax(axis=1), squash(margin.max(axis=1))
        else:
            family, score = np.zeros(len(x), np.int64), np.ones(len(x))
        out = np.empty(len(x), object)
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            langs = self.families[name]
            votes, sure = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for i in range(len(langs)):
                for j in range(i + 1, len(langs)):
                    w = self.by_pair[langs[i], langs[j]]
                    p = squash(x[rows] @ w[:-1] + w[-1])
                    votes[:, i] += (p >= 0.5) + p * 1e-3
                    votes[:, j] += (p < 0.5) + (1 - p) * 1e-3
                    sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
            best = votes.argmax(axis=1)
            out[rows] = np.array(langs, object)[best]
            score[rows] *= sure[np.arange(len(rows)), best]
        return out.tolist(), score


def _featurize(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off, _ = flat(batch.column(0))
            for i, j in blocks(off, BLOCK):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)[i:j], batch.column(2)[i:j]], names=["x", "lang", "h"])

    return run


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, buckets: int = BUCKETS) -> LanguageModel:
    """Learns from rows where ``train`` holds and text and language are not null."""
    rows = df.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)).alias("h"))
    counts = rows.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return LanguageModel()
    per_language = max(1, min(per_language, in_all // len(counts)))
    # a bound on a uniform hash gives about as many rows as wanted; the exact number is cut below
    wish = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1 << 40, int((1 << 40) * (per_language + 4 * per_language**0.5) / r["count"]))))])
    few = rows.where(F.col("h") < wish[F.col("lang")]).dropDuplicates(["lang", "h"])  # rows that repeat are one
    sample = few.mapInArrow(_featurize(buckets), "x binary, lang string, h long").toPandas()
    sample = sample.sort_values(["lang", "h", "x"], kind="stable").groupby("lang", sort=True).head(per_language)
    x = np.stack([np.frombuffer(v, np.float32) for v in sample["x"]]) if len(sample) else np.zeros((0, buckets), np.float32)
    lang = sample["lang"].to_numpy()
    model = LanguageModel(sorted(set(lang)), buckets=buckets)
    for name in model.languages:
        model.families.setdefault(family_of(name), []).append(name)
    kin = np.array([family_of(v) for v in lang])
    if len(model.families) > 1:
        model.by_family = {f: train_svm(x, np.where(kin == f, 1.0, -1.0)) for f in model.families}
    for langs in model.families.values():
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                rows_ab = (lang == a) | (lang == b)
                model.by_pair[a, b] = train_svm(x[rows_ab], np.where(lang[rows_ab] == a, 1.0, -1.0))
    return model


def _predictor(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            buf, off, valid = flat(batch.column("text"))
            at = batch.schema.get_field_index("text")
            for i, j in blocks(off, BLOCK):
                lang, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                texts = batch.column(at)[i:j].to_pylist()
                some = np.array([t is not None and letter.search(t) is not None for t in texts])
                if model.languages and some.any():
                    x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i], model.buckets)
                    names, sure = model.predict(x[some])
                    for k, name in zip(np.flatnonzero(some).tolist(), names, strict=True):
                        lang[k] = name
                    score[some] = sure
                part = batch.slice(i, j - i)
                rest = [part.column(c) for c in range(part.num_columns) if c != at]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*names, "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)``."""
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text")).mapInArrow(_predictor(model), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
