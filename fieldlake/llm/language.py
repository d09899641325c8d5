"""Language identification by nearest TF-IDF centroids.

A text is a vector of hashed character n-gram counts, log-damped, weighted by inverse document
frequency and normalised. Every language has several centroids (spherical k-means over a bounded
sample); the nearest one by cosine names the language, and a text farther from it than all but a
small share of that language's own sample is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.textkernel import mix, slices
from fieldlake.sources.store import materialize

#: Hashed n-gram features; n-gram lengths; centroids per language.
BUCKETS, NGRAMS, CENTROIDS = 2048, (1, 2, 3), 4
#: Training sample: about so many texts per language; languages with fewer than MIN_TEXTS usable ones are not learned.
SAMPLE, MIN_TEXTS = 1_500, 3
#: Languages that can be learned; more are an error, not a cut.
MOST_LANGUAGES = 5_000
#: Share of a language's own sample that lies beyond its rejection distance.
TAIL = 0.005
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for the whole of Unicode."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def vectors(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts [texts, buckets], number of letters). Runs of non-letters count as one space."""
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    is_letter = _letters()[code]
    n_letters = np.bincount(doc[is_letter], minlength=len(texts))
    code = np.where(is_letter, code, 32)
    keep = is_letter.copy()
    if len(code):
        keep[1:] |= is_letter[:-1] & (doc[1:] == doc[:-1])  # the first non-letter after a word
    code, doc = code[keep].astype(np.uint64), doc[keep]
    out = np.zeros(len(texts) * buckets, np.float32)
    for n in NGRAMS:
        if len(code) < n:
            continue
        value = np.zeros(len(code) - n + 1, np.uint64)
        for k in range(n):
            value = value * np.uint64(1_114_112) + code[k : len(code) - n + 1 + k]
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        slot = (mix(value[whole] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)
        out += np.bincount(doc[: len(doc) - n + 1][whole] * buckets + slot, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), buckets), n_letters


@dataclass
class Model:
    """Centroids with their language, the weights of features, and the least cosine per language."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: dict[str, float]

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        w = np.log1p(counts) * self.idf
        return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine in 0..1, rejected) of each text."""
        counts, letters = vectors(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.weigh(counts) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        lang = [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
        rejected = np.array([n == 0 or s < self.least[self.langs[b]] for b, n, s in zip(best, letters, score, strict=True)], bool)
        return lang, np.where(letters > 0, score, 0.0), rejected


def cluster(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """Spherical k-means from far-apart rows; deterministic."""
    centre = x.mean(0)
    centres = [x[int((x @ centre).argmax())]]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(np.max(x @ np.array(centres).T, 1).argmin())])
    c = np.array(centres)
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from rows with a non-null language and text.

    Of a language with n texts those are used whose hash of id and text falls in the first
    sample / n of the hash range: about `sample`, whatever the partitions. Each language's sample
    is clustered in a task of its own; the driver gets the centroids and `BUCKETS` document
    frequencies.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h"))
    rows = rows.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    span = 1 << 40
    upto = {r["lang"]: min(span, int(span * sample / r["count"])) for r in sizes}
    pairs = [F.lit(x) for lang_upto in upto.items() for x in lang_upto]
    limit = F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(0)
    chosen = materialize(rows.where(F.pmod("h", F.lit(span)) < limit).select("lang", "text"), "language-sample")

    def frequencies(batches):
        seen, n = np.zeros(BUCKETS), 0
        for b in batches:
            for part in slices(b["text"], 2_000_000):
                seen += (vectors(part)[0] > 0).sum(0)
                n += len(part)
        yield pd.DataFrame({"n": [n], "seen": [seen.tolist()]})

    seen, n = np.zeros(BUCKETS), 0
    for r in chosen.select("text").mapInPandas(frequencies, "n long, seen array<double>").toLocalIterator():
        seen, n = seen + np.array(r["seen"]), n + r["n"]
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + 1
    blank = Model(idf, np.zeros((0, BUCKETS), np.float32), [], {})

    def centres(key, group):
        x = np.concatenate([blank.weigh(vectors(p)[0]) for p in slices(group["text"], 2_000_000)])
        x = x[np.linalg.norm(x, axis=1) > 0.5]
        if len(x) < MIN_TEXTS:
            return pd.DataFrame({"lang": [], "least": [], "centre": []})
        c = cluster(x, centroids)
        least = float(np.quantile((x @ c.T).max(1), TAIL))
        return pd.DataFrame({"lang": [key[0]] * len(c), "least": [least] * len(c), "centre": [v.tolist() for v in c]})

    found = sorted(
        chosen.groupBy("lang").applyInPandas(centres, "lang string, least double, centre array<float>").collect(),
        key=lambda r: (r["lang"], r["centre"]),
    )
    return Model(idf, np.array([r["centre"] for r in found], np.float32).reshape(-1, BUCKETS), [r["lang"] for r in found],
                 {r["lang"]: r["least"] for r in found})


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; whole texts are read.

    `lang_pred` is the nearest language, `und` where the text is null or has no letter (or nothing
    was learned); `rejected` marks texts beyond the distance at which `lang_pred` can be trusted.
    Ties go to the first language by name. Repeated rows each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids: languages x CENTROIDS x BUCKETS floats
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        for b in batches:
            lang, score, rejected = [], [], []
            for part in slices(b["text"], 1_000_000):
                for k in range(0, len(part), 2_000):
                    found = shared.value.predict(part[k : k + 2_000])
                    lang += found[0]
                    score += found[1].tolist()
                    rejected += found[2].tolist()
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score, "rejected": rejected})

    return rows.mapInPandas(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the fifth that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
