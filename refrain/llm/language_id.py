"""Language identification by nearest centroid.

Character n-grams (1 to 3, of lower-cased letters with one mark for all else) are hashed to DIMS places and
weighted by sublinear TF times IDF, then normalised. A language has several centroids, found by spherical
k-means over its training vectors. A text gets the language of the centroid with the largest cosine. Texts
whose best cosine lies below the learned radius are rejected by distance.

The fit takes SAMPLE labelled rows at most, those with the smallest hash of their id and text; that bound is
the one limit here, and whole texts are used. Counting, document frequencies and the k-means of each language
run in tasks; the driver gets the IDF and the centroids alone. A prediction sees the text alone.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without labelled rows all
texts are ``und``; repeated rows come back each (the fit takes them once); of equally near centroids the first
by language and number wins; empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import by_pandas, only
from refrain.session import Scratch

DIMS = 4096
#: Labelled rows that the fit takes at most.
SAMPLE = 3_000
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected if its cosine is below this share of the language's smallest training cosine.
RADIUS = 0.5
#: Code points whose n-grams are hashed at once.
BLOCK = 1 << 16

#: Which of the basic plane's code points are letters; those above it are looked up as they come.
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None if there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    high = code > 0xFFFF
    if high.any():
        points, at = np.unique(code[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in points])[at]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    stay = np.ones(len(code), bool)
    stay[1:] = letter[1:] | letter[:-1]  # runs of other characters are one mark
    code = np.concatenate([[32], code[stay], [32]]).astype(np.uint64)
    counts = np.zeros(DIMS, np.int64)
    for i in range(0, len(code), BLOCK):
        c = code[i : i + BLOCK + 2]
        h = np.zeros(len(c), np.uint64)
        for n in (1, 2, 3):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint64(0x9E3779B1) + c[n - 1 :] + np.uint64(n)) & np.uint64(0xFFFFFFFFFF)
            own = min(len(h), BLOCK)
            place = (h[:own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            counts += np.bincount(place.astype(np.int64), minlength=DIMS)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """Centroids (rows), their languages and radii, and the IDF; its size does not grow with the data."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text) if text else None
        if counts is None or not self.langs:
            return "und", 0.0, True
        cosine = self.centroids @ self.vectors(counts)
        best = int(np.argmax(cosine))
        score = float(np.clip(cosine[best], 0, 1))
        return self.langs[best], score, bool(score < self.radius[best])


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far points; fixed start, so reruns agree."""
    centres = [_unit(x.mean(axis=0))]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([_unit(x[own == i].mean(axis=0)) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's places and counts; texts without a letter teach nothing."""
    for b in batches:
        rows = []
        for o, lang, text in zip(b["o"], b["lang"], b["text"], strict=True):
            counts = ngram_counts(text) if text else None
            if counts is not None:
                places = np.flatnonzero(counts)
                rows.append((o, lang, places.astype("<i4").tobytes(), np.log1p(counts[places]).astype("<f4").tobytes()))
        yield pd.DataFrame(rows, columns=["o", "lang", "places", "weights"])


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, n): in how many of these texts a place occurs; the last row, -1, counts the texts."""
    n, texts = np.zeros(DIMS, np.int64), 0
    for b in batches:
        texts += len(b)
        for p in b["places"]:
            n[np.frombuffer(p, "<i4")] += 1
    yield pd.DataFrame({"place": [*range(DIMS), -1], "n": [*n.tolist(), texts]})


def _centroids(idf: np.ndarray):
    """Per language its centroids and its smallest training cosine; a group is a part of the bounded sample."""

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("o")
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (p, w) in enumerate(zip(own["places"], own["weights"], strict=True)):
            at = np.frombuffer(p, "<i4")
            x[i, at] = np.frombuffer(w, "<f4") * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _kmeans(x, CENTROIDS)
        least = float(np.max(x @ c.T, axis=1).min())
        return pd.DataFrame({"lang": own["lang"].iloc[0], "k": range(len(c)), "centroid": [v.astype("<f4").tobytes() for v in c], "least": least})

    return fitted


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample. Counting and k-means run in tasks; the driver gets IDF and centroids only."""
    scratch = Scratch(docs.sparkSession, "language-fit")
    d = only(docs, doc_id="long", text="string", lang="string").where(for_training() & F.col("text").isNotNull())
    d = d.withColumn("o", F.xxhash64("doc_id", F.xxhash64("text")))
    # Ids and hashes are ranked, not texts; then the few texts are fetched by their hash.
    last = d.select("o").orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    none = Model(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), (), np.zeros(0))
    if last is None:
        return none
    rows = d.where(F.col("o") <= last).select("o", "lang", "text")
    found = rows.mapInPandas(_counted, "o long, lang string, places binary, weights binary")
    found = scratch.save(found.dropDuplicates(["o", "lang"]), "sample")
    seen = {r["place"]: r["n"] for r in found.select("places").mapInPandas(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    texts = seen.pop(-1, 0)
    if not texts:
        scratch.drop("sample")
        return none
    idf = (np.log((1 + texts) / (1 + np.array([seen[i] for i in range(DIMS)]))) + 1).astype(np.float32)
    fitted = found.groupBy("lang").applyInPandas(_centroids(idf), "lang string, k int, centroid binary, least double").collect()
    scratch.drop("sample")
    fitted.sort(key=lambda r: (r["lang"], r["k"]))
    centroids = np.array([np.frombuffer(r["centroid"], "<f4") for r in fitted])
    return Model(idf, centroids, tuple(r["lang"] for r in fitted), np.array([RADIUS * r["least"] for r in fitted]))


def for_training():
    return ~held_out() & F.col("lang").isNotNull()


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per document."""
    model = fit(docs)
    d = only(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text")

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([model.predict(t) for t in b["text"]], columns=["lang_pred", "score", "rejected"])
            yield pd.concat([b[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    return by_pandas(d, predicted, "held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns as they came."""
    model = fit(docs)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        return pd.Series([not model.predict(t)[2] for t in text], dtype=bool)

    return docs.where(known(F.col("text").cast("string")))
