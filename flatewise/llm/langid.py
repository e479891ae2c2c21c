"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Training takes about SAMPLE labelled documents per language, chosen by hash of their id, and of those, in order of that
hash, as many as come to SAMPLE_BYTES (documented bounds of the fit). Letters are lower-cased, every run of other characters is one blank, and the hashed 1- to 3-grams of the whole text
give a vector of DIM log term frequencies times inverse document frequencies, of length 1. Spherical k-means makes
CLUSTERS centroids per language, so that a language may have several styles. A document gets the language of the centroid
with the highest cosine. It is rejected if it has no letter, or is long enough to judge and farther from every centroid
than nearly all training documents are from theirs.

Defined results: null text or text without a letter is ``und`` with score 0; a row without doc_id is predicted and never
learned from; repeated rows are predicted each; of equally near centroids the first language's is taken; with nothing to
learn from, all are ``und``; an empty table gives no rows; other columns than doc_id, text and lang are not looked at; a
long text takes time and memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, own_worker, sampled_texts, small_batches

UNKNOWN = "und"
SAMPLE, SAMPLE_BYTES, DIM, CLUSTERS, ROUNDS = 400, 4 << 20, 8192, 3, 8
#: A document of at least JUDGED letters is rejected below FAR times the low quantile of training cosines.
JUDGED, FAR, LOW_QUANTILE = 40, 0.5, 0.01

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def codes(text: str) -> tuple[np.ndarray, int]:
    """Code points with runs of non-letters as one blank, a blank at both ends; and the number of letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    x = np.where(letter, points, 32)[keep]
    return np.concatenate(([32], x, [32])).astype(np.uint64), int(letter.sum())


def counts(x: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, n from 1 to 3."""
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    one = x * a
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * b + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * c + one[2:]
    at = np.concatenate([((g * b) >> np.uint64(51)).astype(np.int64) for g in (one, two, three)])
    return np.bincount(at, minlength=DIM)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: float

    def cosines(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf) * self.idf
        return (v @ self.centroids.T) / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the document is rejected."""
        x, letters = codes(text) if text else (None, 0)
        if not letters or not self.languages:
            return UNKNOWN, 0.0, True
        cosine = self.cosines(counts(x))
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[self.owner[best]], score, letters >= JUDGED and score < self.least


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart first centres; deterministic."""
    centres = [v.mean(axis=0)]
    near = v @ centres[0]
    while len(centres) < min(k, len(v)):
        centres.append(v[near.argmin()])
        near = np.maximum(near, v @ centres[-1])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (language, text)."""
    kept, tf = [], []
    for lang, text in rows:
        x, letters = codes(text)
        if letters:
            kept.append(lang)
            tf.append(counts(x).astype(np.float32))
    languages = sorted(set(kept))
    if not languages:
        return Model([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0, dtype=int), 0.0)
    m = np.array(tf)
    tf.clear()
    idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(axis=0))) + 1).astype(np.float32)
    np.log1p(m, out=m)  # in place: the sample's matrix is the largest thing on the driver
    m *= idf
    m /= np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-12)[:, None]
    which = np.array([languages.index(x) for x in kept])
    parts = [cluster(m[which == i], CLUSTERS) for i in range(len(languages))]
    centroids, owner = np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    own = np.where(owner[None, :] == which[:, None], m @ centroids.T, -1).max(axis=1)
    return Model(languages, idf, centroids, owner, float(np.quantile(own, LOW_QUANTILE) * FAR))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample. Only ids are ranked; texts are read for the chosen ones alone."""
    labelled = docs.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    rows = sampled_texts(docs, hash_sample(labelled, "lang", SAMPLE), "lang", SAMPLE_BYTES)
    return fit([(r["lang"], r["text"]) for r in rows])


def predicted(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) and lang_pred, score, rejected for every row of docs."""
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_worker("langid")
        for texts in batches:
            yield pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select(*keep, identify("text").alias("p")).select(*keep, "p.*")


def digest(docs: DataFrame) -> DataFrame:
    return predicted(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
