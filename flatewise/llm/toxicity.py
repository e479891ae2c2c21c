"""Toxicity by compression distance: which of two zstandard dictionaries makes the windows of a text shorter.

Dictionaries are trained on toxic and on ordinary documents apart, by one rule: the dictionary at a level holds the
windows that at least that share of the class's words has (each word counted once a document), the most common ones
last, where they are cheapest to refer to. A window is the opening of a word, of each of LENGTHS letters; words go on in
pieces of PIECE letters, so whole texts are read. Letters are recoded to four pseudo-random bytes each, which raises the
resolution of compressed lengths from bytes to quarters of letters.

A window's distance at a pair of levels is its compressed length under the ordinary dictionary less that under the toxic
one, if the toxic dictionary of the lowest level compresses it at all. For every pair of PAIRS, length and cut of CUTS, the share of a document's words
(each counted REPEATS times at most) with a window at or above the cut is one measure of the document, over its words and
PRIOR more, so that short texts need no less evidence. A logistic regression of these measures calibrates how much each counts, and the threshold that
serves both classes best, an alarm over an ordinary document costing ALARM_COST times a miss, is where the score is 0.5.

Dictionaries of either half of the training sample are calibrated on the other half, and a document's score is the mean
over both halves.

Bounds of the fit: about SAMPLE labelled documents per class, chosen by hash of their id, and of those, in order of that
hash, as many as come to SAMPLE_BYTES. Nothing else is bounded, and nothing at all when documents are scored.

Defined results: a text without letters scores as one without any evidence, less than 0.5; where one class is absent from
either half, all score 0; repeated rows are scored each; a document's repeated labels count as toxic if any is; labels
without doc_id, or other than 0 and 1, are ignored; scores that tie are equal; empty tables give no rows; other columns
than doc_id, text and toxic are not looked at. A very long text costs time in proportion, and the memory of its words.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, own_worker, sampled_texts, small_batches

SAMPLE, SAMPLE_BYTES = 3000, 16 << 20
LENGTHS, PIECE = (3, 5, 7), 7
ORDINARY_LEVELS, TOXIC_LEVELS = (5e-5, 1.5e-4), (1e-4, 3e-4)
#: Levels that are compared: (of the ordinary dictionary, of the toxic one).
PAIRS = ((0, 0), (1, 0), (1, 1))
CUTS, LEAST_DOCS, COMPRESSED, PRIOR = (3, 6, 9), 3, 0.75, 10
#: A word counts at most so often in a document, or a line of junk that is repeated would outweigh all else.
REPEATS = 2
PENALTY, ALARM_COST = 5.0, 5.0
WORDS_KEPT, WINDOWS_KEPT = 300_000, 600_000
MEASURES = len(PAIRS) * len(LENGTHS) * len(CUTS)

_WORD = re.compile(r"[^\W\d_]+")
_CODES = np.random.default_rng(11).integers(0, 1 << 32, 0x110000, dtype=np.uint32)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(word: str) -> list[str]:
    """Openings of a word's pieces, with a blank where the word begins or ends."""
    out, end = [], len(word)
    for at in range(0, end, PIECE):
        start, letters = ("" if at else " "), min(PIECE, end - at)
        for n in LENGTHS:
            if letters <= n:
                out.append(start + word[at : at + letters] + (" " if at + PIECE >= end else ""))
                break
            out.append(start + word[at : at + n])
    return out


def length_class(window: str) -> int:
    return bisect.bisect_left(LENGTHS, len(window.strip(" ")))


_code_of: dict[str, bytes] = {}


def recoded(s: str) -> bytes:
    try:
        return b"".join([_code_of[c] for c in s])
    except KeyError:
        for c in s:
            _code_of[c] = _CODES[ord(c)].tobytes()
        return recoded(s)


def contents(texts: list[str], levels: tuple[float, ...]) -> list[bytes]:
    """What the dictionaries of a class hold, one per level."""
    spoken: Counter = Counter()
    for t in texts:
        spoken.update(set(words(t)))
    found: Counter = Counter()
    for w, n in spoken.items():
        for window in windows(w):
            found[window] += n
    total, rising = sum(spoken.values()), sorted(found.items(), key=lambda x: (x[1], x[0]))
    return [recoded("".join(w for w, n in rising if n >= max(LEAST_DOCS, level * total))) for level in levels]


def compressor(content: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters(strategy=z.STRATEGY_BTLAZY2, target_length=0, min_match=6, hash_log=17, window_log=22, chain_log=19, search_log=7, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 8:  # too little for a dictionary
        return z.ZstdCompressor(compression_params=how).compress
    dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=dictionary, compression_params=how).compress


@dataclass
class Half:
    """Both classes' dictionaries, from half of the sample, and the weights that the other half gives to the measures."""

    ordinary: list[bytes]
    toxic: list[bytes]
    weights: np.ndarray | None = None
    offset: float = 0.0

    def probability(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ self.weights + self.offset, -30, 30)))


class Reader:
    """Measures documents by the dictionaries of some halves; what it found for words and windows is kept in bounded memories."""

    def __init__(self, halves: list[Half]) -> None:
        self.compressors = [([compressor(c) for c in h.ordinary], [compressor(c) for c in h.toxic]) for h in halves]
        self.of_words: dict[str, tuple[int, ...]] = {}
        self.of_windows: dict[str, tuple[int, ...]] = {}

    def _of_window(self, window: str) -> tuple[int, ...]:
        data, out = recoded(window), []
        limit, length = COMPRESSED * len(data), length_class(window)
        for h, (ordinary, toxic) in enumerate(self.compressors):
            under = [len(toxic[0](data))]
            if under[0] > limit:  # nor do the smaller dictionaries of higher levels compress it
                continue
            under += [len(c(data)) for c in toxic[1:]]
            apart = [len(c(data)) for c in ordinary]
            for i, (a, b) in enumerate(PAIRS):
                if under[b] <= limit:
                    first = ((h * len(PAIRS) + i) * len(LENGTHS) + length) * len(CUTS)
                    out += [first + j for j, cut in enumerate(CUTS) if apart[a] - under[b] >= cut]
        return tuple(out)

    def _of_word(self, word: str) -> tuple[int, ...]:
        out: tuple[int, ...] = ()
        known = self.of_windows
        for window in windows(word):
            hits = known.get(window)
            if hits is None:
                hits = known[window] = self._of_window(window)
            out += hits
        return out

    def measures(self, spoken: Counter) -> np.ndarray:
        """One row of MEASURES for each half, from a document's words and how often each stands there."""
        for known, most in ((self.of_words, WORDS_KEPT), (self.of_windows, WINDOWS_KEPT)):
            if len(known) > most:
                known.clear()
        out, known, n = [0] * (MEASURES * len(self.compressors)), self.of_words, 0
        for word, times in spoken.items():
            weight = times if times < REPEATS else REPEATS
            n += weight
            hits = known.get(word)
            if hits is None:
                hits = known[word] = self._of_word(word)
            for i in hits:
                out[i] += weight
        return np.array(out, dtype=float).reshape(-1, MEASURES) / (n + PRIOR)


def regressed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression with penalty PENALTY on standardised weights, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1], PENALTY), 0.0)
    w = np.append(np.zeros(x.shape[1]), np.log(y.mean() / (1 - y.mean())))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


@dataclass
class Model:
    halves: list[Half] = field(default_factory=list)
    #: Mean probability of the halves that makes a score of 0.5.
    threshold: float = 0.5

    def reader(self) -> Reader:
        return Reader(self.halves)

    def score(self, text: str | None, reader: Reader) -> float:
        if not self.halves:
            return 0.0
        measures, t = reader.measures(Counter(words(text))), self.threshold
        p = sum(float(h.probability(m)) for h, m in zip(self.halves, measures)) / len(self.halves)
        return p * (1 - t) / (p * (1 - t) + t * (1 - p))


def calibrated(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the greatest share of toxic documents at or above it, less ALARM_COST times that of the others."""
    rising = np.unique(p)
    at = np.searchsorted(rising, p)
    above = [np.cumsum(np.bincount(at[y == c], minlength=len(rising))[::-1])[::-1] / max(1, (y == c).sum()) for c in (0, 1)]
    best = int(np.argmax(above[1] - ALARM_COST * above[0]))
    below = rising[best - 1] if best else 0.0
    return float(min(0.999, max(0.001, (rising[best] + below) / 2)))


def fit(rows: list[tuple[int, str]]) -> Model:
    """rows: (1 for toxic else 0, text), in a fixed order; every other one of a class belongs to the second half."""
    halves, found = [], []
    rows = sorted(rows, key=lambda r: r[0])
    for h in (0, 1):
        own, other = rows[h::2], rows[1 - h :: 2]
        y = np.array([c for c, _ in other], dtype=float)
        if len({c for c, _ in own}) < 2 or len(set(y)) < 2:
            return Model()
        half = Half(contents([t for c, t in own if not c], ORDINARY_LEVELS), contents([t for c, t in own if c], TOXIC_LEVELS))
        reader = Reader([half])
        x = np.array([reader.measures(Counter(words(t)))[0] for _, t in other])
        half.weights, half.offset = regressed(x, y)
        halves.append(half)
        found.append((half.probability(x), y))
    return Model(halves, calibrated(*map(np.concatenate, zip(*found))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample. Only ids are ranked; texts are read for the chosen ones alone."""
    labelled = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = sampled_texts(docs, hash_sample(labelled, "toxic", SAMPLE), "toxic", SAMPLE_BYTES)
    return fit([(r["toxic"], r["text"]) for r in rows])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score for every row of docs."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_worker("toxicity")
        reader = model.value.reader()
        for texts in batches:
            yield pd.Series([model.value.score(t, reader) for t in texts], dtype="float64")

    return docs.select("doc_id", score("text").alias("score"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
