"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on passages of toxic text. A text is cut into
windows of a few words; each window is compressed under the ordinary dictionary and under both together, and the
bytes that the toxic one saves are its distance. Thresholds are set where windows of ordinary training text come out
(the savings that one in ten, in a hundred, ... of them exceed); counts of windows beyond them go through a fitted
logistic curve to a score between 0 and 1.

Most of a toxic text is ordinary. So the trainer is given those passages of a few words, as they stand in the toxic
training texts, that hold a word whose beginning toxic texts hold in many different contexts and ordinary ones
hardly at all. Counting contexts instead of documents keeps groups of near copies from posing as vocabulary.

The model is fitted on the driver on a bounded sample of labelled rows (`toxic_rows`, `ordinary_rows`);
scoring reads every whole text on the executors and moves no rows. The ordinary dictionary and the thresholds are
fitted on at most `sample_windows` windows of that sample, drawn at random.

Defined results: null and empty texts score like a text without any suspicious window; labels that are
null or neither 0 nor 1 are not used; a document with several labels counts as toxic if one says so; with
no usable label of one class every score is 0.0; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_of

#: Shares of ordinary windows that stay below the thresholds.
QUANTILES = (0.9, 0.99, 0.999, 0.9999)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class ToxicityModel:
    """Dictionaries, window size and logistic weights; small enough to travel with each task."""

    def __init__(self, ordinary: bytes, toxic: bytes, window_words: int = 8):
        self.ordinary, self.toxic, self.window_words = ordinary, toxic, window_words
        self.mean = self.scale = self.weights = None
        self.thresholds: list[int] = [1, 2, 3, 4]

    def _compressors(self):
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=3, target_length=16,
            strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress)
        return out

    def savings(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, the bytes that the toxic dictionary saves in each window."""
        plain, toxic = self._compressors()
        return [
            np.array([len(plain(w)) - len(toxic(w)) for w in windows(words_of(t), self.window_words)]) for t in texts
        ]

    def fit_thresholds(self, ordinary: list[bytes]) -> None:
        """One byte above the quantiles of what ordinary windows save, each above the one before."""
        plain, toxic = self._compressors()
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in ordinary])
        self.thresholds, least = [], 1
        for q in QUANTILES:
            self.thresholds.append(max(least, int(np.quantile(saved, q, method="higher")) + 1))
            least = self.thresholds[-1] + 1

    def features(self, saved: np.ndarray) -> list[float]:
        n, out = len(saved), []
        for limit in self.thresholds:
            k = int((saved >= limit).sum())
            out += [math.log1p(k), k / n]
        excess = int(np.maximum(saved - self.thresholds[1], 0).sum())
        return [*out, math.log1p(excess), excess / n, max(int(saved.max()), 0) / 8, math.log(n)]

    def calibrate(self, texts: list[str], toxic: list[int], ridge: float = 1.0) -> None:
        x, y = np.array([self.features(s) for s in self.savings(texts)]), np.array(toxic, dtype=float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.weights = np.zeros(a.shape[1])
        penalty = np.r_[np.full(a.shape[1] - 1, ridge), 1e-6]
        for _ in range(40):  # Newton steps
            p = _logistic(a @ self.weights)
            slope = a.T @ (p - y) + penalty * self.weights
            curve = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
            self.weights -= np.linalg.solve(curve, slope)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = (np.array([self.features(s) for s in self.savings(texts)]) - self.mean) / self.scale
        return _logistic(np.c_[x, np.ones(len(x))] @ self.weights)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows(words: list[bytes], size: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)] or [b""]


def _beginnings(texts: list[list[bytes]]) -> tuple[Counter, int]:
    """How many different contexts (word with both neighbours) hold a word that begins so."""
    contexts: set[int] = set()
    words: Counter = Counter()
    for text in texts:
        around = [b"", *text, b""]
        for triple in zip(around, around[1:], around[2:], strict=False):
            if (key := hash(triple)) not in contexts:
                contexts.add(key)
                words[triple[1]] += 1
    out: Counter = Counter()
    for word, n in words.items():
        word = b" " + word
        for k in range(5, min(len(word), 10) + 1):
            out[word[:k]] += n
    return out, sum(words.values())


def train(rows: list[tuple[str, int]], window_words: int = 8, passage_words: int = 3, ordinary_bytes: int = 32768, toxic_bytes: int = 2048,
          least_share: float = 0.05, least_log_odds: float = 3.0, sample_windows: int = 60_000) -> ToxicityModel:
    """A model from (text, toxic) rows; one without weights if a class is missing or nothing tells them apart."""
    by_class = {y: [words_of(t) for t, label in rows if label == y] for y in (0, 1)}
    empty = ToxicityModel(b"", b"", window_words)
    if not by_class[0] or not by_class[1]:
        return empty
    (toxic, n_toxic), (plain, n_plain) = _beginnings(by_class[1]), _beginnings(by_class[0])
    log_odds = lambda g: math.log((toxic[g] + 0.5) / (n_toxic + 1)) - math.log((plain[g] + 0.5) / (n_plain + 1))
    least = max(3, least_share * len(by_class[1]))
    telling = tuple(sorted(g for g, n in toxic.items() if n >= least and log_odds(g) >= least_log_odds))
    passages = [w for text in by_class[1] for w in windows(text, passage_words) if any((b" " + x).startswith(telling) for x in w.split())]
    if not passages:
        return empty
    ordinary = [w for text in by_class[0] for w in windows(text, window_words)]
    random.Random(0).shuffle(ordinary)
    ordinary = ordinary[:sample_windows]
    model = ToxicityModel(_dictionary(ordinary, ordinary_bytes, 64), _dictionary(passages, toxic_bytes, 16), window_words)
    model.fit_thresholds(ordinary[: sample_windows // 2])
    model.calibrate([t for t, _ in rows], [y for _, y in rows])
    return model


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; the samples themselves where there is too little for the trainer."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def labelled_sample(documents: DataFrame, labels: DataFrame, toxic_rows: int = 1200, ordinary_rows: int = 2000) -> list[tuple[str, int]]:
    """At most `toxic_rows` and `ordinary_rows` labelled training texts, drawn by a hash of doc_id.

    Only ids of the drawn rows are broadcast: the two parameters bound them.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    drawn = [
        r
        for y, n in ((1, toxic_rows), (0, ordinary_rows))
        for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    ]
    if not drawn:
        return []
    spark = documents.sparkSession
    ids = spark.createDataFrame([(r[0], r[1]) for r in drawn], "doc_id long, toxic int")
    found = (
        text_of(documents).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    )
    return sorted((r["text"], r["toxic"]) for r in found.select("text", "toxic").collect())


def score_of(model: ToxicityModel):
    """The model as a function of a text column without nulls."""

    @F.pandas_udf("double")
    def toxic_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    return toxic_score


def score(documents: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """`keep` columns of each document and its score."""
    return documents.select(*keep, score_of(model)(F.coalesce(F.col("text"), F.lit(""))).alias("score"))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(labelled_sample(documents, labels))
    return score(documents, model, "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
