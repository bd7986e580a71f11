"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled 1 outside the held-out fold; the unlabelled
set is web text of the same folds, whatever its labels. A linear model on text
statistics and hashed n-grams minimises

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

with the logistic loss; where the second part turns negative its gradient is reversed,
so the model can't gain by fitting the unlabelled set as negatives. Scores are shifted so
that they average to the prior over the unlabelled sample.

The class prior is estimated from the positives and the unlabelled rows alone, by best bin
estimation: a model that tells one half of the positives from one half of the unlabelled
ranks the other halves, and the prior is the smallest ratio, over all thresholds, of the
unlabelled and the positives above it (plus a bound of their sampling errors, so that bins
of a few rows don't win). Labels 0 are never read.

Both samples are bounded (`sample_size` rows each, those with the smallest hashes of
their ids, each id once); every text is scored. Labels, language, source and id never enter a score.

Defined results: null and blank texts get the score of a text without features; rows
that repeat an id are scored each by its own text; a null id counts as held out when
the checksum of the empty string says so (it does); without positives or unlabelled
rows every score is 0.5; an empty table gives an empty
result; other input columns are ignored or, in `keep_good`, kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import features, linear, workers
from lamina.session import small_batches

THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def pu_gradient(labels: np.ndarray, prior: float, beta: float = 0.0):
    """Derivative of the non-negative risk by each logit; labels: 1 positive, 0 unlabelled."""
    pos, unl = labels == 1, labels == 0
    n_pos, n_unl = max(1, pos.sum()), max(1, unl.sum())

    def gradient(logit: np.ndarray) -> np.ndarray:
        s = linear.sigmoid(logit)
        minus = np.logaddexp(0, logit)
        negative_risk = minus[unl].sum() / n_unl - prior * minus[pos].sum() / n_pos
        sign = 1.0 if negative_risk >= -beta else -1.0
        g = np.zeros_like(logit)
        g[pos] = (prior * (s[pos] - 1) if sign > 0 else 0) / n_pos - sign * prior * s[pos] / n_pos
        g[unl] = sign * s[unl] / n_unl
        return g

    return gradient


def best_bin(pos: np.ndarray, unl: np.ndarray, sure: float = 0.1, weight: float = 0.01) -> float:
    """The share of positives among the unlabelled, from the scores of both.

    Above any threshold the unlabelled hold at least the prior times the positives' share; the
    threshold with the smallest ratio, its sampling error added, says most.
    """
    cuts = np.unique(pos)
    q_pos = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    q_unl = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    error = np.sqrt(np.log(4 / sure) / 2 / len(pos)) + np.sqrt(np.log(4 / sure) / 2 / len(unl))
    at = np.argmin(q_unl / q_pos + (1 + weight) * error / q_pos)
    return float(q_unl[at] / q_pos[at])


def class_prior(x: np.ndarray, y: np.ndarray, ids: np.ndarray, least: float = 0.05, most: float = 0.95) -> float:
    """Best bin estimation on the half of the sample that its model hasn't seen; 0.5 where a half lacks rows."""
    half = np.array([zlib.crc32(f"prior:{i}".encode()) % 2 == 0 for i in ids], bool)
    counts = [int(((y == label) & (half == side)).sum()) for label in (0, 1) for side in (False, True)]
    if not all(counts):
        return 0.5
    weight = np.where(half, 0.0, np.where(y == 1, 0.5 / counts[2], 0.5 / counts[0]))
    w = linear.fit(x, lambda z: (linear.sigmoid(z) - y) * weight, rounds=40, decay=1e-3)
    z = x @ w
    return min(most, max(least, best_bin(z[half & (y == 1)], z[half & (y == 0)])))


def centre(scores: np.ndarray, prior: float) -> float:
    """The shift with which the scores' probabilities average to the prior."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if linear.sigmoid(scores + mid).mean() > prior else (mid, high)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, sample_size: int = 2000, rounds: int = 80, decay: float = 3e-3) -> dict:
    """A model from bounded samples; `labels` holds doc_id and quality."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    positive = own.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1.0).alias("label")).distinct()
    unlabelled = texts.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(0.0).alias("label")).distinct()
    rows = linear.sample(texts, positive, sample_size).unionByName(linear.sample(texts, unlabelled, sample_size))

    def learn(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> dict:
        if not (y == 1).any() or not (y == 0).any():
            return {"grams": np.zeros(features.SIZE, np.float32), "stats": np.zeros(len(features.STATS) + 1)}
        prior = class_prior(x, y, ids)
        w = linear.fit(x, pu_gradient(y, prior), rounds, decay=decay)
        w[-1] += centre(x[y == 0] @ w, prior)
        return linear.packed(w)

    return linear.learned(rows, learn)


def scores(docs: DataFrame, model: dict, *keep: Column | str) -> DataFrame:
    """docs[keep] and `_q_score` for every row, in Arrow batches."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table of weights: fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            yield pd.Series(linear.sigmoid(np.array([linear.logit(t, features.analyse(t), own) for t in texts], float)), dtype=float)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from workers.task(run)(batches)

    return docs.select(*keep, score(F.col("text").cast("string")).alias("_q_score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    found = scores(docs, train(docs, labels, **options), "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_q_score").alias("score"), (F.col("_q_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    # as one struct the columns of the documents, whatever their names, clash with nothing
    found = scores(docs, train(docs, labels, **options), F.struct(*docs.columns).alias("row"))
    return found.where(F.col("_q_score") >= threshold).select("row.*")
