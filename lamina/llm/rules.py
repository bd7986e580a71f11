"""Quality rules: counted base rules and a calibrated n-gram classifier, scored in Arrow batches.

The classifier is logistic regression on text statistics and hashed word and character
n-grams, trained on labelled rows outside the held-out fold (a bounded sample). Part of
that sample (a second checksum fold) isn't fitted but calibrates the probabilities
(Platt scaling). A document is kept if the base rules pass and its probability reaches
the fixed threshold.

Defined results: a null or blank text has no words and fails the base rules; repeated
rows give repeated output rows; without labels of both kinds only the base rules
decide; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import features, linear, workers
from lamina.llm.quality import held_out
from lamina.session import small_batches

LEAST_WORDS, MOST_REPEATED, THRESHOLD = 50, 50, 0.3
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, probability double"
)


def train(docs: DataFrame, labels: DataFrame, sample_size: int = 4000) -> dict | None:
    """Weights, slope and shift; None where the sample lacks one of the labels."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def learn(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> dict | None:
        aside = np.array([zlib.crc32(f"calibrate:{i}".encode()) % 5 == 0 for i in ids], bool)
        if len(set(y[~aside])) < 2:
            return None
        n = int((~aside).sum())
        weight = np.where(aside, 0.0, 1.0 / n)
        w = linear.fit(x, lambda z: (linear.sigmoid(z) - y) * weight, decay=1e-3)
        judge = aside if len(set(y[aside])) == 2 else ~aside
        slope, shift = linear.platt(x[judge] @ w, y[judge])
        return linear.packed(w) | {"slope": slope, "shift": shift}

    return linear.learned(linear.sample(texts, own, sample_size), learn)


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Counts, base decision, verdict and probability for every row."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"], strict=True):
                text = text if isinstance(text, str) else ""
                found = features.analyse(text)
                n, repeated = found["n_words"], found["n_repeat_words"]
                failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
                p = 1.0 if own is None else float(linear.sigmoid(np.array(own["slope"] * linear.logit(text, found, own) + own["shift"])))
                rows.append((key, n, found["word_chars"], found["n_symbols"], found["n_dup_lines"], repeated, failed, not failed and p >= threshold, p))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("t")).mapInPandas(workers.task(run), RESULT)
