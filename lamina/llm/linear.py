"""Linear models on hashed n-grams, fitted in one task to a bounded sample and applied in all."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import features, workers

#: Weight of the n-gram parts against the dense statistics.
SCALE = 30.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(doc_id, label, text) of the `most` keys with the smallest hashes (the same at every run); keys(doc_id, label) has one row per id.

    The broadcast side has `most` rows at most, whatever the corpus, and so has the result:
    of rows that share an id, the text with the smallest hash stands for it.
    """
    chosen = keys.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (with a last column of ones), labels and ids of a table(doc_id, label, x), in the order of the ids."""
    ids, labels = (table.column(c).to_numpy() for c in ("doc_id", "label"))
    order = np.lexsort((labels, ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    width = features.SIZE + len(features.STATS)
    x = np.ones((len(ids), width + 1), np.float32)
    for at, row in zip(place.tolist(), table.column("x"), strict=True):
        x[at, :width] = np.frombuffer(row.as_buffer(), np.float16)
    x[:, : features.SIZE] *= SCALE
    return x, labels[order], ids[order]


def learned(rows: DataFrame, learn: Callable[[np.ndarray, np.ndarray, np.ndarray], dict | None]) -> dict | None:
    """What `learn` makes of the features, labels and ids of rows(doc_id, text, label), a bounded sample.

    Vectors are made in tasks; they meet in one task, which fits the model, so that the driver
    gets the model alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [features.vector(t if isinstance(t, str) else "").astype(np.float16).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": packed})

    def fitted(table: pa.Table) -> pa.Table:
        try:
            return pa.table({"model": pa.array([pickle.dumps(learn(*matrix(table)))], pa.binary())})
        finally:
            workers.give_back()

    sampled = rows.select("doc_id", "label", "text").mapInPandas(workers.task(run), "doc_id long, label double, x binary")
    found = sampled.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fitted, "model binary").collect()  # one row
    if found:
        return pickle.loads(found[0][0])
    return learn(np.ones((0, features.SIZE + len(features.STATS) + 1), np.float32), np.zeros(0), np.zeros(0, np.int64))


def fit(x: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], rounds: int = 80, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights by Adam on the full sample; `gradient` gives the derivative of the risk by each row's logit."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, rounds + 1):
        g = gradient((x @ w.astype(np.float32)).astype(float))
        grad = g.astype(np.float32) @ x + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def packed(w: np.ndarray) -> dict:
    """The weights as `logit` takes them."""
    return {"grams": (w[: features.SIZE] * SCALE).astype(np.float32), "stats": w[features.SIZE :].copy()}


def logit(text: str, found: dict, model: dict) -> float:
    """The same for one analysed text, without making its vector."""
    total = float(features.statistics(text, found) @ model["stats"][:-1] + model["stats"][-1])
    for group in features.gram_groups(text, found):
        if len(group):
            total += float(model["grams"][group].mean())
    return total


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * score + shift) a probability of label 1.

    Platt's smoothed targets keep them finite where the labels are separated; Newton steps are halved until the loss falls.
    """
    n_pos, n_neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    spread = max(1e-6, float(np.abs(scores).max())) if len(scores) else 1.0
    z = np.stack([scores / spread, np.ones(len(scores))], axis=1)
    loss = lambda w: (np.logaddexp(0, z @ w) - target * (z @ w)).sum() + 1e-3 * (w @ w)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        grad = z.T @ (p - target) + 2e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])
