"""Similarity recall over items and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.episodic import selected
from lamina.operators.knn import nearest

OVERFETCH = 4


def recall(items: DataFrame, vectors: DataFrame, query: list[float], k: int, scope: str | None = None, kind: str | None = None, mode: str = "exact") -> DataFrame:
    """The k nearest items with `score` (cosine distance).

    exact: filters first, then the top k, so k rows come back wherever k match.
    overfetch: the top 4k of all vectors, then the filters, so a rare scope may give fewer.
    Vectors without an item are never returned. Items that carry their `embedding` are scanned once, without a join.
    """
    if mode == "exact" and "embedding" in items.columns:
        hits = nearest(selected(items, scope, kind), query, k)
        return hits.drop("embedding").withColumnRenamed("distance", "score").orderBy("score", "id")
    if mode == "exact":
        wanted = selected(items, scope, kind)
        if scope is None and kind is None:
            ids = items.select("id")
        else:
            ids = wanted.select("id")
        hits = nearest(vectors.join(ids, "id", "left_semi"), query, k).select("id", "distance")
        return wanted.join(hits, "id").withColumnRenamed("distance", "score").orderBy("score", "id")
    if mode != "overfetch":
        raise ValueError(f"unknown mode {mode!r}")
    hits = nearest(vectors, query, OVERFETCH * k).select("id", "distance")
    found = selected(items.join(hits, "id"), scope, kind)
    return found.withColumnRenamed("distance", "score").orderBy("score", "id").limit(k)


def with_render(rows: DataFrame) -> DataFrame:
    """The fields a recall answers with, as JSON text."""
    fields = [c for c in ("id", "content", "kind", "tags", "scope", "created_at", "score") if c in rows.columns]
    return rows.select(F.to_json(F.struct(*fields)).alias("hit"))
