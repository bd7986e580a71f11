"""Token-budgeted context: four bounded fetches, scores, packing and display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import scoring, text, vectors
from lamina.operators import budget
from lamina.operators.episodic import recall_recent
from lamina.plans.recall import recall

PINS, EVENTS, ITEMS, TURNS = 64, 64, 32, 32
MAX_TOKENS = 4000


def per_layer_min(max_tokens: int) -> int:
    return max_tokens // 16


DETAILS = ("kind", "role", "scope", "tags", "created_at", "last_accessed")


def candidates(
    pins: DataFrame, events: DataFrame, items: DataFrame, vecs: DataFrame, turns: DataFrame, now: Column,
    query: list[float] | None = None, scope: str | None = None, details: bool = False,
) -> DataFrame:
    """(layer, id, score, tokens, at, body) of the first 64 pins, 64 recent events, 32 nearest items and last 32 turns.

    With `details` ids stay strings and the fields of DETAILS come along. Turns have no id: theirs is made of
    their time and place, so that it sorts by time and after all others.
    """

    def shaped(df: DataFrame, layer: str, score: Column, body: str, at: str) -> DataFrame:
        key = F.col("id") if details else F.col("id").cast("long")
        own = [F.lit(layer).alias("layer"), key.alias("id"), vectors.rounded(score).alias("score"), text.token_estimate(F.col(body)).alias("tokens"), F.col(at).alias("at"), F.col(body).alias("body")]
        if details:
            kinds = {"tags": "array<string>", "created_at": "timestamp", "last_accessed": "timestamp"}
            own += [(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in DETAILS]
        return df.select(*own)

    in_scope = lambda df: df if scope is None else df.where(F.col("scope") == scope)
    moment = F.concat(F.lit("turn-"), F.lpad(F.unix_micros("turn_at").cast("string"), 20, "0"), F.lit("-"), F.lpad(F.col("turn_idx").cast("string"), 10, "0"))
    last = turns.orderBy(F.desc("turn_idx")).limit(TURNS).withColumn("id", moment if details else F.col("turn_idx"))
    parts = [
        shaped(in_scope(pins).orderBy("line_no").limit(PINS), "procedural", scoring.procedural_score(), "content", "created_at"),
        shaped(recall_recent(events, EVENTS, scope), "episodic", scoring.episodic_score(F.col("retrieval_weight"), F.col("last_accessed"), now), "payload", "last_accessed"),
        shaped(last, "working", scoring.working_score(F.col("turn_at"), now), "content", "turn_at"),
    ]
    if query is not None:
        hits = recall(items, vecs, query, ITEMS, scope)
        parts.append(shaped(hits, "semantic", scoring.semantic_score(F.col("score"), F.col("created_at"), now), "content", "created_at"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_context(*layers, max_tokens: int = MAX_TOKENS, floor: int | None = None, details: bool = False, **options) -> DataFrame:
    """Kept rows with their place in the layer's display order and the tokens of the whole context."""
    found = candidates(*layers, details=details, **options)
    kept = budget.pack(found, max_tokens, per_layer_min(max_tokens) if floor is None else floor)
    of = lambda *layers: F.col("layer").isin(*layers)
    scored = of("semantic", "episodic")
    order = [
        F.when(of("procedural"), F.unix_micros("at")).asc(), F.when(of("working"), F.unix_micros("at")).desc(),
        F.when(scored, F.col("score")).desc(), F.when(of("procedural"), F.col("id")).asc(), F.col("id").desc(),
    ]
    place = F.row_number().over(W.partitionBy("layer").orderBy(*order))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # the kept rows are bounded by the fetch caps
    return kept.select("layer", place.alias("pos"), "id", "score", "tokens", total.alias("total_tokens"), *(["body", *DETAILS] if details else []))
