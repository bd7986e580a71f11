"""Retrieval scores of the four layers. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 14.0
SEMANTIC, EPISODIC, WORKING, PROCEDURAL = 0.7, 0.8, 0.9, 1.0


def recency(ts: Column, now: Column) -> Column:
    """Halves every 14 days; whole seconds; times after `now` count as now."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(ts)) / F.lit(86400.0)
    return F.exp(-F.greatest(days, F.lit(0.0)) * F.ln(F.lit(2.0)) / F.lit(HALF_LIFE_DAYS))


def semantic_score(distance: Column, created_at: Column, now: Column) -> Column:
    closeness = F.least(F.greatest(F.lit(1.0) - distance, F.lit(0.0)), F.lit(1.0))
    return closeness * SEMANTIC * recency(created_at, now)


def episodic_score(weight: Column, last_accessed: Column, now: Column) -> Column:
    return weight.cast("double") * EPISODIC * recency(last_accessed, now)


def working_score(at: Column, now: Column) -> Column:
    return F.lit(WORKING) * recency(at, now)


def procedural_score() -> Column:
    return F.lit(PROCEDURAL)
