"""The event layer: recency order, listings, and its keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(rows: DataFrame, scope: str | None = None, kind: str | None = None) -> DataFrame:
    if scope is not None:
        rows = rows.where(F.col("scope") == scope)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def recall_recent(events: DataFrame, limit: int, scope: str | None = None, kind: str | None = None) -> DataFrame:
    """Last accessed first, then weight, then creation (all descending), then id; filters before the limit."""
    rows = selected(events, scope, kind)
    return rows.orderBy(F.desc("last_accessed"), F.desc("retrieval_weight"), F.desc("created_at"), F.asc("id")).limit(limit)


def list_hot(events: DataFrame) -> DataFrame:
    return events.where("tier = 'hot'").orderBy(F.desc("created_at"), "id")


def list_warm(events: DataFrame) -> DataFrame:
    return events.where("tier = 'warm'").orderBy("created_at", "id")


def touch(events: DataFrame, event_id, now: Column) -> DataFrame:
    """last_accessed becomes now for one id of the hot tier."""
    hit = (F.col("id") == event_id) & (F.col("tier") == "hot")
    return events.withColumn("last_accessed", F.when(hit, now).otherwise(F.col("last_accessed")))


def forget(events: DataFrame, event_id) -> DataFrame:
    """Without the id, if it is hot or warm; cold rows can't be forgotten."""
    return events.where(~((F.col("id") == event_id) & F.col("tier").isin("hot", "warm")))


def find(events: DataFrame, event_id) -> DataFrame:
    """The row of an id, hot before warm before cold."""
    rank = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "warm", 1).otherwise(2)
    return events.where(F.col("id") == event_id).orderBy(rank).limit(1)


def mirrored_turns(events: DataFrame) -> DataFrame:
    """Turns that message events add to their session: role by kind, content from the payload, blanks left out."""
    role = F.when(F.col("kind") == "user_message", "user").when(F.col("kind") == "assistant_message", "assistant")
    rows = events.withColumn("role", role).withColumn("content", F.get_json_object("payload", "$.content"))
    return rows.where(F.col("role").isNotNull() & (F.length("content") > 0))
