"""Row types of the memory layers."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.ArrayType(T.StringType(), containsNull=False)
SEMANTIC_ITEM = T.StructType().add("id", "string").add("content", "string").add("kind", "string").add("tags", TAGS).add("scope", "string").add("created_at", "timestamp")
VECTOR = T.StructType().add("id", "string").add("embedding", T.ArrayType(T.FloatType(), False))
EPISODIC_EVENT = (
    T.StructType().add("id", "string").add("kind", "string").add("scope", "string").add("payload", "string").add("tags", TAGS)
    .add("retrieval_weight", "float").add("last_accessed", "timestamp").add("created_at", "timestamp")
)
PINNED_ITEM = T.StructType().add("id", "string").add("content", "string").add("tags", TAGS).add("scope", "string").add("created_at", "timestamp")
TURN = T.StructType().add("role", "string").add("content", "string").add("at", "timestamp")
SESSION = T.StructType().add("id", "string").add("turns", T.ArrayType(TURN)).add("started_at", "timestamp").add("last_checkpoint_at", "timestamp").add("clean_shutdown", "boolean")
#: One op carries item and vector together; nulls in a patch leave the field as it is.
OPLOG = (
    T.StructType().add("lsn", "long").add("op", "string").add("id", "string").add("content", "string").add("kind", "string").add("tags", TAGS)
    .add("scope", "string").add("created_at", "timestamp").add("embedding", T.ArrayType(T.FloatType(), False))
)

MEMORY_KINDS = ("fact", "decision", "preference", "conversation")
TIERS = ("hot", "warm", "cold")
LAYERS = ("procedural", "semantic", "episodic", "working")
SCHEMA_VERSION = 1
