"""Counts, scopes, exports and prompts across layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators.episodic import recall_recent, selected

#: Which arguments of a tool call are recorded, and under which names.
RECORDED_ARGUMENTS = {
    "remember": {"content": "content", "kind": "kind", "scope": "scope"},
    "pin": {"content": "content", "scope": "scope"},
    "update": {"id": "id", "content": "content", "kind": "kind"},
    "forget": {"id": "id"},
    "unpin": {"id": "id"},
    "recall": {"query": "query", "k": "k"},
    "recall_recent": {"limit": "limit", "kind": "kind", "scope": "scope"},
    "summarize_session": {"events": "events", "scope": "scope"},
    "switch_scope": {"scope": "new_scope"},
    "record_event": {"kind": "kind", "scope": "scope"},
}
#: The summary prompt's frame.
PROMPT_HEAD = (
    "You are summarizing a session. Below is a list of recent events in reverse-chronological order (newest first). "
    "Produce a concise summary (≤5 bullets) that captures: the user's goal, key decisions, outstanding actions, and any "
    "unresolved questions. Avoid restating trivia.\n\n"
)
PROMPT_TAIL = "\nRespond with the summary only. Do not include the events verbatim."


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def counts(semantic: DataFrame, pins: DataFrame, episodic: DataFrame, cold_key: list[str]) -> DataFrame:
    """(name, n): items, pins, hot and warm events, cold quarters, and rows of the key-value store."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    tiers = episodic.where("tier in ('hot', 'warm')").groupBy("tier").count()
    tiers = tiers.agg(F.coalesce(F.sum(F.when(F.col("tier") == "hot", F.col("count"))), F.lit(0)).alias("hot"), F.coalesce(F.sum(F.when(F.col("tier") == "warm", F.col("count"))), F.lit(0)).alias("warm"))
    tiers = tiers.select(F.inline(F.array(F.struct(F.lit("episodic_hot").alias("name"), F.col("hot").alias("n")), F.struct(F.lit("episodic_warm").alias("name"), F.col("warm").alias("n")))))
    quarters = one(episodic.where("tier = 'cold'").select(*cold_key).distinct(), "cold_quarters")
    parts = union_all([one(semantic, "semantic"), one(pins, "procedural"), tiers, quarters])
    stored = parts.where("name in ('semantic', 'episodic_hot', 'episodic_warm')").agg(F.sum("n").alias("n")).select(F.lit("total_stored").alias("name"), "n")
    return parts.unionByName(stored)


def scopes(*layers: DataFrame) -> DataFrame:
    """Distinct scopes of the given layers (cold rows don't count)."""
    return reduce(lambda a, b: a.union(b), [x.select("scope") for x in layers]).distinct().orderBy("scope")


def export(pins: DataFrame, episodic_hot: DataFrame, semantic: DataFrame, limit: int = 200, scope: str | None = None) -> DataFrame:
    """Rows of each layer in its own order, scope before limit, tagged by layer."""
    tag = lambda df, name: df.withColumn("layer", F.lit(name))
    return union_all([
        tag(selected(pins, scope).orderBy("line_no").limit(limit).select("id", "scope", "content", "created_at"), "procedural"),
        tag(recall_recent(episodic_hot, limit, scope).select("id", "scope", F.col("payload").alias("content"), "created_at"), "episodic"),
        tag(selected(semantic, scope).orderBy(F.desc("created_at"), "id").limit(limit).select("id", "scope", "content", "created_at"), "semantic"),
    ])


def event_lines(events: DataFrame, limit: int, scope: str | None = None) -> DataFrame:
    """Lines of the summary prompt, newest first."""
    rows = recall_recent(events, limit, scope)
    line = F.concat(F.lit("- ["), text.rfc3339(F.col("created_at")), F.lit("] "), F.col("kind"), F.lit(" ("), F.col("scope"), F.lit("): "), F.col("payload"))
    return rows.withColumn("line", line)


def summary_prompt(events: DataFrame, limit: int = 30, scope: str | None = None) -> DataFrame:
    """One row with the whole prompt."""
    order = F.struct((-F.unix_micros("last_accessed")).alias("a"), (-F.col("retrieval_weight")).alias("w"), (-F.unix_micros("created_at")).alias("c"), "id", "line")
    row = event_lines(events, limit, scope).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.line).alias("lines"))  # `limit` rows
    body = F.when(F.size("lines") == 0, F.lit("(no recent events)\n")).otherwise(F.concat(F.lit("EVENTS:\n"), F.array_join("lines", "\n"), F.lit("\n")))
    return row.select(F.concat(F.lit(PROMPT_HEAD), body, F.lit(PROMPT_TAIL)).alias("prompt"))


def recorded_call(tool: Column, arguments: Column) -> Column:
    """JSON of a tool call as the event log keeps it: the tool and its allowed arguments, nothing else."""
    out = F.to_json(F.struct(tool.alias("tool")))
    for name, fields in RECORDED_ARGUMENTS.items():
        chosen = F.to_json(F.struct(tool.alias("tool"), *(F.get_json_object(arguments, f"$.{key}").alias(label) for key, label in fields.items())))
        out = F.when(tool == name, chosen).otherwise(out)
    return out
