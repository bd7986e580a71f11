"""The tool and resource surface: validated calls over one data folder, answers as plain dicts.

Write calls default to the current scope, read calls to all scopes.
"""

from __future__ import annotations

import inspect
import json
import math
import os
import shutil
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import embedding, text, ulid
from lamina.operators import episodic, tiers
from lamina.plans import context, diagnostics
from lamina.plans.recall import OVERFETCH, recall
from lamina.schemas import EPISODIC_EVENT, MEMORY_KINDS, SCHEMA_VERSION
from lamina.sources import backup, cold, config, pins, sessions
from lamina.sources.event_table import EventTable
from lamina.sources.storage import LogStore
from lamina.sources.store import OpLogStore
from lamina.sources.vector_index import GraphIndex

TOOLS = ("remember", "recall", "update", "forget", "pin", "unpin", "recall_recent", "summarize_session", "record_event", "switch_scope", "stats", "list_scopes", "export")
#: JSON types of the tools' arguments, and those that must be given.
ARGUMENTS = {
    "content": "string", "type": "string", "tags": "array", "scope": "string", "query": "string", "limit": "integer", "id": "string", "kind": "string", "payload": "object",
    "retrieval_weight": "number", "events": "integer", "limit_per_layer": "integer", "pinned": "boolean", "mode": "string",
}
REQUIRED = {"remember": ("content",), "recall": ("query",), "update": ("id",), "pin": ("content",), "unpin": ("id",), "record_event": ("kind",), "switch_scope": ("scope",)}
RESOURCES = ("context", "recent", "procedural", "stats", "session")


class InvalidArguments(ValueError):
    code = -32602


class NotFound(LookupError):
    code = -32601


def _limit(value, default: int, most: int) -> int:
    value = default if value is None else value
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise InvalidArguments(f"limit must be from 1 to {most}")
    return value


def _text(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise InvalidArguments(f"{name} must not be blank")
    return value.strip()


def _tags(value, nested: bool = True) -> list[str]:
    if value is None:
        return []
    if nested and isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError as e:
            raise InvalidArguments("tags must be an array of strings") from e
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise InvalidArguments("tags must be an array of strings")
    return value


def _kind(value, default: str | None = None):
    value = default if value is None else value
    if value is not None and value not in MEMORY_KINDS:
        raise InvalidArguments(f"type must be one of {', '.join(MEMORY_KINDS)}")
    return value


def descriptors() -> list[dict]:
    """Name, description and argument schema of every tool, from the methods that answer them."""
    out = []
    for tool in TOOLS:
        names = list(inspect.signature(getattr(Engine, tool)).parameters)[1:]
        typed = {"type" if n == "kind" and tool in ("remember", "recall", "update") else n for n in names}
        schema = {"type": "object", "properties": {n: {"type": ARGUMENTS[n]} for n in sorted(typed)}, "required": list(REQUIRED.get(tool, ()))}
        out.append({"name": tool, "description": (getattr(Engine, tool).__doc__ or "").strip(), "inputSchema": schema})
    return out


class Engine:
    """All tools over one data folder, for one process."""

    def __init__(self, spark: SparkSession, root: str, settings: config.Config | None = None, model: str = "stub", dim: int = 32, store: LogStore | None = None):
        self.spark, self.root = spark, root
        self.settings = settings or config.Config()
        backup.scaffold(root)
        self.store = store or OpLogStore(spark, f"{root}/semantic", dim, model)
        self.live_events = self._event_table()
        #: Made at the first recall that asks for it.
        self.index = GraphIndex(spark, f"file://{os.path.abspath(root)}/semantic/index")
        self.pins_path = f"{root}/procedural/pinned.jsonl"
        self.cold = cold.ColdStore(spark, f"{root}/cold/bundles")
        self.scope = self.settings.scopes.default
        self.session = {"id": ulid.new(), "turns": [], "started_at": self._now(), "last_checkpoint_at": None, "clean_shutdown": False}
        self.unsaved, self.embed = 0, embedding.embedder(model, dim)
        #: Writes of any layer so far; background work waits until it stands still.
        self.activity, self.checkpoints_total = 0, 0
        self.lock, self.timers, self.opened = threading.RLock(), [], False

    @staticmethod
    def _now() -> str:
        return datetime.now(timezone.utc).isoformat()

    # -- layers

    def _event_table(self) -> EventTable:
        """The event table; one of the earlier layout, a folder of Parquet files that a pointer may name, is taken over."""
        home, pointer = f"{self.root}/episodic/events", f"{self.root}/episodic/current"
        old = home
        if os.path.exists(pointer):
            with open(pointer) as f:
                old = f"{self.root}/episodic/{f.read().strip()}"
        beside = f"{self.root}/episodic/earlier"
        if os.path.isdir(old) and any(x.endswith(".parquet") for x in os.listdir(old)):
            os.replace(old, beside)
        table = EventTable(self.spark, home)
        if os.path.isdir(beside):
            if not table.manifest()["segments"]:
                table.replace(self.spark.read.schema(table.schema).parquet(beside))
            shutil.rmtree(beside)
        if os.path.exists(pointer):
            os.remove(pointer)
        return table

    def events(self) -> DataFrame:
        """Live events with their tier."""
        return self.live_events.read()

    def _vector(self, value: str) -> list[float]:
        return [float(x) for x in self.spark.range(1).select(self.embed(F.lit(value)).alias("v")).first()["v"]]

    def _append_event(self, kind: str, payload: str, scope: str, tags: list[str], weight: float) -> str:
        now = datetime.now(timezone.utc)
        event_id = ulid.new()
        row = {"id": event_id, "kind": kind, "scope": scope, "payload": payload, "tags": tags, "retrieval_weight": weight, "last_accessed": now, "created_at": now, "tier": "hot"}
        self.live_events.append(row)
        self.activity += 1
        return event_id

    def _log(self, op: dict) -> None:
        """Append an op and compact when enough of them wait."""
        self.store.append([op])
        self.activity += 1
        if self.store.pending() >= self.settings.checkpoints.snapshot_inserts:
            self.store.compact()

    def _turn(self, role: str, content: str) -> None:
        self.session["turns"].append({"role": role, "content": content, "at": self._now()})
        self.unsaved += 1
        if self.unsaved >= self.settings.checkpoints.session_interval_turns:
            self.checkpoint()

    def checkpoint(self, clean: bool = False) -> None:
        self.session |= {"last_checkpoint_at": self._now(), "clean_shutdown": clean}
        sessions.write(f"{self.root}/sessions", self.session)
        self.unsaved = 0
        self.checkpoints_total += 1

    def open(self, timers: bool = True) -> None:
        """Begin to serve: the event that opens the session, and the background jobs."""
        from lamina.streaming import jobs

        self.opened = True
        start = {"session_id": self.session["id"], "started_at": self.session["started_at"], "embedder": self.store.model, "embed_dim": self.store.dim}
        self._append_event("session_start", json.dumps(start), self.scope, [], 0.5)
        if timers:
            self.timers = [jobs.checkpoints(self), jobs.consolidations(self)]

    def close(self) -> None:
        """Stop the jobs, close the session with its event, save it, and compact what waits."""
        for timer in self.timers:
            timer.stop()
        if self.opened:
            end = {"session_id": self.session["id"], "ended_at": self._now(), "clean_shutdown": True, "turns_total": len(self.session["turns"]), "checkpoints_total": self.checkpoints_total}
            self._append_event("session_end", json.dumps(end), self.scope, [], 0.5)
        self.checkpoint(clean=True)
        self.live_events.purge()
        if self.store.pending():
            self.store.compact()
        self.store.close()

    # -- dispatch

    def call(self, tool: str, arguments: dict | None = None) -> dict:
        """Run a tool and record the call in the event log, or the failure without its arguments."""
        if tool not in TOOLS:
            raise NotFound(f"no tool {tool}")
        with self.lock:
            return self._call(tool, arguments or {})

    def _call(self, tool: str, arguments: dict) -> dict:
        try:
            answer = getattr(self, tool)(**{("kind" if k == "type" else k): v for k, v in arguments.items()})
        except Exception as e:
            message = str(e)
            message = message[: text.MESSAGE_CAP] + "…" if len(message.encode()) > text.MESSAGE_CAP else message
            self._append_event("tool_call_failed", json.dumps({"tool": tool, "error_kind": type(e).__name__, "message": message}), self.scope, [], 0.5)
            if isinstance(e, TypeError):
                raise InvalidArguments(message) from e
            raise
        self._turn("tool", tool)
        wanted = diagnostics.RECORDED_ARGUMENTS.get(tool, {})
        recorded = {"tool": tool} | {label: arguments[key] for key, label in wanted.items() if arguments.get(key) is not None}
        self._append_event("tool_call", json.dumps(recorded), self.scope, [], 0.5)
        return answer

    def _near(self, query: list[float], k: int) -> DataFrame:
        """(id, distance) by the stored index; items written since its version lie over it, and enough of them make a new one."""
        items, last = self.store.items().where("embedding is not null"), self.store.last_lsn()
        if self.index.manifest() is None:
            self.index.build(items.select("id", "embedding"), last)
        fresh = items.where(F.col("lsn") > self.index.applied_lsn()).select("lsn", F.lit("insert").alias("op"), "id", "embedding")
        log = fresh
        if self.index.manifest()["entries"]:
            gone = self.index.rows().select("id").join(items, "id", "left_anti")
            log = fresh.unionByName(gone.select(F.lit(last).alias("lsn"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("embedding")))
        if self.index.rebuild_if_due(log, self.settings.checkpoints.snapshot_inserts):
            log = log.limit(0)
        asked = self.spark.createDataFrame([(0, query)], "qid long, embedding array<float>")
        return self.index.search(asked, k, log).select("id", "distance")

    # -- tools

    def remember(self, content=None, kind=None, tags=None, scope=None, pinned=None) -> dict:
        """Keep a fact, preference or decision; answers with its id."""
        content, item_id = _text(content, "content"), ulid.new()
        self._log({
            "op": "insert", "id": item_id, "content": content, "kind": _kind(kind, "fact"), "tags": _tags(tags), "scope": scope or self.scope,
            "created_at": datetime.now(timezone.utc), "embedding": self._vector(content),
        })
        return {"id": item_id}

    def recall(self, query=None, limit=None, scope=None, kind=None, mode="exact") -> dict:
        """The items nearest to a query; mode graph searches the stored index and filters four times as many, as overfetch does."""
        limit = _limit(limit, self.settings.budgets.default_recall_limit, 100)
        items = self.store.items()
        vector = self._vector(_text(query, "query"))
        if mode == "graph":
            found = episodic.selected(items.join(self._near(vector, OVERFETCH * limit), "id"), scope, _kind(kind))
            hits = found.withColumnRenamed("distance", "score").orderBy("score", "id").limit(limit)
        else:
            hits = recall(items if mode == "exact" else items.drop("embedding"), items.select("id", "embedding"), vector, limit, scope, _kind(kind), mode)
        rows = hits.withColumn("created_at", text.rfc3339(F.col("created_at"))).select("id", "content", "kind", "tags", "scope", "created_at", "score").collect()
        return {"hits": [r.asDict() for r in rows]}

    def update(self, id=None, content=None, kind=None, tags=None, scope=None) -> dict:
        """Change fields of an item."""
        item_id = _text(id, "id")
        patch = {k: v for k, v in (("kind", _kind(kind)), ("scope", scope), ("tags", None if tags is None else _tags(tags, nested=False))) if v is not None}
        if content is not None:
            patch |= {"content": _text(content, "content"), "embedding": self._vector(_text(content, "content"))}
        if self.store.items().where(F.col("id") == item_id).isEmpty():
            return {"updated": False}
        if patch:
            self._log({"op": "patch", "id": item_id} | patch)
        return {"updated": True}

    def forget(self, id=None, query=None, scope=None) -> dict:
        """Remove an item, a pin or an event by its id."""
        if sum(x is not None for x in (id, query, scope)) != 1:
            raise InvalidArguments("exactly one of id, query and scope")
        if id is None:
            raise InvalidArguments("only forgetting by id is implemented")
        if not self.store.items().where(F.col("id") == id).isEmpty():
            self._log({"op": "delete", "id": id})
            return {"forgotten": True, "layer": "semantic"}
        if pins.remove(self.pins_path, id):
            return {"forgotten": True, "layer": "procedural"}
        found = episodic.find(self.events(), id).where("tier <> 'cold'").first()
        if found is None:
            return {"forgotten": False, "layer": None}
        self.live_events.forget(id)
        self.activity += 1
        return {"forgotten": True, "layer": found["tier"]}

    def pin(self, content=None, tags=None, scope=None) -> dict:
        """Pin a rule that is always part of the context."""
        made = pins.append(self.pins_path, _text(content, "content"), scope or self.scope, _tags(tags))
        self.activity += 1
        return {"id": made}

    def unpin(self, id=None) -> dict:
        """Remove a pinned rule."""
        removed = pins.remove(self.pins_path, _text(id, "id"))
        self.activity += removed
        return {"removed": removed}

    def recall_recent(self, limit=None, scope=None, kind=None) -> dict:
        """The latest events."""
        rows = episodic.recall_recent(self.events().where("tier = 'hot'"), _limit(limit, 20, 200), scope, kind)
        return {"events": [r.asDict() for r in rows.withColumn("created_at", text.rfc3339(F.col("created_at"))).withColumn("last_accessed", text.rfc3339(F.col("last_accessed"))).collect()]}

    def summarize_session(self, events=None, scope=None) -> dict:
        """A prompt that asks for a summary of the latest events."""
        return {"prompt": diagnostics.summary_prompt(self.events().where("tier = 'hot'"), _limit(events, 30, 200), scope).first()["prompt"]}

    def record_event(self, kind=None, payload=None, tags=None, scope=None, retrieval_weight=None) -> dict:
        """Record an event; user and assistant messages become turns of the session."""
        weight = 0.5 if retrieval_weight is None else retrieval_weight
        if isinstance(weight, bool) or not isinstance(weight, (int, float)) or math.isnan(weight) or not 0 <= weight <= 1:
            raise InvalidArguments("retrieval_weight must be from 0 to 1")
        kind = _text(kind, "kind")
        event_id = self._append_event(kind, json.dumps(payload, ensure_ascii=False), scope or self.scope, _tags(tags), float(weight))
        role = {"user_message": "user", "assistant_message": "assistant"}.get(kind)
        if role and isinstance(payload, dict) and isinstance(payload.get("content"), str) and payload["content"]:
            self._turn(role, payload["content"])
        return {"id": event_id}

    def switch_scope(self, scope=None) -> dict:
        """Set the scope that writes go to."""
        before, self.scope = self.scope, _text(scope, "scope")
        return {"scope": self.scope, "previous": before}

    def stats(self) -> dict:
        """Counts of all layers."""
        rows = tiers.with_quarter(self.events())
        found = {r["name"]: r["n"] for r in diagnostics.counts(self.store.items(), pins.read(self.spark, self.pins_path), rows, ["year", "quarter"]).collect()}
        return {
            "schema_version": SCHEMA_VERSION,
            "memories": {"semantic": found["semantic"], "procedural": found["procedural"], "episodic": {"hot": found["episodic_hot"], "warm": found["episodic_warm"], "cold_quarters": found["cold_quarters"]}, "total_stored": found["total_stored"]},
            "semantic_index": {"applied_lsn": self.store.manifest()["applied_lsn"], "embed_dim": self.store.dim},
            "working": {"session_id": self.session["id"], "turns_total": len(self.session["turns"]), "current_scope": self.scope},
        }

    def list_scopes(self) -> dict:
        """All scopes in use."""
        rows = diagnostics.scopes(pins.read(self.spark, self.pins_path), self.events().where("tier <> 'cold'"), self.store.items())
        return {"scopes": [r["scope"] for r in rows.collect()], "current": self.scope}

    def export(self, scope=None, limit_per_layer=None) -> dict:
        """Rows of all layers."""
        limit = _limit(limit_per_layer, 200, 5000)
        rows = diagnostics.export(pins.read(self.spark, self.pins_path), self.events().where("tier = 'hot'"), self.store.items(), limit, scope)
        out: dict[str, list] = {"procedural": [], "episodic": [], "semantic": []}
        for r in rows.withColumn("created_at", text.rfc3339(F.col("created_at"))).collect():  # 5000 rows a layer at most
            out[r["layer"]].append({k: v for k, v in r.asDict().items() if k != "layer"})
        return out

    # -- resources

    def resource(self, name: str, argument: str | None = None) -> dict:
        if name == "stats":
            return self.stats()
        if name == "recent":
            rows = self.recall_recent(20)["events"]
            return {"events": [{k: v for k, v in r.items() if k not in ("retrieval_weight", "tier")} for r in rows]}
        if name == "procedural":
            rows = pins.read(self.spark, self.pins_path).orderBy("line_no").withColumn("created_at", text.rfc3339(F.col("created_at")))
            return {"pins": [r.asDict() for r in rows.collect()]}
        if name == "session":
            if argument == self.session["id"]:
                return self.session
            found = sessions.read(self.spark, f"{self.root}/sessions").where(F.col("id") == argument).first()
            if found is None:
                raise NotFound(f"no session {argument}")
            return found.asDict(recursive=True)
        if name == "context":
            return self.context()
        raise NotFound(f"no resource {name}")

    def context(self, query: str | None = None, scope: str | None = None, max_tokens: int | None = None) -> dict:
        max_tokens = self.settings.budgets.auto_context_token_budget if max_tokens is None else max_tokens
        items = self.store.items()
        turn_rows = [(i, t["role"], t["content"], datetime.fromisoformat(t["at"])) for i, t in enumerate(self.session["turns"])]
        turns = self.spark.createDataFrame(turn_rows, "turn_idx int, role string, content string, turn_at timestamp")
        vector = self._vector(query) if query else None
        rows = context.build_context(
            pins.read(self.spark, self.pins_path), self.events().where("tier = 'hot'"), items, items.select("id", "embedding"), turns,
            F.lit(datetime.now(timezone.utc)), query=vector, scope=scope, max_tokens=max_tokens, details=True,
        ).orderBy("layer", "pos")
        rows = rows.withColumns({"at": text.rfc3339(F.col("created_at")), "seen": text.rfc3339(F.col("last_accessed"))}).collect()  # 192 at most
        out: dict = {"procedural": [], "episodic": [], "semantic": [], "working": []}
        for r in rows:
            if r["layer"] == "working":
                out["working"].append({"role": r["role"], "content": r["body"]})
                continue
            row = {"id": r["id"], ("payload" if r["layer"] == "episodic" else "content"): r["body"], "tags": r["tags"] or [], "scope": r["scope"], "created_at": r["at"]}
            row |= {"kind": r["kind"]} if r["layer"] != "procedural" else {}
            row |= {"last_accessed": r["seen"]} if r["layer"] == "episodic" else {}
            out[r["layer"]].append(row)
        return out | {"total_tokens": rows[0]["total_tokens"] if rows else 0, "max_tokens": max_tokens}

    # -- background work

    def consolidate(self, now: datetime | None = None) -> dict:
        """One pass: hot to warm to cold by age; archived rows go to their quarters first, then leave the live table."""
        rows = tiers.consolidated(self.events(), F.lit(now or datetime.now(timezone.utc)), self.settings.consolidation.hot_to_warm_days, self.settings.consolidation.warm_to_cold_days)
        counts = tiers.report(rows).first().asDict()
        archived = rows.where("archived").drop("promoted", "archived")
        if counts["archived_to_cold"]:
            self.cold.archive(archived)
        if sum(counts.values()):
            self.live_events.replace(rows.where("not archived").drop("promoted", "archived"))
        return counts
