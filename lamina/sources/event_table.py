"""The live event table: appends in batches, changes merged when rows are read, small files merged by size class.

An event, and a change of one (forgotten, touched), is a line of a journal first, forced to
disk. Once enough lines wait they become a segment of events and a file of changes. Reading
puts segments, journal and changes together; no file of live rows is written anew for a
change. When a size class holds FAN segments they become one of the next class, without
what was forgotten, so n events lie in about FAN * log(n) files. A manifest that is swapped
last names what counts; whatever else a stopped run left behind is ignored and deleted.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lamina.schemas import EPISODIC_EVENT

CHANGES = "seq long, op string, id string, at timestamp"


def resolved(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Events under changes(seq, op, id, at): forgotten ones are gone, touched ones have the time of their last touch."""
    last = changes.groupBy("id").agg(F.max((F.col("op") == "forget").cast("int")).alias("_gone"), F.max_by("at", F.when(F.col("op") == "touch", F.col("seq"))).alias("_at"))
    found = rows.join(last, "id", "left").where("coalesce(_gone, 0) = 0")
    return found.withColumn("last_accessed", F.coalesce("_at", "last_accessed")).select(*rows.columns)


class EventTable:
    #: Segments of a size class that are merged, and lines that wait in the journal, at most.
    FAN, LINES = 8, 256

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.schema = StructType([*EPISODIC_EVENT.fields, StructField("tier", StringType())])
        os.makedirs(root, exist_ok=True)
        if not os.path.exists(f"{root}/manifest.json"):
            self._swap({"segments": [], "changes": [], "seq": 0, "journal": "journal-0"})
        self._tidy()
        self.lines = self._read_journal()

    # -- manifest and journal

    def manifest(self) -> dict:
        with open(f"{self.root}/manifest.json") as f:
            return json.load(f)

    def _swap(self, manifest: dict) -> None:
        with open(f"{self.root}/manifest.tmp", "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.root}/manifest.tmp", f"{self.root}/manifest.json")

    def _tidy(self) -> None:
        """Delete what the manifest doesn't name."""
        found = self.manifest()
        named = {"manifest.json", found["journal"], *found["changes"], *(s["name"] for s in found["segments"])}
        for name in os.listdir(self.root):
            if name not in named and name.startswith(("segment-", "changes-", "journal-", "manifest.tmp")):
                path = f"{self.root}/{name}"
                shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)

    def _read_journal(self) -> list[dict]:
        path, lines = f"{self.root}/{self.manifest()['journal']}", []
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    try:
                        lines.append(json.loads(line))
                    except ValueError:  # the line that a stopped run was writing
                        break
        return lines

    def _write(self, line: dict) -> None:
        seq = self.lines[-1]["seq"] + 1 if self.lines else self.manifest()["seq"] + 1
        line = line | {"seq": seq}
        with open(f"{self.root}/{self.manifest()['journal']}", "a", encoding="utf-8") as f:
            f.write(json.dumps(line, ensure_ascii=False) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.lines.append(line)
        if len(self.lines) >= self.LINES:
            self.flush()

    # -- writes

    def append(self, event: dict) -> None:
        """Add an event: the columns of the table, times with their zone."""
        times = {c: event[c].astimezone(timezone.utc).isoformat() for c in ("last_accessed", "created_at")}
        self._write({"op": "event", "row": event | times})

    def forget(self, event_id: str) -> None:
        self._write({"op": "forget", "id": event_id})

    def touch(self, event_id: str, at: datetime) -> None:
        self._write({"op": "touch", "id": event_id, "at": at.astimezone(timezone.utc).isoformat()})

    def _journal_frames(self) -> tuple[DataFrame, DataFrame]:
        time = lambda x: datetime.fromisoformat(x) if x else None
        names = self.schema.names
        events = [tuple(time(x["row"][c]) if c in ("last_accessed", "created_at") else x["row"].get(c) for c in names) for x in self.lines if x["op"] == "event"]
        changes = [(x["seq"], x["op"], x["id"], time(x.get("at"))) for x in self.lines if x["op"] != "event"]
        return self.spark.createDataFrame(events, self.schema), self.spark.createDataFrame(changes, CHANGES)

    def flush(self) -> None:
        """Turn the journal into a segment and a file of changes, then merge the classes that are full."""
        if not self.lines:
            return
        events, changes = self._journal_frames()
        found, mark = self.manifest(), uuid.uuid4().hex
        rows = sum(x["op"] == "event" for x in self.lines)
        new = found | {"seq": self.lines[-1]["seq"], "journal": f"journal-{mark}", "segments": list(found["segments"]), "changes": list(found["changes"])}
        if rows:
            events.coalesce(1).sortWithinPartitions("tier", "created_at", "id").write.parquet(f"{self.root}/segment-{mark}")
            new["segments"].append({"name": f"segment-{mark}", "rows": rows, "level": 0})
        if rows < len(self.lines):
            changes.coalesce(1).write.parquet(f"{self.root}/changes-{mark}")
            new["changes"].append(f"changes-{mark}")
        self._swap(new)
        self.lines = []
        self.merge()
        self._tidy()

    def merge(self) -> None:
        """Merge the segments of each class that has FAN of them into one of the next class; many files of changes make one."""
        found = self.manifest()
        for level in range(64):
            own = [s for s in found["segments"] if s["level"] == level]
            if len(own) < self.FAN:
                continue
            name = f"segment-{uuid.uuid4().hex}"
            rows = resolved(self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s['name']}" for s in own)), self._changes(found))
            files = max(1, sum(s["rows"] for s in own) // 5_000_000)
            placed = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "tier", "created_at", "id")
            placed.sortWithinPartitions("tier", "created_at", "id").write.parquet(f"{self.root}/{name}")
            n = self.spark.read.parquet(f"{self.root}/{name}").count()
            found = found | {"segments": [s for s in found["segments"] if s["level"] != level] + [{"name": name, "rows": n, "level": level + 1}]}
            self._swap(found)
        if len(found["changes"]) >= self.FAN:
            name = f"changes-{uuid.uuid4().hex}"
            latest = self._changes(found).groupBy("id", "op").agg(F.max_by(F.struct("seq", "at"), "seq").alias("l")).select("l.seq", "op", "id", "l.at")
            latest.coalesce(1).write.parquet(f"{self.root}/{name}")
            self._swap(found | {"changes": [name]})

    def _changes(self, found: dict) -> DataFrame:
        _, waiting = self._journal_frames()
        if not found["changes"]:
            return waiting
        return self.spark.read.schema(CHANGES).parquet(*(f"{self.root}/{c}" for c in found["changes"])).unionByName(waiting)

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew, without what was forgotten; its rows may come from this table."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.root}/{name}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}").count()
        found, level = self.manifest(), 0
        while self.LINES * self.FAN ** (level + 1) < n:
            level += 1
        seq = self.lines[-1]["seq"] if self.lines else found["seq"]
        self._swap({"segments": [{"name": name, "rows": n, "level": level}], "changes": [], "seq": seq, "journal": f"journal-{uuid.uuid4().hex}"})
        self.lines = []
        self._tidy()

    def purge(self) -> None:
        """Write anew the segments that hold forgotten rows, so that these leave the disk."""
        self.flush()
        found = self.manifest()
        if not found["changes"]:
            return
        segments = []
        for s in found["segments"]:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/{s['name']}")
            kept = resolved(rows, self._changes(found))
            name = f"segment-{uuid.uuid4().hex}"
            if rows.join(self._changes(found), "id", "left_semi").take(1):
                kept.coalesce(max(1, s["rows"] // 5_000_000)).write.parquet(f"{self.root}/{name}")
                s = s | {"name": name, "rows": self.spark.read.parquet(f"{self.root}/{name}").count()}
            segments.append(s)
        self._swap(found | {"segments": segments, "changes": []})
        self._tidy()

    # -- reads

    def read(self) -> DataFrame:
        """Live events with their tier."""
        found = self.manifest()
        rows, changes = self._journal_frames()
        if found["segments"]:
            rows = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s['name']}" for s in found["segments"])).unionByName(rows)
        if not found["changes"] and not any(x["op"] != "event" for x in self.lines):
            return rows
        return resolved(rows, self._changes(found))

    def files(self) -> int:
        """Files of rows, of changes and of the journal."""
        return sum(name.endswith(".parquet") or name.startswith("journal-") for _, _, names in os.walk(self.root) for name in names)
