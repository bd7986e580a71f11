"""The op-log store: append-only Parquet files, a compacted snapshot, and a manifest that is swapped last.

One writer at a time (a lock file with its process id); any number of readers.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import oplog
from lamina.schemas import OPLOG, SCHEMA_VERSION


#: Steps by the schema version they start from; each leads to the next version.
MIGRATIONS: dict = {}


class OpLogStore:
    def __init__(self, spark: SparkSession, root: str, dim: int, model: str = "stub"):
        self.spark, self.root, self.dim, self.model = spark, root, dim, model
        #: Held from the choice of the next lsn until its rows are there: tools, streams and compaction write one after another.
        self.mutex = threading.RLock()
        os.makedirs(f"{root}/oplog", exist_ok=True)
        self._lock()
        if not os.path.exists(f"{root}/manifest.json"):
            self._swap({"schema_version": SCHEMA_VERSION, "applied_lsn": 0, "snapshot": None, "dim": dim, "model": model})
        self.migrate()

    # -- manifest and lock

    def _lock(self) -> None:
        path = f"{self.root}/lock"
        if os.path.exists(path):
            with open(path) as f:
                owner = int(f.read() or 0)
            if owner != os.getpid() and os.path.exists(f"/proc/{owner}"):
                raise RuntimeError(f"process {owner} holds {self.root}")
        with open(path, "w") as f:
            f.write(str(os.getpid()))

    def close(self) -> None:
        if os.path.exists(f"{self.root}/lock"):
            os.remove(f"{self.root}/lock")

    def manifest(self) -> dict:
        with open(f"{self.root}/manifest.json") as f:
            return json.load(f)

    def _swap(self, manifest: dict) -> None:
        with open(f"{self.root}/manifest.tmp", "w") as f:
            json.dump(manifest, f)
        os.replace(f"{self.root}/manifest.tmp", f"{self.root}/manifest.json")

    def migrate(self, steps: dict | None = None, target: int = SCHEMA_VERSION) -> int:
        """Bring the manifest to the target schema, a step at a time in ascending order; returns the number of steps run.

        Each step takes the store and is followed by a swap of the manifest, so a run that stops goes on where it was.
        """
        steps, done = MIGRATIONS if steps is None else steps, 0
        while (found := self.manifest())["schema_version"] != target:
            at = found["schema_version"]
            if at > target:
                raise ValueError(f"the store has schema {at}; this engine reads up to {target}")
            if at not in steps:
                raise ValueError(f"no step leads from schema {at}")
            steps[at](self)
            self._swap(self.manifest() | {"schema_version": at + 1})
            done += 1
        return done

    # -- log

    def _files(self) -> list[tuple[int, int, str]]:
        """(first lsn, last lsn, path) by the names of the log's folders, in order; a folder counts once it is complete."""
        found = []
        for name in os.listdir(f"{self.root}/oplog"):
            if name.startswith("ops-") and os.path.exists(f"{self.root}/oplog/{name}/_SUCCESS"):
                first, last = name.split("-")[1:3]
                found.append((int(first), int(last), f"{self.root}/oplog/{name}"))
        return sorted(found)

    def applied(self, stream: str) -> int:
        """The last batch of a stream that the log or the snapshot holds, -1 if none."""
        last = self.manifest().get("streams", {}).get(stream, -1)
        for _, _, path in self._files():
            parts = os.path.basename(path).split("-")  # ops, first, last, stream, batch
            if len(parts) == 5 and parts[3] == stream:
                last = max(last, int(parts[4]))
        return last

    def last_lsn(self) -> int:
        files = self._files()
        return max(self.manifest()["applied_lsn"], files[-1][1] if files else 0)

    def append(self, ops: list[dict]) -> int:
        """Write a group of ops as one file, or none of them; returns the last lsn."""
        with self.mutex:
            return self._append(ops)

    def _append(self, ops: list[dict]) -> int:
        first = self.last_lsn() + 1
        rows = [tuple(lsn if f.name == "lsn" else op.get(f.name) for f in OPLOG.fields) for lsn, op in enumerate(ops, first)]
        for row in rows:
            if row[-1] is not None and len(row[-1]) != self.dim:
                raise ValueError(f"vectors must have {self.dim} values")
        last = first + len(rows) - 1
        target = f"{self.root}/oplog/ops-{first:020d}-{last:020d}"
        self.spark.createDataFrame(rows, OPLOG).coalesce(1).write.mode("overwrite").parquet(target)
        return last

    def append_batch(self, ops: DataFrame, stream: str, number: int) -> bool:
        """Write batch `number` of a stream from the executors: all of it or none, and once only; whether it was written now.

        The folder's name carries the batch, so the rows and the fact that they are there become visible together.
        """
        if not stream.isalnum():
            raise ValueError("the name of a stream has letters and digits only")
        with self.mutex:
            return number > self.applied(stream) and self._append_batch(ops, stream, number)

    def _append_batch(self, ops: DataFrame, stream: str, number: int) -> bool:
        # a monotonically increasing id is the number of a partition, and in its low 33 bits that of a row in it
        ops = ops.withColumn("_at", F.monotonically_increasing_id()).persist()
        part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
        try:
            sizes = sorted(tuple(r) for r in ops.groupBy(part.alias("p")).count().collect())  # one row a partition
            if not sizes:
                return False
            first = at = self.last_lsn() + 1
            starts = []
            for p, n in sizes:
                starts.append((p, at))
                at += n
            begin = F.broadcast(self.spark.createDataFrame(starts, "_p long, _first long"))
            wrong = F.size("embedding") != self.dim
            checked = F.when(wrong, F.raise_error(F.lit(f"vectors must have {self.dim} values")).cast("array<float>")).otherwise(F.col("embedding"))
            rows = ops.withColumn("_p", part).join(begin, "_p").withColumn("lsn", F.col("_first") + place).withColumn("embedding", checked)
            rows = rows.select(*(F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in OPLOG.fields))
            rows.write.mode("overwrite").parquet(f"{self.root}/oplog/ops-{first:020d}-{at - 1:020d}-{stream}-{number:020d}")
        finally:
            ops.unpersist()
        return True

    def log(self) -> DataFrame:
        """Ops after the snapshot."""
        applied = self.manifest()["applied_lsn"]
        paths = [p for _, last, p in self._files() if last > applied]
        if not paths:
            return self.spark.createDataFrame([], OPLOG)
        return self.spark.read.schema(OPLOG).parquet(*paths).where(F.col("lsn") > applied)

    def snapshot(self) -> DataFrame:
        at = self.manifest()["snapshot"]
        return self.spark.read.schema(OPLOG).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], OPLOG)

    # -- state

    def items(self) -> DataFrame:
        """Current rows: the snapshot's, under the ops since then."""
        return oplog.merged(self.snapshot().unionByName(self.log()))

    def compact(self) -> int:
        """Write the current rows as a new snapshot, swap the manifest, drop covered files; returns the snapshot's lsn."""
        with self.mutex:
            return self._compact()

    def _compact(self) -> int:
        last = self.last_lsn()
        name = f"snapshot-{uuid.uuid4().hex}"
        rows = self.items().withColumn("op", F.lit("insert")).select([f.name for f in OPLOG.fields])
        rows.write.parquet(f"{self.root}/{name}")
        old = self.manifest()
        names = [os.path.basename(path).split("-") for _, _, path in self._files()]
        streams = {s: self.applied(s) for s in {x[3] for x in names if len(x) == 5} | set(old.get("streams", {}))}
        self._swap(old | {"applied_lsn": last, "snapshot": name, "streams": streams})
        for _, covered, path in self._files():
            if covered <= last:
                shutil.rmtree(path)
        self._drop_snapshot(old["snapshot"])
        return last

    def pending(self) -> int:
        return self.last_lsn() - self.manifest()["applied_lsn"]

    def reembed(self, model: str, dim: int, embed, ranges: int = 8) -> int:
        """Recompute every vector under another model; returns the number of rows left out, those without content.

        Rows are dealt to `ranges` by their ids, each written on its own and noted in the manifest, so a
        run that stops goes on where it was, unless ops came in between. The new state counts only once
        all ranges are there.
        """
        with self.mutex:
            found, last = self.manifest(), self.last_lsn()
            if (found["model"], found["dim"]) == (model, dim):
                return 0
            plan = found.get("reembed")
            if plan is None or (plan["model"], plan["dim"], plan["lsn"], plan["ranges"]) != (model, dim, last, ranges):
                if plan:
                    shutil.rmtree(f"{self.root}/{plan['folder']}", ignore_errors=True)
                plan = {"model": model, "dim": dim, "lsn": last, "ranges": ranges, "folder": f"snapshot-{uuid.uuid4().hex}", "done": [], "skipped": 0}
                self._swap(found | {"reembed": plan})
            for k in (k for k in range(ranges) if k not in plan["done"]):
                rows = self.items().where(F.pmod(F.xxhash64("id"), F.lit(ranges)) == k).persist()
                try:
                    skipped = rows.where("content is null").count()
                    rows = rows.where("content is not null").withColumn("embedding", F.transform(embed(F.col("content")), lambda x: x.cast("float"))).withColumn("op", F.lit("insert"))
                    rows.select([f.name for f in OPLOG.fields]).write.mode("overwrite").parquet(f"{self.root}/{plan['folder']}/range-{k:06d}")
                finally:
                    rows.unpersist()
                plan = plan | {"done": [*plan["done"], k], "skipped": plan["skipped"] + skipped}
                self._swap(self.manifest() | {"reembed": plan})
            new = {k: v for k, v in self.manifest().items() if k != "reembed"}
            self._swap(new | {"applied_lsn": last, "snapshot": f"{plan['folder']}/range-*", "model": model, "dim": dim})
            self.model, self.dim = model, dim
            for _, _, path in self._files():
                shutil.rmtree(path)
            self._drop_snapshot(found["snapshot"])
            return plan["skipped"]

    def _drop_snapshot(self, name: str | None) -> None:
        if name:
            shutil.rmtree(f"{self.root}/{name.split('/')[0]}", ignore_errors=True)
