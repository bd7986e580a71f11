"""What a log store offers, and one that lives in memory beside the stored one."""

from __future__ import annotations

import threading
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import oplog
from lamina.schemas import OPLOG, SCHEMA_VERSION


class LogStore(Protocol):
    """Ops in the order of their numbers, and the rows that they lead to."""

    dim: int
    model: str

    def append(self, ops: list[dict]) -> int:
        """Add a group of ops, all of them or none; returns the last lsn."""

    def append_batch(self, ops: DataFrame, stream: str, number: int) -> bool:
        """Add batch `number` of a stream once; whether it was added now."""

    def last_lsn(self) -> int: ...

    def log(self) -> DataFrame:
        """Ops after the snapshot."""

    def items(self) -> DataFrame:
        """Current rows."""

    def pending(self) -> int:
        """Ops that wait for the next snapshot."""

    def compact(self) -> int:
        """Take all ops into a snapshot; returns its lsn."""

    def manifest(self) -> dict: ...

    def close(self) -> None: ...


class MemoryLogStore:
    """A LogStore for tests and throw-away sessions: ops are rows on the driver, at most as many as one process can hold."""

    def __init__(self, spark: SparkSession, dim: int, model: str = "stub"):
        self.spark, self.dim, self.model = spark, dim, model
        self.ops: list[tuple] = []
        self.streams: dict[str, int] = {}
        self.applied_lsn, self.mutex = 0, threading.RLock()

    def append(self, ops: list[dict]) -> int:
        with self.mutex:
            first = self.last_lsn() + 1
            rows = [tuple(lsn if f.name == "lsn" else op.get(f.name) for f in OPLOG.fields) for lsn, op in enumerate(ops, first)]
            if any(row[-1] is not None and len(row[-1]) != self.dim for row in rows):
                raise ValueError(f"vectors must have {self.dim} values")
            self.ops += rows
            return self.last_lsn()

    def append_batch(self, ops: DataFrame, stream: str, number: int) -> bool:
        with self.mutex:
            if number <= self.streams.get(stream, -1):
                return False
            rows = [r.asDict() for r in ops.collect()]
            if not rows:
                return False
            self.append(rows)
            self.streams[stream] = number
            return True

    def last_lsn(self) -> int:
        return self.ops[-1][0] if self.ops else 0

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, OPLOG)

    def log(self) -> DataFrame:
        return self._frame([r for r in self.ops if r[0] > self.applied_lsn])

    def snapshot(self) -> DataFrame:
        return oplog.merged(self._frame([r for r in self.ops if r[0] <= self.applied_lsn])).withColumn("op", F.lit("insert")).select(*OPLOG.names)

    def items(self) -> DataFrame:
        return oplog.merged(self._frame(self.ops))

    def pending(self) -> int:
        return self.last_lsn() - self.applied_lsn

    def compact(self) -> int:
        self.applied_lsn = self.last_lsn()
        return self.applied_lsn

    def manifest(self) -> dict:
        return {"schema_version": SCHEMA_VERSION, "applied_lsn": self.applied_lsn, "snapshot": None, "dim": self.dim, "model": self.model, "streams": dict(self.streams)}

    def close(self) -> None:
        pass
