"""The op log as a data source of its own: spark.read.format("oplog") and spark.readStream.format("oplog").

Planning lists the log's folders, whose names carry their first and last lsn. Comparisons
of `lsn` with constants are pushed down: folders outside them get no partition, and rows
are filtered as they are read. The stream's offset is the last lsn it has given. With
`opsPerTrigger` a batch of a running stream holds about so many ops at most (whole folders,
one at least); a stream that takes what is there and ends (availableNow) asks for its end
once, and should be run without it. Compaction removes folders: a reader that starts below the snapshot's lsn
fails rather than leave ops out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lamina.schemas import OPLOG


class Folder(InputPartition):
    """Ops `first` to `last` of a folder of the log."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__(path)
        self.path, self.first, self.last = path, first, last


def folders(root: str) -> list[Folder]:
    """Complete folders of a log in order."""
    found = []
    for name in os.listdir(f"{root}/oplog"):
        if name.startswith("ops-") and os.path.exists(f"{root}/oplog/{name}/_SUCCESS"):
            first, last = name.split("-")[1:3]
            found.append(Folder(f"{root}/oplog/{name}", int(first), int(last)))
    return sorted(found, key=lambda f: f.first)


def _within(parts: Iterable[Folder], low: int, high: int) -> list[Folder]:
    """The parts' ops with low <= lsn <= high."""
    return [Folder(p.path, max(low, p.first), min(high, p.last)) for p in parts if p.last >= low and p.first <= high]


def _read(part: Folder | None, schema: StructType) -> Iterator[pa.RecordBatch]:
    if part is None:  # Spark reads once where there is no partition
        return
    import pyarrow.dataset as ds
    from pyspark.sql.pandas.types import to_arrow_schema

    lsn = ds.field("lsn")
    table = ds.dataset(part.path, format="parquet", exclude_invalid_files=True).to_table(columns=schema.names, filter=(lsn >= part.first) & (lsn <= part.last))
    yield from table.cast(to_arrow_schema(schema)).to_batches()


class OpLogReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType):
        self.root, self.schema, self.low, self.high = root, schema, 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of lsn with a constant; Spark applies all others."""
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == ("lsn",):
                continue  # every op has a number
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("lsn",) or not isinstance(value, int):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        return _within(folders(self.root), self.low, self.high)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema)


class OpLogStream(DataSourceStreamReader):
    def __init__(self, root: str, schema: StructType, ops: int, start: int):
        self.root, self.schema, self.ops, self.start = root, schema, ops, start
        self.given: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        with open(f"{self.root}/manifest.json") as f:
            applied = json.load(f)["applied_lsn"]
        if applied > self.start:
            raise ValueError(f"ops up to {applied} are in the snapshot; the stream begins after {self.start}")
        return {"lsn": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self.given if self.given is not None else self.start
        for n, part in enumerate(_within(folders(self.root), last + 1, (1 << 63) - 1)):
            if n and part.last - (self.given or self.start) > self.ops:
                break
            last = part.last
        self.given = last
        return {"lsn": last}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return _within(folders(self.root), start["lsn"] + 1, end["lsn"])

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.schema)

    def commit(self, end: dict) -> None:
        self.given = end["lsn"]


class OpLogSource(DataSource):
    """Options: path (the store's folder); opsPerTrigger and startAfter for streams."""

    @classmethod
    def name(cls) -> str:
        return "oplog"

    def schema(self) -> StructType:
        return OPLOG

    def reader(self, schema: StructType) -> OpLogReader:
        return OpLogReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> OpLogStream:  # noqa: N802
        return OpLogStream(self.options["path"], schema, int(self.options.get("opsPerTrigger", 1 << 62)), int(self.options.get("startAfter", 0)))


def register(spark) -> None:
    """Make the format known to a session, with pushdown of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OpLogSource)
