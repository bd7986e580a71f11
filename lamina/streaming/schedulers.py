"""The two background schedulers as stateful streams: per key a value state and an event-time timer.

What a processor emits depends on the times of the rows alone, not on how they fall into
micro-batches: before a row is taken, a timer that is due by its time has its effect, and
a timer that no row overtakes fires once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lamina.streaming import events

SIGNALS = "session_id long, turn_idx long, at timestamp, signal string"
FLUSHES = "session_id long, flushed_at timestamp, reason string, turns long, through long"
TICKS = "store string, tick timestamp, ran boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _millis(at: pd.Series) -> list[int]:
    return (at.astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Checkpoints(StatefulProcessor):
    """Saves a session when `every` turns wait, `seconds` after the first one that waits, and what is left when it closes.

    Rows of a batch are taken by time and turn. A close flushes what waits and is the clean end.
    """

    def __init__(self, every: int = 5, seconds: int = 30):
        self.every, self.millis = every, 1000 * seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", "turns long, due long, through long")

    def _flush(self, key, at: int, reason: str, turns: int, through: int) -> tuple:
        return (key, _time(at), reason, turns, through)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns, due, through = self.state.get() if self.state.exists() else (0, 0, -1)
        old = due if turns else None
        frame = pd.concat(list(rows))  # a session's turns of one micro-batch
        frame = frame.assign(ms=_millis(frame["at"])).sort_values(["ms", "turn_idx"], kind="stable")
        out = []
        for ms, turn, signal in zip(frame["ms"].tolist(), frame["turn_idx"].tolist(), frame["signal"].tolist(), strict=True):
            if turns and due <= ms:
                out.append(self._flush(key[0], due, "timer", turns, through))
                turns = 0
            if signal == "close":
                if turns:
                    out.append(self._flush(key[0], ms, "shutdown", turns, through))
                turns = 0
                continue
            if not turns:
                due = ms + self.millis
            turns, through = turns + 1, turn
            if turns >= self.every:
                out.append(self._flush(key[0], ms, "turns", turns, through))
                turns = 0
        new = due if turns else None
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if turns:
            self.state.update((turns, due, through))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLUSHES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.state.exists():
            turns, due, through = self.state.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                out.append(self._flush(key[0], due, "timer", turns, through))
                self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FLUSHES.split(", ")])

    def close(self) -> None:
        pass


class IdleGates(StatefulProcessor):
    """A tick every `minutes` for each store, on whole multiples: `ran` where nothing was written since the tick before.

    The first write of a store starts its ticks. A tick is emitted by the first row after it or
    by the watermark; ticks between two far writes are emitted one after another.
    """

    def __init__(self, minutes: int = 60):
        self.step = 60_000 * minutes

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "next long, busy boolean")

    def _until(self, key, at: int, following: int, busy: bool) -> tuple[list[tuple], int, bool]:
        """Ticks up to `at`."""
        out = []
        while following <= at:
            out.append((key, _time(following), not busy))
            following, busy = following + self.step, False
        return out, following, busy

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(ms for batch in rows for ms in _millis(batch["at"]))
        following, busy = self.state.get() if self.state.exists() else (times[0] // self.step * self.step + self.step, False)
        old, out = following if self.state.exists() else None, []
        for ms in times:
            more, following, busy = self._until(key[0], ms, following, busy)
            out += more
            busy = True
        if old != following:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(following)
        self.state.update((following, busy))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TICKS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, due = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists() and self.state.get()[0] == due:
            out, following, busy = self._until(key[0], timerValues.getCurrentWatermarkInMs(), *self.state.get())
            self.handle.registerTimer(following)
            self.state.update((following, busy))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TICKS.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Timers and value states need this state store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def checkpoint_flushes(spark: SparkSession, path: str, every: int = 5, seconds: int = 30, lateness: str = "0 seconds", files: int | None = None) -> DataFrame:
    """All flushes that the scheduler makes over a table of turns and closes (SIGNALS); `lateness` as for other streams."""
    rows = events.source(spark, path, SIGNALS, files).withWatermark("at", lateness)
    with rocksdb(spark):
        return events.drained(rows.groupBy("session_id").transformWithStateInPandas(Checkpoints(every, seconds), FLUSHES, "append", "EventTime"))


def idle_gate_ticks(spark: SparkSession, path: str, minutes: int = 60, lateness: str = "0 seconds", files: int | None = None) -> DataFrame:
    """All ticks of the idle gates over a table of writes (store, at) up to the last write's watermark."""
    rows = events.source(spark, path, "store string, at timestamp", files).withWatermark("at", lateness)
    with rocksdb(spark):
        return events.drained(rows.groupBy("store").transformWithStateInPandas(IdleGates(minutes), TICKS, "append", "EventTime"))


def signals(turns: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """SIGNALS of turns(session_id, turn_idx, turn_at), and a close for each row of after(session_id, close_at)."""
    rows = turns.select("session_id", F.col("turn_idx").cast("long").alias("turn_idx"), F.col("turn_at").alias("at"), F.lit("turn").alias("signal"))
    if after is None:
        return rows
    return rows.unionByName(after.select("session_id", F.lit((1 << 62)).cast("long").alias("turn_idx"), F.col("close_at").alias("at"), F.lit("close").alias("signal")))
