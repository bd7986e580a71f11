"""Background jobs: group commit of a stream, compaction by count, checkpoints and consolidation on timers."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from lamina.sources.store import OpLogStore


def group_commit(ops: DataFrame, store: OpLogStore, checkpoint: str, stream: str = "ops"):
    """Append a stream of ops to the log, a folder per micro-batch: all of a batch or none of it, and once only.

    The number of a batch is part of its folder's name and, once compacted, of the manifest:
    a batch that is retried after a failure at any point is found there and not written again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.append_batch(batch.drop("lsn"), stream, number)

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def compact_if_due(store: OpLogStore, inserts: int = 1000, shutdown: bool = False) -> bool:
    """Compact when enough ops wait, or any at shutdown; time alone never does."""
    waiting = store.pending()
    if waiting >= inserts or (shutdown and waiting):
        store.compact()
        return True
    return False


class IdleGate:
    """Lets background work run only if nothing was written since the last tick; the last counter survives restarts."""

    def __init__(self, path: str):
        self.path = path

    def tick(self, activity: int) -> bool:
        last = None
        if os.path.exists(self.path):
            with open(self.path) as f:
                last = json.load(f)["activity"]
        with open(f"{self.path}.tmp", "w") as f:
            json.dump({"activity": activity}, f)
        os.replace(f"{self.path}.tmp", self.path)
        return last == activity


def consolidate_if_idle(engine, gate: IdleGate) -> dict | None:
    """One consolidation pass, or nothing while the store is in use: any write of any layer counts."""
    return engine.consolidate() if gate.tick(engine.activity) else None


class Timer:
    """Runs `work(poked)` every `interval` seconds, or at once when poked, never twice at a time.

    A pass that fails is counted, and the next tick tries again.
    """

    def __init__(self, interval: float, work: Callable[[bool], object]):
        self.interval, self.work = interval, work
        self.runs = self.errors = 0
        self._wake, self._stopped = threading.Event(), False
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        while True:
            poked = self._wake.wait(self.interval)
            self._wake.clear()
            if self._stopped:
                return
            try:
                if self.work(poked) is not None:
                    self.runs += 1
            except Exception:  # noqa: BLE001  the loop goes on
                self.errors += 1

    def poke(self) -> None:
        self._wake.set()

    def stop(self) -> None:
        self._stopped = True
        self._wake.set()
        self._thread.join()


def checkpoints(engine) -> Timer:
    """Saves the session: on the timer if any turn waits, on a poke if enough of them do."""
    settings = engine.settings.checkpoints

    def work(poked: bool) -> bool | None:
        with engine.lock:
            if engine.unsaved < (settings.session_interval_turns if poked else 1):
                return None
            engine.checkpoint()
            return True

    return Timer(settings.session_interval_secs, work)


def consolidations(engine, interval: float = 300.0) -> Timer:
    """Consolidates on the timer, if nothing was written since the last tick."""
    last = engine.activity

    def work(poked: bool) -> dict | None:
        nonlocal last
        with engine.lock:
            if engine.activity != last:
                last = engine.activity
                return None
            done = engine.consolidate()
            last = engine.activity
            return done

    return Timer(interval, work)
