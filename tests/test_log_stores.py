import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.plans.tools import Engine
from lamina.schemas import OPLOG
from lamina.session import Scratch
from lamina.sources import oplog_source
from lamina.sources.storage import MemoryLogStore
from lamina.sources.store import OpLogStore
from lamina.streaming import events, jobs

NOW = datetime(2026, 1, 1)


def make(spark, kind, path):
    return OpLogStore(spark, str(path), 2) if kind == "stored" else MemoryLogStore(spark, 2)


def state(store):
    return sorted((r["id"], r["content"], r["scope"], tuple(r["embedding"] or ())) for r in store.items().collect())


@pytest.mark.parametrize("kind", ["stored", "memory"])
def test_stores_keep_one_contract(spark, tmp_path, kind):
    """Groups of random ops against a plain dictionary, with compactions between."""
    rng, store, want, n = random.Random(5), make(spark, kind, tmp_path), {}, 0
    for step in range(6):
        group = []
        for _ in range(rng.randint(1, 12)):
            i, op = f"i{rng.randrange(8)}", rng.choice(["insert", "patch", "delete"])
            row = {"op": op, "id": i} | ({} if op == "delete" else {"content": f"c{n}"} if op == "patch" else {"content": f"c{n}", "scope": f"s{n}", "created_at": NOW, "embedding": [1.0, float(n)]})
            n += 1
            group.append(row)
            if op == "delete":
                want.pop(i, None)
            elif op == "insert":
                want[i] = (i, row["content"], row["scope"], tuple(row["embedding"]))
            elif i in want:
                want[i] = (i, row["content"], *want[i][2:])
        assert store.append(group) == store.last_lsn() == n
        with pytest.raises(ValueError):
            store.append([{"op": "insert", "id": "bad", "embedding": [1.0]}])
        assert store.last_lsn() == n and state(store) == sorted(want.values())
        if step % 2:
            assert store.compact() == n and store.pending() == 0 and store.log().count() == 0 and state(store) == sorted(want.values())
    batch = spark.createDataFrame([(0, "insert", "b", "t", "fact", [], "s", NOW, [0.0, 1.0])], OPLOG)
    assert store.append_batch(batch, "ops", 3) and not store.append_batch(batch, "ops", 3) and store.last_lsn() == n + 1
    store.close()


def test_the_engine_runs_on_either_store(spark, tmp_path):
    e = Engine(spark, str(tmp_path), store=MemoryLogStore(spark, 32))
    a = e.call("remember", {"content": "kept in memory"})["id"]
    assert e.call("recall", {"query": "kept in memory", "limit": 1})["hits"][0]["id"] == a and e.call("stats")["memories"]["semantic"] == 1
    e.close()


@pytest.fixture()
def log(spark, tmp_path):
    store = OpLogStore(spark, str(tmp_path / "store"), 2)
    for part in range(5):
        store.append([{"op": "insert", "id": f"i{4 * part + i}", "content": f"c{part}", "tags": ["t"], "created_at": NOW, "embedding": [1.0, 0.0]} for i in range(4)])
    oplog_source.register(spark)
    yield store
    store.close()


def test_filters_on_lsn_choose_the_folders(spark, log):
    rows = spark.read.format("oplog").option("path", log.root).load()
    assert rows.schema == OPLOG
    assert [tuple(r) for r in rows.orderBy("lsn").collect()] == [tuple(r) for r in log.log().orderBy("lsn").collect()]
    for where, lsns, folders in (("lsn > 12", range(13, 21), 2), ("lsn >= 12 and lsn < 14", (12, 13), 2), ("lsn = 7", (7,), 1), ("lsn > 99", (), 0), ("lsn > 18 and id = 'i19'", (20,), 1)):
        found = rows.where(where)
        assert sorted(r["lsn"] for r in found.collect()) == list(lsns) and found.rdd.getNumPartitions() == max(1, folders)
    plan = rows.where("lsn > 12")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan oplog" in plan and "(lsn" not in plan.split("BatchScan")[0]  # no filter is left above the scan


def test_a_stream_of_the_log_is_replayed_in_batches(spark, log, tmp_path):
    stream = spark.readStream.format("oplog").option("path", log.root).load()
    copy = OpLogStore(spark, str(tmp_path / "copy"), 2)
    jobs.group_commit(stream, copy, Scratch(spark, "copied").path("checkpoint")).awaitTermination()
    assert copy.last_lsn() == 20 and sorted(r["id"] for r in copy.items().collect()) == sorted(r["id"] for r in log.items().collect())
    after = events.drained(spark.readStream.format("oplog").option("path", log.root).option("startAfter", 15).load().select("lsn", "id"))
    assert sorted(r["lsn"] for r in after.collect()) == [16, 17, 18, 19, 20]
    copy.close()


def test_a_batch_has_a_bounded_number_of_ops(spark, log):
    own = oplog_source.OpLogStream(log.root, OPLOG, 9, 0)
    at, seen = own.initialOffset(), []
    while (end := own.latestOffset()) != at:
        seen.append([(p.first, p.last) for p in own.partitions(at, end)])
        own.commit(end)
        at = end
    assert seen == [[(1, 4), (5, 8)], [(9, 12), (13, 16)], [(17, 20)]]


def test_a_stream_below_the_snapshot_is_refused(spark, log):
    log.compact()
    log.append([{"op": "delete", "id": "i0"}])
    assert [r["op"] for r in spark.read.format("oplog").option("path", log.root).load().collect()] == ["delete"]
    with pytest.raises(Exception, match="in the snapshot"):
        events.drained(spark.readStream.format("oplog").option("path", log.root).load().select("lsn"))
    assert events.drained(spark.readStream.format("oplog").option("path", log.root).option("startAfter", 20).load().where(F.col("lsn") > 0).select("lsn", "op")).count() == 1


def test_a_stopped_reembedding_goes_on(spark, tmp_path):
    """A run that fails in its third range, and one after it, end as an uninterrupted one; rows without content are counted."""
    whole, stopped = (OpLogStore(spark, str(tmp_path / name), 2) for name in ("whole", "stopped"))
    for store in (whole, stopped):
        store.append([{"op": "insert", "id": f"i{i}", "content": None if i == 7 else "c" * i, "created_at": NOW, "embedding": [1.0, 0.0]} for i in range(20)])
        store.append([{"op": "delete", "id": "i3"}])
    calls = []

    def embed(column):
        return F.array(F.length(column).cast("double"), F.lit(1.0), F.lit(0.0))

    def failing(column):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return embed(column)

    assert whole.reembed("new", 3, embed, ranges=4) == 1
    with pytest.raises(RuntimeError):
        stopped.reembed("new", 3, failing, ranges=4)
    assert stopped.manifest()["model"] == "stub" and stopped.manifest()["reembed"]["done"] == [0, 1] and stopped.items().count() == 19
    assert stopped.reembed("new", 3, failing, ranges=4) == 1 and len(calls) == 5  # two ranges were left
    assert state(stopped) == state(whole) and len(state(whole)) == 18 and all(len(r[3]) == 3 for r in state(whole))
    assert "reembed" not in stopped.manifest() and stopped.reembed("new", 3, embed) == 0
    stopped.append([{"op": "insert", "id": "z", "content": "zz", "created_at": NOW, "embedding": [1.0, 0.0, 0.0]}])
    stopped.compact()
    assert len(state(stopped)) == 19 and len([x for x in os.listdir(tmp_path / "stopped") if x.startswith("snapshot-")]) == 1
    whole.close()
    stopped.close()


def test_ops_between_two_runs_start_reembedding_anew(spark, tmp_path):
    store, calls = OpLogStore(spark, str(tmp_path), 2), []
    store.append([{"op": "insert", "id": f"i{i}", "content": "c", "created_at": NOW, "embedding": [1.0, 0.0]} for i in range(6)])

    def failing(column):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return F.array(F.lit(1.0))

    with pytest.raises(RuntimeError):
        store.reembed("new", 1, failing, ranges=2)
    store.append([{"op": "insert", "id": "late", "content": "c", "created_at": NOW, "embedding": [1.0, 0.0]}])
    store.reembed("new", 1, failing, ranges=2)
    assert [r[3] for r in state(store)] == [(1.0,)] * 7
    store.close()
