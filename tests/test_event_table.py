import json
import os
from datetime import datetime, timedelta, timezone

import pytest

from lamina.plans.tools import Engine
from lamina.sources.event_table import EventTable

AT = datetime(2026, 1, 1, tzinfo=timezone.utc)


def event(i, tier="hot", **more):
    return {"id": f"e{i:05d}", "kind": "note", "scope": "s", "payload": f"p{i}", "tags": ["t"], "retrieval_weight": 0.5, "last_accessed": AT + timedelta(seconds=i), "created_at": AT + timedelta(seconds=i), "tier": tier} | more


def ids(table):
    return sorted(r["id"] for r in table.read().collect())


def stamps(root):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet") and "segment-" in d}


def test_forget_and_touch_leave_live_files_alone(spark, tmp_path):
    table = EventTable(spark, str(tmp_path))
    for i in range(6):
        table.append(event(i))
    table.flush()
    before = stamps(tmp_path)
    table.forget("e00001")
    table.touch("e00002", AT + timedelta(days=1))
    table.touch("e00002", AT + timedelta(days=2))
    assert ids(table) == [f"e{i:05d}" for i in (0, 2, 3, 4, 5)]
    table.flush()
    table.append(event(6))
    assert before == stamps(tmp_path)
    rows = {r["id"]: r for r in table.read().collect()}
    assert rows["e00002"]["last_accessed"] == datetime(2026, 1, 3) and rows["e00003"]["last_accessed"] == datetime(2026, 1, 1, 0, 0, 3) and "e00001" not in rows and len(rows) == 6
    assert rows["e00004"]["tags"] == ["t"] and rows["e00004"]["payload"] == "p4"


def test_files_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(EventTable, "LINES", 20)
    monkeypatch.setattr(EventTable, "FAN", 4)
    table, most, gone = EventTable(spark, str(tmp_path)), 0, set()
    for i in range(500):
        table.append(event(i))
        if i % 7 == 0:
            table.forget(f"e{i // 2:05d}")
            gone.add(f"e{i // 2:05d}")
        most = max(most, table.files())
    assert ids(table) == sorted({f"e{i:05d}" for i in range(500)} - gone)
    assert most <= 3 * 4 + 4 + 2  # less than FAN of each of the classes there are, and of the changes


def test_a_table_goes_on_where_a_run_stopped(spark, tmp_path):
    table = EventTable(spark, str(tmp_path))
    table.append(event(0))
    table.append(event(1))
    table.forget("e00000")
    journal = tmp_path / table.manifest()["journal"]
    with open(journal, "a") as f:
        f.write('{"op": "event", "ro')  # a line that was being written
    os.makedirs(tmp_path / "segment-half")
    assert ids(EventTable(spark, str(tmp_path))) == ["e00001"] and not (tmp_path / "segment-half").exists()


def test_a_failed_flush_loses_nothing(spark, tmp_path, monkeypatch):
    table = EventTable(spark, str(tmp_path))
    for i in range(3):
        table.append(event(i))

    def fail(self, manifest):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(EventTable, "_swap", fail)
        with pytest.raises(OSError):
            table.flush()
    again = EventTable(spark, str(tmp_path))
    assert ids(again) == ["e00000", "e00001", "e00002"]
    again.flush()
    assert ids(again) == ["e00000", "e00001", "e00002"] and len(again.manifest()["segments"]) == 1


def test_purge_takes_forgotten_rows_from_the_disk(spark, tmp_path):
    table = EventTable(spark, str(tmp_path))
    for part in range(2):
        for i in range(3):
            table.append(event(3 * part + i))
        table.flush()
    before = stamps(tmp_path)
    table.forget("e00001")
    table.purge()
    assert len(set(before) & set(stamps(tmp_path))) == 1  # the segment without it is as it was
    raw = spark.read.option("recursiveFileLookup", "true").parquet(*(f"{tmp_path}/{s['name']}" for s in table.manifest()["segments"]))
    assert "e00001" not in {r["id"] for r in raw.collect()} and ids(table) == [f"e{i:05d}" for i in (0, 2, 3, 4, 5)]


def test_consolidation_replaces_the_table(spark, tmp_path):
    table = EventTable(spark, str(tmp_path))
    for i in range(5):
        table.append(event(i))
    table.replace(table.read().where("id <> 'e00003'").selectExpr(*[c for c in table.schema.names if c != "tier"], "'warm' as tier"))
    assert ids(table) == [f"e{i:05d}" for i in (0, 1, 2, 4)] and {r["tier"] for r in table.read().collect()} == {"warm"}
    table.append(event(9))
    assert "e00009" in ids(EventTable(spark, str(tmp_path)))


def test_the_earlier_layout_is_taken_over(spark, tmp_path):
    old = tmp_path / "data" / "episodic" / "events"
    table = EventTable(spark, str(tmp_path / "other"))
    table.append(event(1))
    table.read().coalesce(1).write.parquet(str(old))
    for _ in range(2):
        e = Engine(spark, str(tmp_path / "data"))
        assert [r["id"] for r in e.events().collect()] == ["e00001"] and sorted(os.listdir(tmp_path / "data" / "episodic")) == ["events"]
        e.store.close()


def test_a_thousand_tool_events_make_few_files(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    for i in range(1000):
        e.record_event("note", {"n": i})
    assert e.events().count() == 1000 and e.live_events.files() <= 2 * EventTable.FAN
    e.forget(id=e.recall_recent(1)["events"][0]["id"])
    assert e.events().count() == 999
    e.close()
    assert json.load(open(tmp_path / "data" / "episodic" / "events" / "manifest.json"))["changes"] == []


def test_writers_of_the_log_take_turns(spark, tmp_path):
    """Tool calls and a stream beside each other: every op has an lsn of its own, without gaps."""
    import threading

    from lamina.schemas import OPLOG
    from lamina.sources.store import OpLogStore

    store = OpLogStore(spark, str(tmp_path), 2)
    batch = spark.createDataFrame([(0, "insert", f"s{i}", "t", "fact", [], "s", None, [0.0, 1.0]) for i in range(40)], OPLOG).repartition(5)
    errors = []

    def tool(name):
        try:
            for i in range(5):
                store.append([{"op": "insert", "id": f"{name}{i}", "embedding": [1.0, 0.0]}])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def stream():
        try:
            for n in range(3):
                assert store.append_batch(batch, "ops", n)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=tool, args=(n,)) for n in "ab"] + [threading.Thread(target=stream)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(r["lsn"] for r in store.log().collect()) == list(range(1, 131)) and store.last_lsn() == 130
    store.close()


def test_an_interrupted_loop_closes_the_engine(spark, tmp_path):
    import io

    from lamina.plans.server import Server

    class Broken(io.StringIO):
        def readline(self, *_):
            raise KeyboardInterrupt

    e = Engine(spark, str(tmp_path / "data"))
    with pytest.raises(KeyboardInterrupt):
        Server(e).serve(Broken(), io.StringIO())
    assert [r["kind"] for r in e.events().orderBy("created_at").collect()] == ["session_start", "session_end"] and not os.path.exists(tmp_path / "data" / "semantic" / "lock")
