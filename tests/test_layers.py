import json
import os
import tarfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.operators import episodic, knn, oplog, tiers, working
from lamina.plans.recall import recall
from lamina.plans.tools import Engine, InvalidArguments, NotFound
from lamina.schemas import OPLOG
from lamina.sources import backup, config, pins, sessions
from lamina.sources.cold import ColdStore
from lamina.sources.store import OpLogStore
from lamina.streaming import jobs

NOW = datetime(2026, 1, 1)


def events(spark, ages):
    rows = [(str(i), "k", "s", "p", 0.5, NOW - timedelta(days=a), NOW - timedelta(days=a), "hot") for i, a in enumerate(ages)]
    return spark.createDataFrame(rows, "id string, kind string, scope string, payload string, retrieval_weight double, last_accessed timestamp, created_at timestamp, tier string")


def test_consolidation_of_the_three_ages(spark):
    rows = tiers.consolidated(events(spark, [1] * 30 + [60] * 30 + [365] * 40), F.lit(NOW))
    assert {r["tier"]: r["count"] for r in rows.groupBy("tier").count().collect()} == {"hot": 30, "warm": 30, "cold": 40}
    assert tiers.report(rows).first().asDict() == {"promoted_to_warm": 70, "archived_to_cold": 40}


def test_age_limit_is_inclusive(spark):
    assert tiers.consolidated(events(spark, [28]), F.lit(NOW)).first()["tier"] == "warm"


def test_recent_breaks_ties_by_weight_then_time_then_id(spark):
    at = NOW
    rows = [("b", 0.5, at, at), ("a", 0.5, at, at), ("c", 0.9, at, at - timedelta(days=1)), ("d", 0.5, at, at + timedelta(days=1))]
    df = spark.createDataFrame(rows, "id string, retrieval_weight double, last_accessed timestamp, created_at timestamp")
    assert [r["id"] for r in episodic.recall_recent(df, 9).collect()] == ["c", "d", "a", "b"]
    assert episodic.recall_recent(df, 0).collect() == []


def test_forget_leaves_cold_rows(spark):
    df = events(spark, [1]).withColumn("tier", F.lit("cold"))
    assert episodic.forget(df, "0").count() == 1
    assert episodic.forget(events(spark, [1]), "0").count() == 0


def test_touch_changes_hot_rows_only(spark):
    later = F.lit(NOW + timedelta(days=1))
    assert episodic.touch(events(spark, [5]), "0", later).first()["last_accessed"] == NOW + timedelta(days=1)


def test_rare_scope_underfills_only_in_overfetch(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 100.0]) for i in range(30)], "id long, embedding array<float>")
    items = spark.createDataFrame([(i, "t", "fact", "rare" if i == 29 else "common") for i in range(30)], "id long, content string, kind string, scope string")
    assert recall(items, vectors, [1.0, 0.0], 2, scope="rare").count() == 1
    assert recall(items, vectors, [1.0, 0.0], 2, scope="rare", mode="overfetch").count() == 0


def test_batch_search_agrees_with_single_searches(spark):
    corpus = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11) / 11 for j in range(4)]) for i in range(60)], "id long, embedding array<float>")
    queries = corpus.where("id % 20 = 0").selectExpr("id as qid", "embedding")
    for block in (2000, 1):
        found = knn.nearest_batch(corpus, queries, 5, block=block).collect()
        for q in queries.collect():
            want = [(r["id"], r["distance"]) for r in knn.nearest(corpus, list(q["embedding"]), 5).collect()]
            assert [(r["id"], r["distance"]) for r in sorted(found, key=lambda r: r["rank"]) if r["qid"] == q["qid"]] == want


def test_log_resolution(spark):
    schema = "lsn long, op string, id string, content string, kind string, created_at timestamp"
    log = spark.createDataFrame([
        (1, "insert", "a", "one", "fact", NOW), (2, "patch", "a", None, "decision", None), (3, "insert", "b", "two", "fact", NOW), (4, "delete", "b", None, None, None),
        (5, "delete", "c", None, None, None), (6, "patch", "c", "lost", None, None), (7, "delete", "d", None, None, None), (8, "insert", "d", "back", "fact", NOW),
    ], schema)
    rows = {r["id"]: (r["content"], r["kind"]) for r in oplog.merged(log).collect()}
    assert rows == {"a": ("one", "decision"), "d": ("back", "fact")}
    assert {r["id"] for r in oplog.live(log).collect()} == {"a", "c", "d"}


def test_turn_checkpoints(spark):
    turns = spark.createDataFrame([("s", i) for i in range(12)], "session_id string, turn_idx int")
    rows = working.turn_checkpoints(turns).orderBy("turn_idx").collect()
    assert [(r["turn_idx"], r["checkpoint"], r["final"]) for r in rows] == [(4, 1, False), (9, 2, False), (11, 3, True)]


def test_pins_file(spark, tmp_path):
    path = str(tmp_path / "pinned.jsonl")
    assert pins.read(spark, path).count() == 0
    a = pins.append(path, " keep it short ", "personal", ["x"])
    with open(path, "a") as f:
        f.write("\n# a comment\n{broken\n" + json.dumps({"id": "old", "content": "c", "scope": "work", "added_at": "2024-01-02T00:00:00Z"}) + "\n" + json.dumps({"content": "no id"}) + "\n")
    rows = pins.read(spark, path).orderBy("line_no").collect()
    assert [(r["id"], r["content"], r["tags"]) for r in rows] == [(a, "keep it short", ["x"]), ("old", "c", [])]
    assert pins.count_lines(spark, path) == 4
    assert pins.remove(path, a) and not pins.remove(path, a)
    assert "# a comment" in open(path).read()
    with pytest.raises(ValueError):
        pins.append(path, " ", "personal")


def test_session_files(spark, tmp_path):
    sessions.write(str(tmp_path), {"id": "s1", "turns": [{"role": "user", "content": "hi", "at": "2024-01-01T00:00:00Z"}], "started_at": "2024-01-01T00:00:00Z", "last_checkpoint_at": None, "clean_shutdown": False})
    rows = sessions.read(spark, str(tmp_path))
    assert sessions.turns(rows).first()["content"] == "hi"
    assert sessions.unclean(rows).count() == 1


def test_sessions_are_saved_by_the_tasks(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id as string) as id", "array(named_struct('role', 'user', 'content', concat('c', id), 'at', '2024-01-01T00:00:00.000000Z')) as turns")
    sessions.write_all(str(tmp_path), rows)
    assert {(r["session_id"], r["content"]) for r in sessions.turns(sessions.read(spark, str(tmp_path))).collect()} == {(str(i), f"c{i}") for i in range(40)}


def test_cold_store_touches_only_its_quarters(spark, tmp_path):
    import os

    store = ColdStore(spark, str(tmp_path / "cold"))
    make = lambda *rows: spark.createDataFrame(rows, "id string, v int, created_at timestamp")
    store.archive(make(("a", 1, datetime(2025, 2, 14)), ("b", 1, datetime(2025, 8, 14))))
    before = {f: os.path.getmtime(tmp_path / "cold/year=2025/quarter=3" / f) for f in os.listdir(tmp_path / "cold/year=2025/quarter=3")}
    store.archive(make(("a", 2, datetime(2025, 2, 14)), ("c", 1, datetime(2025, 3, 1))))
    assert {(r["id"], r["v"]) for r in store.read().collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert before == {f: os.path.getmtime(tmp_path / "cold/year=2025/quarter=3" / f) for f in os.listdir(tmp_path / "cold/year=2025/quarter=3")}
    assert [(r["year"], r["quarter"]) for r in store.quarters().collect()] == [(2025, 1), (2025, 3)]
    assert store.quarter(2024, 1).count() == 0
    plan = store.quarter(2025, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_store_survives_compaction_and_restart(spark, tmp_path):
    store = OpLogStore(spark, str(tmp_path), 2)
    store.append([{"op": "insert", "id": "a", "content": "x", "kind": "fact", "tags": [], "scope": "s", "created_at": NOW, "embedding": [1.0, 0.0]}])
    store.append([{"op": "patch", "id": "a", "scope": "t"}, {"op": "insert", "id": "b", "content": "y", "created_at": NOW, "embedding": [0.0, 1.0]}])
    with pytest.raises(ValueError):
        store.append([{"op": "insert", "id": "c", "embedding": [1.0]}])
    assert store.pending() == 3 and not jobs.compact_if_due(store)
    assert jobs.compact_if_due(store, inserts=3) and store.pending() == 0
    store.append([{"op": "delete", "id": "b"}])
    store.close()
    again = OpLogStore(spark, str(tmp_path), 2)
    assert [(r["id"], r["scope"], r["created_at"]) for r in again.items().collect()] == [("a", "t", NOW)]
    again.reembed("other", 3, lambda text: F.array(F.lit(1.0), F.lit(0.0), F.length(text).cast("double")))
    assert [r["embedding"] for r in again.items().collect()] == [[1.0, 0.0, 1.0]]
    assert again.manifest()["dim"] == 3


def test_config(tmp_path):
    assert config.load(str(tmp_path / "none.toml")).consolidation.hot_to_warm_days == 28
    (tmp_path / "c.toml").write_text("[consolidation]\nhot_to_warm_days = 3\n[budgets]\nunknown = 1\n")
    assert config.load(str(tmp_path / "c.toml")).consolidation.hot_to_warm_days == 3


@pytest.mark.parametrize("text,message", [
    ("[consolidation]\nhot_to_warm_days = 'x'", "of type int"), ("[storage]\nencryption = 1", "of type bool"), ("[checkpoints]\nsession_interval_turns = 0", "at least 1"), ("[scopes]\ndefault = ' '", "blank"),
    ("budgets = 3", "a section"), ("[consolidation]\nhot_to_warm_days = 200", "not be more than"), ("[budgets]\nauto_context_token_budget = true", "of type int"),
])
def test_config_names_what_is_wrong(tmp_path, text, message):
    (tmp_path / "c.toml").write_text(text)
    with pytest.raises(ValueError, match=message):
        config.load(str(tmp_path / "c.toml"))


def test_other_schedules_are_taken_as_idle(tmp_path):
    (tmp_path / "c.toml").write_text("[consolidation]\nschedule = 'nightly'\n[budgets]\nauto_context_token_budget = 0\n")
    with pytest.warns(UserWarning, match="nightly"):
        found = config.load(str(tmp_path / "c.toml"))
    assert found.consolidation.schedule == "idle" and found.budgets.auto_context_token_budget == 0


def test_backup_round_trip(tmp_path):
    root = tmp_path / "data"
    backup.scaffold(str(root))
    (root / "procedural" / "p").write_text("x")
    (root / "models" / "big").write_text("y" * 100)
    assert backup.disk_bytes(str(root)) == 1
    backup.backup(str(root), str(tmp_path / "b.tgz"))
    with pytest.raises(FileExistsError):
        backup.restore(str(tmp_path / "b.tgz"), str(root))
    backup.restore(str(tmp_path / "b.tgz"), str(root), force=True)
    assert (root / "procedural" / "p").read_text() == "x" and not (root / "models").exists()
    with tarfile.open(tmp_path / "bad.tgz", "w:gz") as tar:
        tar.addfile(tarfile.TarInfo("../evil"))
    with pytest.raises(ValueError):
        backup.restore(str(tmp_path / "bad.tgz"), str(tmp_path / "new"))


def test_idle_gate(tmp_path):
    gate = jobs.IdleGate(str(tmp_path / "gate"))
    assert [gate.tick(x) for x in (1, 1, 2, 2)] == [False, True, False, True]


def test_tools(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    a = e.call("remember", {"content": " the sky is blue ", "type": "fact", "tags": '["x"]'})["id"]
    assert e.call("recall", {"query": "the sky is blue", "limit": 1})["hits"][0]["content"] == "the sky is blue"
    assert e.call("update", {"id": a, "content": "grey"}) == {"updated": True} and e.call("update", {"id": "no"}) == {"updated": False}
    p = e.call("pin", {"content": "be kind"})["id"]
    e.call("record_event", {"kind": "user_message", "payload": {"content": "hello"}, "retrieval_weight": 0.9})
    assert e.session["turns"][4] == e.session["turns"][4] | {"role": "user", "content": "hello"} or any(t["role"] == "user" for t in e.session["turns"])
    assert e.call("stats")["memories"]["semantic"] == 1
    for tool, arguments in (("recall", {"query": " "}), ("recall", {"query": "x", "limit": 0}), ("forget", {}), ("record_event", {"kind": "a", "retrieval_weight": float("nan")}), ("remember", {"content": "x", "type": "Fact"}), ("update", {"id": a, "tags": '["x"]'})):
        with pytest.raises(InvalidArguments):
            e.call(tool, arguments)
    with pytest.raises(NotFound):
        e.call("nothing")
    assert e.call("forget", {"id": p})["layer"] == "procedural" and e.call("forget", {"id": a})["layer"] == "semantic"
    assert e.call("forget", {"id": "zz"}) == {"forgotten": False, "layer": None}
    assert e.call("switch_scope", {"scope": " work "})["scope"] == "work"
    found = e.resource("context")
    assert found["total_tokens"] > 0 and found["max_tokens"] == 4000 and found["semantic"] == []
    assert {frozenset(r) for r in found["episodic"]} == {frozenset(("id", "kind", "scope", "payload", "tags", "last_accessed", "created_at"))}
    assert {frozenset(r) for r in e.resource("recent")["events"]} == {frozenset(("id", "kind", "scope", "payload", "tags", "last_accessed", "created_at"))}
    e.close()
    assert e.resource("session", e.session["id"])["clean_shutdown"]


def test_context_shows_the_newest_pins(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    made = [e.pin(f"rule number {i} of the house", tags=["t"], scope="home")["id"] for i in range(8)]
    newest = sorted(made)[-2:]
    e.remember("the sky is blue", tags=["s"])
    found = e.context(max_tokens=20, scope="home")  # a rule takes 7 tokens
    assert [r["id"] for r in found["procedural"]] == [x for x in made if x in newest] and found["total_tokens"] == 14
    pin = found["procedural"][0]
    assert pin == {"id": pin["id"], "content": f"rule number {made.index(pin['id'])} of the house", "tags": ["t"], "scope": "home", "created_at": pin["created_at"]} and pin["created_at"].startswith("20")
    hit = e.context(query="the sky is blue")["semantic"][0]
    assert hit["content"] == "the sky is blue" and hit["kind"] == "fact" and hit["tags"] == ["s"]
    assert [t["content"] for t in e.context()["working"]] == [t["content"] for t in reversed(e.session["turns"])]


def test_group_commit_writes_each_batch_once(spark, tmp_path):
    """A batch that fails after its rows are there, and a replay of the whole stream, add nothing."""
    source = str(tmp_path / "source")
    rows = [(i, "insert", f"id{i}", "text", "fact", [], "s", None, [0.0, 1.0]) for i in range(20)]
    for part in range(4):
        spark.createDataFrame(rows[part * 5 : part * 5 + 5], OPLOG).coalesce(1).write.mode("append").parquet(source)
    store = OpLogStore(spark, str(tmp_path / "store"), 2)
    stream = spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.group_commit(stream, store, str(tmp_path / "one")).awaitTermination()
    assert store.last_lsn() == 20 and store.applied("ops") == 3 and sorted(r["lsn"] for r in store.log().collect()) == list(range(1, 21))
    jobs.group_commit(stream, store, str(tmp_path / "two")).awaitTermination()  # all batches again
    assert store.last_lsn() == 20
    store.compact()
    assert store.applied("ops") == 3 and not store.append_batch(spark.createDataFrame(rows[:1], OPLOG), "ops", 2) and store.items().count() == 20
    assert not store.append_batch(spark.createDataFrame([], OPLOG), "ops", 9)
    with pytest.raises(Exception, match="vectors must have 2 values"):
        store.append_batch(spark.createDataFrame([(0, "insert", "x", "t", "fact", [], "s", None, [1.0])], OPLOG), "ops", 10)
    assert store.last_lsn() == 20
    store.close()


def test_migrations_run_in_order_and_go_on_where_they_stopped(spark, tmp_path):
    store, seen = OpLogStore(spark, str(tmp_path), 2), []
    at = store.manifest()["schema_version"]
    steps = {at: lambda s: seen.append(at), at + 1: lambda s: seen.append(at + 1) or 1 / (len(seen) > 2)}
    with pytest.raises(ZeroDivisionError):
        store.migrate(steps, at + 2)
    assert store.manifest()["schema_version"] == at + 1
    assert store.migrate(steps, at + 2) == 1 and seen == [at, at + 1, at + 1]
    with pytest.raises(ValueError):
        store.migrate(steps, at + 5)
    with pytest.raises(ValueError):
        store.migrate()
    store.close()


def test_events_keep_consolidation_away(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    gate = jobs.IdleGate(str(tmp_path / "gate"))
    assert jobs.consolidate_if_idle(e, gate) is None
    e.call("record_event", {"kind": "a", "payload": {}})
    assert jobs.consolidate_if_idle(e, gate) is None and jobs.consolidate_if_idle(e, gate) is not None
    e.pin("x")
    assert jobs.consolidate_if_idle(e, gate) is None
    e.close()


def test_timer_saves_what_waits(spark, tmp_path):
    import time

    settings = config.Config()
    settings.checkpoints.session_interval_secs = 0.2
    e = Engine(spark, str(tmp_path / "data"), settings)
    e.open()
    e.call("list_scopes")
    assert e.unsaved == 1
    for _ in range(100):
        time.sleep(0.1)
        if not e.unsaved:
            break
    assert e.unsaved == 0 and e.session["last_checkpoint_at"]
    e.close()
    assert all(not t._thread.is_alive() for t in e.timers) and [r["kind"] for r in e.events().collect()].count("session_end") == 1


def test_timer_runs_one_pass_at_a_time_and_goes_on_after_errors():
    import threading
    import time

    seen, done = [], threading.Event()

    def work(poked):
        seen.append(poked)
        if len(seen) == 1:
            raise ValueError
        if len(seen) == 3:
            done.set()
        return True

    timer = jobs.Timer(0.05, work)
    assert done.wait(10)
    timer.poke()
    time.sleep(0.1)
    timer.stop()
    assert timer.errors == 1 and timer.runs == len(seen) - 1


def test_forgotten_events_leave_the_disk(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    made = e.record_event("note", {"content": "secret"})["id"]
    e.record_event("note", {"content": "other"})
    e.forget(id=made)
    assert [r["payload"] for r in e.events().collect()] == ['{"content": "other"}']
    assert len([f for f in os.listdir(tmp_path / "data" / "episodic") if f.startswith("events")]) == 1
    e.close()


def test_streams_of_several_files(spark, tmp_path):
    """Files that arrive out of order, one a batch: a lateness that covers them loses nothing, none loses what comes late."""
    from lamina.streaming import events as streams

    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    days = [[5, 6, 7], [1, 2, 3], [4, 8, 9], [30]]
    for number, own in enumerate(days):
        rows = [(100 * number + i, datetime(2024, 1, d, 12), d % 2, "view", 1.0, "{}") for i, d in enumerate(own * 2)]
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        for name in os.listdir(tmp_path / "events.parquet"):  # the order of arrival is that of the files' times
            path = tmp_path / "events.parquet" / name
            if path.stat().st_mtime > 2_000_000:
                os.utime(path, (1_000_000 + number, 1_000_000 + number))
    counts = lambda lateness: {r["day"].day: r["n"] for r in streams.daily_counts(spark, str(tmp_path), lateness, files=1).collect()}
    assert counts("20 days") == {d: 2 for d in range(1, 10)}
    assert set(counts("0 seconds")) < set(range(1, 10))
    assert streams.first_seen(spark, str(tmp_path)).count() == 2
    assert sum(r["n"] for r in streams.sessions(spark, str(tmp_path), "36 hours", "20 days", 1).collect()) == 16  # the one of the 9th is still open


def test_recall_without_a_join(spark):
    items = spark.createDataFrame([("a", "s", "fact", [1.0, 0.0]), ("b", "t", "fact", [0.0, 1.0]), ("c", "s", "fact", [0.6, 0.8])], "id string, scope string, kind string, embedding array<float>")
    one = recall(items, items, [1.0, 0.0], 2, scope="s").collect()
    two = recall(items.drop("embedding"), items.select("id", "embedding"), [1.0, 0.0], 2, scope="s").select("id", "scope", "kind", "score").collect()
    assert one == two and "Join" not in recall(items, items, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()


def test_pooling_of_a_model(spark):
    from lamina.functions import embedding

    load = lambda: lambda texts: [[[float(len(t)), 0.0], [0.0, 1.0]] for t in texts]
    embedding.register_model("toy-mean", 2, load, "mean", 2)
    embedding.register_model("toy-cls", 2, load, "cls", 2)
    df = spark.createDataFrame([("a",), ("bbb",), ("cc",)], "t string")
    rows = df.select("t", embedding.embedder("toy-mean", 2)(F.col("t")).alias("m"), embedding.embedder("toy-cls", 2)(F.col("t")).alias("c")).collect()
    for r in rows:
        n = len(r["t"])
        assert r["m"] == pytest.approx([n / (n * n + 1) ** 0.5, 1 / (n * n + 1) ** 0.5]) and r["c"] == pytest.approx([1.0, 0.0])
    with pytest.raises(ValueError):
        embedding.register_model("toy", 2, load, "max")
