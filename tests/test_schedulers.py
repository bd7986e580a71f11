import os
from datetime import datetime, timedelta

import pytest

from lamina.streaming import schedulers

T0 = datetime(2026, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def written(spark, path, parts, schema):
    """A file for each part, which arrive in this order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if os.stat(f"{path}/{name}").st_mtime > 2_000_000:
                os.utime(f"{path}/{name}", (1_000_000 + n, 1_000_000 + n))
    return path


def plain_flushes(rows, every=5, seconds=30, watermark=None):
    """The rule, row by row."""
    out, state = [], {}
    for s, turn, t, signal in sorted(rows, key=lambda r: (r[2], r[1])):
        n, due, through = state.get(s, (0, None, None))
        if n and due <= t:
            out.append((s, due, "timer", n, through))
            n = 0
        if signal == "close":
            if n:
                out.append((s, t, "shutdown", n, through))
            n = 0
        else:
            due = due if n else t + timedelta(seconds=seconds)
            n, through = n + 1, turn
            if n >= every:
                out.append((s, t, "turns", n, through))
                n = 0
        state[s] = (n, due, through)
    out += [(s, due, "timer", n, through) for s, (n, due, through) in state.items() if n and watermark and due <= watermark]
    return sorted(out)


ROWS = (
    [(1, i, at(i), "turn") for i in range(12)] + [(1, 1 << 40, at(15), "close")]  # two full ones, and two turns when it closes
    + [(2, i, at(10 * i), "turn") for i in range(9)]  # the timer is due among the turns
    + [(3, 0, at(2), "turn"), (3, 1, at(100), "turn"), (3, 1 << 40, at(101), "close")]
    + [(4, i, at(4), "turn") for i in range(5)] + [(5, 0, at(1), "turn")] + [(6, 0, at(500), "turn")]
)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_flushes_do_not_depend_on_batches(spark, tmp_path, parts):
    rows = sorted(ROWS, key=lambda r: r[2])
    size = -(-len(rows) // parts)
    path = written(spark, str(tmp_path / "s"), [rows[i : i + size] for i in range(0, len(rows), size)], schedulers.SIGNALS)
    got = schedulers.checkpoint_flushes(spark, path, lateness="1 second", files=1).collect()
    assert sorted(map(tuple, got)) == plain_flushes(ROWS, watermark=at(500))
    reasons = {r["reason"] for r in got}
    assert reasons == {"turns", "timer", "shutdown"} and not any(r["session_id"] == 6 for r in got)


def test_other_sizes_and_a_restored_setting(spark, tmp_path):
    before = spark.conf.get(schedulers._PROVIDER)
    path = written(spark, str(tmp_path / "s"), [ROWS], schedulers.SIGNALS)
    got = schedulers.checkpoint_flushes(spark, path, every=2, seconds=3).collect()
    assert sorted(map(tuple, got)) == plain_flushes(ROWS, 2, 3, at(500)) and spark.conf.get(schedulers._PROVIDER) == before


@pytest.mark.parametrize("parts", [1, 4])
def test_idle_ticks_of_each_store(spark, tmp_path, parts):
    writes = [("a", at(60 * m)) for m in (5, 10, 130, 131, 250, 600)] + [("b", at(60 * m)) for m in (0, 59, 60, 400)]
    writes.sort(key=lambda r: r[1])
    size = -(-len(writes) // parts)
    path = written(spark, str(tmp_path / "w"), [writes[i : i + size] for i in range(0, len(writes), size)], "store string, at timestamp")
    got = {(r["store"], (r["tick"] - T0).seconds // 3600): r["ran"] for r in schedulers.idle_gate_ticks(spark, path, files=1).collect()}
    busy = {"a": {0, 2, 4, 10}, "b": {0, 1, 6}}
    assert got == {(s, h): h - 1 not in busy[s] for s in "ab" for h in range(1, 11)}
