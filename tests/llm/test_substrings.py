import hashlib
import random

import numpy as np
import pytest

from lamina.llm import substrings
from tests.llm.conftest import frame


def brute(rows, length=50):
    least = {}
    place = lambda d: (d is None, d or 0)
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(least.get(s, place(d)), place(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < place(d):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [None, 1])
def test_equals_brute_force(spark, hot):
    rng = random.Random(7)
    passages = ["".join(rng.choice("abc de\né") for _ in range(rng.choice((45, 50, 51, 80, 200)))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("xyz qw") for _ in range(rng.randint(0, 40))) + rng.choice(passages) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randrange(50), "".join(parts)))
    rows += [(i, "ab" * 60) for i in (3, 70, 71)] + [(72, "a" * 49), (73, "a" * 49), (80, rows[0][1]), (81, rows[0][1])]
    assert results(substrings.remove_repeats(frame(spark, rows), hot=hot)) == brute(rows)


def test_hot_prefixes(spark, monkeypatch):
    """A line that most texts share, beside others: its prefixes travel to the rows."""
    monkeypatch.setattr(substrings, "LEAST_HOT", 1)
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(12)]
    rows = [(i, "".join(rng.choice("xyz") for _ in range(30)) + lines[0] * (i % 3 > 0) + rng.choice(lines)) for i in range(60)]
    assert results(substrings.remove_repeats(frame(spark, rows), hot=1)) == brute(rows)


def test_edges(spark, edges, edge_rows, nothing):
    short = [(d, t if t is None or len(t) < 3000 else t[:3000]) for d, t in edge_rows]
    assert results(substrings.remove_repeats(frame(spark, short))) == brute(short)
    assert substrings.remove_repeats(edges).count() == len(edge_rows)
    assert substrings.remove_repeats(nothing).count() == 0


def test_pieces_of_long_texts_lose_no_window(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 200)
    raw = bytes(random.Random(1).choice(b"ab") for _ in range(1000))
    starts = [offset + p for offset, x in substrings.pieces(raw) for p in range(len(substrings.picked(x)[0]))]
    assert starts == list(range(951))


def test_every_window_picks_by_content():
    rng = np.random.default_rng(2)
    x = rng.integers(97, 100, 500).astype(np.uint8)
    y = np.r_[rng.integers(97, 100, 37).astype(np.uint8), x]
    a, _ = substrings.picked(x)
    b, _ = substrings.picked(y)
    assert (b[37:] - 37 == a).all()
    assert ((a >= np.arange(len(a))) & (a <= np.arange(len(a)) + 30)).all()


@pytest.mark.parametrize("k", [1, 2, 20, 50])
def test_window_hashes_name_contents(k):
    x = np.frombuffer(b"abcabcabcabd" * 12, np.uint8)
    h = substrings.window_hashes(x, k)
    seen = {}
    for i in range(len(x) - k + 1):
        seen.setdefault(bytes(x[i : i + k]), set()).add(int(h[i]))
    assert len(h) == len(x) - k + 1 and all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_shared_names_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(n, d) for n in range(40) for d in range(n % 5)] * 2
        random.Random(3).shuffle(rows)
        parts = [substrings.grouped(*np.array(rows[at : at + size]).T, 4).to_pylist() for size, start, end in ((1, 0, 60), (13, 60, len(rows))) for at in range(start, end, size)]
        table = spark.createDataFrame([tuple(r.values()) for part in parts for r in part], "name long, digest long, salt int, sure boolean")
        got = substrings.shared_names(table).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["name"], r["digest"]) for r in got} == {(n, d) for n, d in rows if n % 5 > 1}


def test_runs_part_prefixes_that_share_a_hash():
    order, head = substrings._runs(np.array([5, 5, 5, 1], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert order.tolist() == [3, 0, 2, 1] and head.tolist() == [True, True, False, True]


def test_repeated_rows_are_searched_once(spark, monkeypatch):
    """A row that comes 200 times: its contexts are those of one row, each copy has its result."""
    counts, own = [], substrings.removed_windows

    def counted(contexts):
        counts.append(contexts.count())
        return own(contexts)

    monkeypatch.setattr(substrings, "removed_windows", counted)
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(400))
    one = [(1, text), (2, text[:390] + " other end")]
    many = [one[0], *[one[1]] * 200, (1, "short"), (1, "short")]
    assert results(substrings.remove_repeats(frame(spark, one))) == brute(one)
    assert results(substrings.remove_repeats(frame(spark, many).repartition(9))) == brute(many)
    assert counts[0] == counts[1] > 0


@pytest.mark.parametrize("hot", [None, 1])
def test_texts_that_repeat_inside_themselves(spark, hot):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdef ") for _ in range(90))
    rows = [(5, passage * 40 + "end"), (3, "x" * 1500), (9, passage[20:] + "y" * 200 + passage), (4, "x" * 700 + passage), (8, "ab" * 400)]
    assert results(substrings.remove_repeats(frame(spark, rows), hot=hot)) == brute(rows)
