import random

import numpy as np
import pytest

from lamina.llm import graph, jaccard
from lamina.session import Scratch
from tests.llm.conftest import frame


def word_sets(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, num, den):
    sets = word_sets(rows, k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed, groups=14):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 4, 7, 12, 40, 150, 700)))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 30)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, k, num", [(1, 3, 90), (2, 5, 80)])
def test_components_equal_brute_force(spark, seed, k, num):
    rows = near_copies(seed)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(frame(spark, rows), k, num, 100).collect()), key=str)
    assert got == brute(rows, k, num, 100)


def test_hot_buckets_of_unlike_sets(spark, monkeypatch):
    """A passage in every text fills buckets with sets that aren't similar, beside near copies; tasks group a few keys at a time, tiles are small."""
    monkeypatch.setattr(jaccard, "GATHER", 30)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    monkeypatch.setattr(jaccard, "TILE_HASHES", 1)
    rng = random.Random(11)
    passage = ["p%d" % i for i in range(14)]
    rows = []
    for _ in range(50):
        rows.append(" ".join(passage + ["u%d" % rng.randrange(10_000) for _ in range(4)]))
    near = passage + ["n%d" % i for i in range(30)]
    for _ in range(25):
        words = list(near)
        words[rng.randrange(len(words))] = "y%d" % rng.randrange(100)
        rows.append(" ".join(words))
    rows += [rows[0]] * 20 + [rows[60]] * 20
    rows = list(enumerate(rows))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(frame(spark, rows).repartition(5), 1, 80, 100).collect()), key=str)
    assert got == brute(rows, 1, 80, 100)


def test_grouped_keys():
    key, cls = np.array([3, 1, 3, 1, 3, 2]), np.array([9, 5, 7, 5, 8, 4])
    assert [x.tolist() for x in jaccard.grouped(key, cls)] == [[1, 2, 3, 3, 3], [5, 4, 7, 8, 9], [5, 4, 7, 7, 7], [True, True, True, False, False]]


def test_columns_named_like_helpers(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h", i, True, "x", "y", "z") for i in range(3)], "doc_id long, text string, _j_id long, _j_repeats boolean, row string, mark string, id string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and [r["_j_id"] for r in kept.collect()] == [0]


def test_chain_of_a_bucket_is_linked_across_tiles(spark, monkeypatch):
    """Near copies that aren't all similar to the smallest one, in tiles of 16 rows."""
    monkeypatch.setattr(jaccard, "TILE_HASHES", 1)
    rng = random.Random(5)
    base = ["c%d" % i for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(120), 6):
            words[j] = "x%d_%d" % (i // 2, j)
        rows.append((i, " ".join(words)))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(frame(spark, rows), 1, 90, 100).collect()), key=str)
    assert got == brute(rows, 1, 90, 100)


@pytest.mark.parametrize("k, num", [(1, 50), (3, 90), (5, 80)])
def test_similar_sets_share_a_block(k, num):
    texts = [t for _, t in near_copies(9, 40)]
    sets = jaccard.Sets(texts, k)
    keys = {}
    for key, number in jaccard.block_keys(sets, jaccard.bands(num, 100, 1 << 12), num, 100):
        for a, b in zip(key.tolist(), number.tolist(), strict=True):
            keys.setdefault(b, set()).add(a)
    plain = [set(sets.of(i).tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        assert (sets.of(i) == jaccard.shingles(texts[i], k)).all()
        for j in range(i):
            both = len(plain[i] & plain[j])
            if both and plain[i] != plain[j] and 100 * both >= num * (len(plain[i]) + len(plain[j]) - both):
                assert keys[i] & keys[j]


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 600, 9000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[n // 10 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]
        sets = jaccard.Sets.__new__(jaccard.Sets)
        both = [np.unique(a), np.unique(b)]
        sets.hashes, sets.number = np.concatenate(both), np.repeat([0, 1], [len(x) for x in both])
        sets.sizes = np.array([len(x) for x in both])
        sets.starts = np.r_[0, np.cumsum(sets.sizes)]
        one, two = jaccard.stacked(sets.sketches())
        assert int(np.bitwise_count(one ^ two).sum()) <= len(np.setxor1d(*both))


def test_edges(spark, edges, edge_rows, nothing):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(edges, 3, 90, 100).collect()), key=str)
    assert got == brute(edge_rows, 3, 90, 100)
    assert jaccard.link(nothing).count() == 0
    kept = jaccard.keep_one(edges)
    assert kept.columns == edges.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "3", "4", "5", "6", "7", "8", "None", "11", "12"])
    assert jaccard.keep_one(nothing).count() == 0


def test_keep_one_drops_only_linked_rows(spark):
    """Rows that share or lack an id are documents of their own; one row of each component stays."""
    rng = random.Random(4)
    fresh = lambda: " ".join("v%d" % rng.randrange(10_000) for _ in range(60))
    same, late, nameless = fresh(), fresh(), fresh()
    rows = [(1, same), (1, same), (1, same + " end"), *((1, fresh()) for _ in range(5)), *((None, fresh()) for _ in range(5)), (None, same + " end"), (2, ""), (2, ""), (2, None)]
    rows += [(7, "a " + late), (3, late), (7, fresh()), (None, nameless), (None, nameless)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(frame(spark, rows)).collect()]
    dropped = sorted(set(rows) - set(kept), key=str)
    assert len(kept) == 1 + 5 + 5 + 3 + 2 + 1 and kept.count((2, "")) == 2 and kept.count((None, nameless)) == 1
    assert [i for i, t in kept if t and t.startswith(same)] == [1]
    assert (7, "a " + late) in dropped and all(t.startswith((same, "a " + late)) for _, t in dropped)


@pytest.mark.parametrize("every", [1, 2])
def test_near_copies_without_id_are_linked(spark, every):
    """All rows, or every second one, lack an id."""
    rows = [(None if i % every == 0 else i, t) for i, t in near_copies(7, 10)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(frame(spark, rows), 3, 90, 100).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)
    words = [r for r in jaccard.keep_one(frame(spark, rows), 3, 90, 100).collect() if r["text"]]
    assert len(words) == len({r[2] for r in brute([(i, t) for i, (_, t) in enumerate(rows) if t], 3, 90, 100)})


def test_components_beyond_the_large_edge_count(spark, monkeypatch):
    """Above LARGE edges minima go through tables: the same components."""
    rng = random.Random(6)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    edges = spark.createDataFrame(rows, "a long, b long")
    small = sorted(map(tuple, graph.components(edges, Scratch(spark, "cc"), "s").collect()))
    monkeypatch.setattr(graph, "LARGE", 0)
    scratch = Scratch(spark, "cc")
    assert sorted(map(tuple, graph.components(edges, scratch, "l").collect())) == small
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert small == sorted((x, find(x)) for x in root)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 130)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    roots = {r["node"]: r["root"] for r in graph.components(edges, Scratch(spark, "g"), "t").collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
