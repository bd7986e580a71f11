import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import queries, resampling
from tests.llm.conftest import frame
from tests.oracle import assert_same, connection

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(docs, target, percent=25, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of every row, feature by feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = {}, {}
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] = counts.get(bucket(f), 0) + 1
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        n_words, own = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def targets(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, batch string")


TARGET = ["the quick brown fox", "Ünï çödé", None, "", "word1 word4 word9 word16"]


def test_query_matches_sql(spark, small_dir):
    assert_same(queries.op12_importance_resampling(spark, small_dir), connection(small_dir), queries.ORACLES["op12_importance_resampling"])


@pytest.mark.parametrize("partitions", [1, 60])
def test_edges_against_brute_force(spark, edges, edge_rows, partitions):
    got = resampling.resample(edges, targets(spark, TARGET), percent=50, least_words=2, partitions=partitions).collect()
    assert ordered(got) == ordered(brute(edge_rows, TARGET, 50, 2))


def test_blocks_of_every_size_give_the_same(spark, edges, edge_rows, monkeypatch):
    for size, docs in ((1, 8192), (1 << 20, 2), (50_000, 3)):
        monkeypatch.setattr(resampling, "BLOCK_BYTES", size)
        monkeypatch.setattr(resampling, "BLOCK_DOCS", docs)
        texts = [(t or "").encode() for _, t in edge_rows]
        total = {}
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in edge_rows], pa.int64()), pa.array([t for _, t in edge_rows], pa.string())], names=["k", "t"])
        blocks = list(resampling._blocks(iter([batch])))
        assert [t for _, own in blocks for t in own] == texts and all(len(own) == 1 or sum(map(len, own)) <= size and len(own) <= docs for _, own in blocks)
        for _, own in blocks:
            for b, _, c in zip(*resampling.postings(own)[:3], strict=True):
                total[b] = total.get(b, 0) + c
        want = {}
        for _, t in edge_rows:
            for f in features(t)[1]:
                want[zlib.crc32(f.encode()) % 10_000] = want.get(zlib.crc32(f.encode()) % 10_000, 0) + 1
        assert total == want


def test_empty_tables(spark, nothing, edges, edge_rows):
    assert resampling.resample(nothing, targets(spark, TARGET)).collect() == []
    assert ordered(resampling.resample(edges, targets(spark, [])).collect()) == ordered(brute(edge_rows, []))
    assert resampling.resample(nothing, targets(spark, [])).collect() == []


def test_a_bucket_that_most_documents_share(spark):
    rows = [(i, "same") for i in range(900)] + [(1000 + i, f"same own{i} " * 12) for i in range(50)] + [(5, "same")] * 100
    got = resampling.resample(frame(spark, rows).repartition(7), targets(spark, ["own3 same own3"]), partitions=40)
    assert ordered(got.collect()) == ordered(brute(rows, ["own3 same own3"]))
    assert sum(r["rank"] is not None for r in got.collect()) == 12


@pytest.mark.parametrize("lengths", [(1, 1), (63, 1), (64, 63), (65, 64), (5, 30_000), (30_000, 2)])
def test_checksums_of_pairs(lengths):
    words = [bytes([97 + n % 26]) * n for n in lengths]
    sums, docs = resampling.feature_checksums([*words, b"z"], np.array([0, 0, 1]))
    assert sums.tolist() == [*map(zlib.crc32, [*words, b"z"]), zlib.crc32(b" ".join(words))] and docs.tolist() == [0, 0, 1, 0]


def test_checksums_beside_other_hashes(spark):
    """What another operator has kept in the same process or worker is no checksum, and a task leaves nothing behind."""
    from lamina.llm import features, workers

    words = [b"same", b"words"]
    features.word_hashes(words)
    assert resampling.feature_checksums(words, np.array([0, 0]))[0].tolist() == [*map(zlib.crc32, words), zlib.crc32(b"same words")]

    def hashed(batches):
        for batch in batches:
            features.word_hashes(words)
            yield batch

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [len(workers._KEPT)] * batch.num_rows})

    one = spark.range(0, 8, 1, 8)
    one.mapInArrow(workers.task(hashed), "id long").collect()
    assert {r["id"] for r in one.mapInArrow(held, "id long").collect()} == {0}
