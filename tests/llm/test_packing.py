import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import packing
from tests.llm.conftest import frame

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    alphabet = [*"abAB'stTrel  \n\t.,!<|>019éÉßÄ–²½µ×́KİςΣ中\x1c\x85\xa0ªº\x00", "<|endoftext|>", "'s ", "'ll", "don't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    coder = packing.ChunkIds(VOCABULARY, most_bytes=9000)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for t, got in zip(part, coder.encode(part), strict=True):
            assert got == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def check_packed(rows, texts, tokenizer, capacity):
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in pieces[i] if r["start"] % capacity == 0]
        want = {(n, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for n, s in enumerate(range(0, len(ids), capacity))}
        assert want <= {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_edges(spark, edges, edge_rows, nothing, tokenizer):
    for capacity in (2048, 32):
        rows = packing.pack(edges, VOCABULARY, capacity).collect()
        n = check_packed(rows, edge_rows, tokenizer, capacity)
        assert n <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert packing.pack(nothing, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fullest_finds_the_best_sum(seed):
    rng = random.Random(seed)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * m for s in sums for m in range(n + 1) if s + x * m <= room}
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(sums)
        assert all(n <= counts[x] for x, n in chosen.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    histogram = {rng.randint(1, 700): rng.randint(1, 400) for _ in range(300)} | {2048: 17}
    plan = packing.plan_bins(histogram)
    used = {}
    for times, chosen in plan:
        assert sum(x * n for x, n in chosen.items()) <= 2048
        for x, n in chosen.items():
            used[x] = used.get(x, 0) + n * times
    assert used == histogram
    assert sum(t for t, _ in plan) <= -(-sum(x * n for x, n in histogram.items()) // 2048) * 1.01 + 1


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json
    import os

    texts = ["Hello, world!  it's 12 o'clock", "ÉÉ no", "", "a\nb"]
    folder = os.path.dirname(VOCABULARY)
    for name in sorted(os.listdir(folder)):
        if name.endswith(".json"):
            try:
                other = Tokenizer.from_file(os.path.join(folder, name))
            except Exception:  # noqa: BLE001  not a tokenizer of this library
                continue
            got = packing.ChunkIds(os.path.join(folder, name)).encode(texts)
            assert got == [np.array(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts], name
    settings = json.loads(Tokenizer.from_file(VOCABULARY).to_str())
    assert packing.ChunkIds.cuts_alike(settings)
    settings["normalizer"]["normalizers"].pop()
    assert not packing.ChunkIds.cuts_alike(settings)


def test_kept_chunks_are_bounded_in_bytes():
    coder = packing.ChunkIds(VOCABULARY, most_bytes=20_000)
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    texts = [f"{letters(i)} {letters(i * i)}" for i in range(5000)]
    for _ in range(3):
        for at in range(0, len(texts), 500):
            coder.encode(texts[at : at + 500])
    size = sum(len(k) + len(v) + packing.ENTRY for k, v in (*coder.latin.items(), *coder.raw.items()))
    assert 10_000 < size < 21_000


def test_workers_drop_what_other_operators_kept():
    from lamina.llm import features, workers

    list(workers.task(lambda batches: iter([packing.ChunkIds.of(VOCABULARY)]), packing.OWNER)(iter([])))
    assert packing.OWNER in workers._KEPT
    list(workers.task(lambda batches: iter([features.word_hashes([b"a"])]))(iter([])))
    assert not workers._KEPT


def test_rows_that_share_or_lack_an_id_are_packed_each(spark, tokenizer):
    rows = [(None if i % 3 else 7, "some words here") for i in range(300)]
    got = packing.pack(frame(spark, rows), VOCABULARY, 64).collect()
    assert len(got) == 300 and len({(r["sequence_id"], r["offset"]) for r in got}) == 300


def test_new_chunks_go_through_the_tokenizer_as_lines():
    coder = packing.ChunkIds(VOCABULARY)
    chunks = [b"some", b"words", b"'s", b"\x00", b"\xe9t\xe9", b"...", b"7", b"zqxjv"]
    want = {c: np.array(coder.tokenizer.encode(c.decode("latin-1"), add_special_tokens=False).ids, "<u4").tobytes() for c in chunks}
    calls, real = [], coder.cut_tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return real.encode_batch_fast(texts, **how)

    coder.cut_tokenizer = Counted()
    assert coder.fresh(True, chunks) == want and calls == [1]
    coder.ends[:] = False  # a vocabulary that doesn't mark ends: each chunk goes through it alone
    assert coder.fresh(True, chunks) == want and calls == [1, 1, len(chunks)]
