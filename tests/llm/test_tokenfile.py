import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from lamina.llm import files, queries, simple8b, tokenfile
from lamina.session import Scratch
from tests.llm.conftest import frame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b   c\t\td\n\n e   f g", "it's 'RE they'll  don't", "x<|endoftext|> y <|endoftext|>", "12a34 ½ ² 5", "\x00\x1c \x1d\x85z", " lead and trail ", "  ", "中文 字 空格",
    "é è  ü ß", "áb", "🙂 🙂🙂", "tab\tend ", "\r\nline\r\n",
]


def ids_of(text):
    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def round_trip(values):
    values = np.array(values, np.uint64)
    words, escapes, offsets = simple8b.encode(values)
    assert np.array_equal(simple8b.decode(words, escapes, offsets, len(values)), values)
    return words, escapes, offsets


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(0, 3), st.integers(0, 2**17), st.integers(0, 2**64 - 1)), st.integers(1, 300)), max_size=60))
def test_codec_round_trip(runs):
    round_trip([v for v, n in runs for _ in range(n)])


@pytest.mark.parametrize("n", [0, 1, 119, 120, 4095, 4096, 4097, 9000])
def test_codec_at_block_ends(n):
    for values in (np.zeros(n), np.full(n, 2**60 - 1), np.full(n, 2**60), np.arange(n), np.arange(n) % 2 * 50_000):
        words, escapes, offsets = round_trip(values.astype(np.uint64))
        assert len(offsets) == -(-n // simple8b.BLOCK)
    assert len(simple8b.encode(np.full(4096, 50_256))[0]) == -(-4096 // 3)
    assert len(simple8b.encode(np.zeros(4096))[0]) == -(-4096 // 120)


def test_each_word_takes_as_many_as_fit():
    """The plain greedy rule, word by word."""
    rng = np.random.default_rng(2)
    values = (rng.integers(0, 2**62, 5000) >> rng.integers(0, 62, 5000)).astype(np.uint64)
    values[1000:1500] = 0
    at, want = 0, []
    while at < len(values):
        end = min(len(values), (at // simple8b.BLOCK + 1) * simple8b.BLOCK)
        for s in range(1, 16):
            n, bits = int(simple8b.COUNTS[s]), int(simple8b.BITS[s])
            if all(int(v) < 1 << bits for v in values[at : min(end, at + n)]):
                break
        else:
            s, n = 0, 1
        want.append(s)
        at = min(at + n, end)
    assert (simple8b.encode(values)[0] >> np.uint64(60)).tolist() == want


def test_pieces_give_the_tokenizers_ids(edge_rows):
    coder = tokenfile.ByteTokens(VOCABULARY)
    assert coder.known
    texts = [t or "" for _, t in edge_rows] + ODD
    for most in (1 << 20, 1 << 20, 3):  # the second time pieces are known, the third time they are dropped
        coder.pieces.most = most
        assert [np.frombuffer(x, "<u4").tolist() + [0] for x in coder.encode([t.encode() for t in texts])] == [ids_of(t) for t in texts]


def test_many_pieces_grow_the_table():
    coder = tokenfile.ByteTokens(VOCABULARY)
    texts = [" ".join(f"w{n * 7919 % 1_000_003}x" for n in range(at, at + 4000)) for at in range(0, 80_000, 4000)]
    for _ in range(2):
        assert coder.encode([t.encode() for t in texts])[7:9] == [np.array(ids_of.known.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[7:9]]
    assert coder.pieces.size > 65_536 and len(set(coder.pieces.place.tolist())) == coder.pieces.size + 1


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'sStreLl.,!09aéü  <|"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text_gives_the_tokenizers_ids(texts):
    coder = test_any_text_gives_the_tokenizers_ids.coder
    assert [np.frombuffer(x, "<u4").tolist() + [0] for x in coder.encode([t.encode() for t in texts])] == [ids_of.known.encode(t, add_special_tokens=False).ids + [0] for t in texts]


test_any_text_gives_the_tokenizers_ids.coder = tokenfile.ByteTokens(VOCABULARY)
ids_of.known = Tokenizer.from_file(VOCABULARY)


def expected(rows):
    """By plain code: rows without id first, then by id; start counts all ids before."""
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = ids_of(t)
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    return want


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_token_files_against_plain_code(spark, edges, edge_rows, partitions):
    rows = edge_rows + [(1000 + n, t) for n, t in enumerate(ODD)]
    got = tokenfile.token_files(frame(spark, rows), VOCABULARY, partitions=partitions).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_empty_table_and_equal_ids(spark, nothing):
    assert tokenfile.token_files(nothing, VOCABULARY).collect() == []
    rows = [(5, "one two")] * 30 + [(5, "three four five")] * 10 + [(4, "x")]
    got = sorted(tokenfile.token_files(frame(spark, rows), VOCABULARY, partitions=6).collect(), key=lambda r: r["start"])
    assert len(got) == 41 and (got[0]["doc_id"], got[0]["start"]) == (4, 0)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert [r["ids_crc32"] for r in got].count(crc(ids_of("one two"))) == 30


def test_query_over_the_whole_table(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_files(spark, small_dir).collect())) == sorted(expected(docs))


def test_files_name_their_sections_and_give_slices(spark, edges, edge_rows, monkeypatch):
    scratch = Scratch(spark, "t")
    index = scratch.table("index", tokenfile.write_ids(edges, VOCABULARY, scratch.path("files"), partitions=1))
    rows = index.orderBy("section").collect()
    system, path = fs.FileSystem.from_uri(rows[0]["uri"])
    raw = system.open_input_file(path).read()
    assert [(r["offset"], r["length"], r["n_docs"], r["n_ids"]) for r in rows] == tokenfile.sections(raw)
    ids = [i for _, t in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in ids_of(t)]
    reader, at = files.Reader(), rows[0]
    assert len(ids) == at["n_ids"]
    for first, last in ((0, 5), (4090, 4100), (8192, 12_288), (len(ids) - 3, len(ids) + 9), (7, 7), (0, len(ids))):
        assert tokenfile.read_ids(reader, at["uri"], at["offset"], first, last).tolist() == ids[first:last]
    with pytest.raises(ValueError):
        tokenfile.sections(raw[:-1])
    with pytest.raises(ValueError):
        tokenfile.open_section(raw[at["offset"] : at["offset"] + at["length"] - 1])


def test_sections_and_files_roll_over(monkeypatch):
    tokens = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5000, 3, 9000)]
    raw = tokenfile.pack_section([3, None, 4, 4], tokens)
    doc_ids, known, lengths, ids = tokenfile.open_section(raw)
    assert known.tolist() == [True, False, True, True] and lengths.tolist() == [1, 5000, 3, 9000] and doc_ids[known].tolist() == [3, 4, 4]
    assert ids.astype("<u4").tobytes() == b"".join(tokens)
