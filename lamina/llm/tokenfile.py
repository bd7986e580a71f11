"""Token ids in binary files of Simple-8b words, in ascending order of documents.

Texts are dealt to tasks by ranges of ids and sorted there, so files and the sections in
them follow each other in the order of documents. A section holds whole documents of about
SECTION_IDS ids: a header, the documents' ids and lengths, the first word of each block,
the words and the escaped numbers. The footer of a file lists its sections. The index
table has a row per section, which names the file; files of attempts that failed are
named nowhere. Reading back takes the sections from the index, one at a time and whole;
`read_ids` reads the blocks of a slice alone.

Texts are cut where the tokenizer's own pattern cuts, and a worker keeps the ids of the
pieces it has met; every piece goes through the tokenizer itself the first time.

Defined results: a null or empty text is the end id alone; repeated rows and rows that
share an id each have their place, those with another text by the text's hash; rows
without id come first; an empty table gives no file and an empty result; other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm import files, simple8b, workers
from lamina.session import Scratch, small_batches

SECTION_IDS = 1 << 20
FILE_BYTES = 256 << 20
MAGIC = b"IDS8B\x00\x00\x01"
#: Documents, ids, blocks, words, escaped numbers.
HEADER = struct.Struct("<5Q")
ENTRY = struct.Struct("<4Q")
OWNER = "byte chunk ids"
END = b"\0\0\0\0"
INDEX = "part int, section int, uri string, offset long, length long, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Classes of bytes; bytes from 0x80 on stand in letters of two bytes.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = np.array([LETTER if x >= 0x80 or 65 <= x <= 90 or 97 <= x <= 122 else DIGIT if 48 <= x <= 57 else SPACE if x in (9, 10, 11, 12, 13, 32) else OTHER for x in range(256)], np.uint8)


class Pieces:
    """Ids of pieces of text, found by two 64-bit hashes of their bytes; emptied when it has `most` pieces.

    An open-addressing table in arrays: what is found or added is found or added for all pieces of a call at once.
    """

    #: Bytes of a piece whose hash is taken; longer ones aren't kept.
    LONG = 1024

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.weights = np.random.default_rng(11).integers(0, 2**64, (2, self.LONG + 1), np.uint64) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.size, self.shift = 0, 64 - 17
        self.keys, self.place = np.zeros((2, 1 << 17), np.uint64), np.full(1 << 17, -1, np.int32)
        self.starts, self.counts, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    def hashes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Two hashes of each piece; the pieces cover `data` and none is longer than LONG."""
        at = np.arange(len(data)) - np.repeat(starts, lengths)
        value = data.astype(np.uint64) + np.uint64(1)
        return np.stack([np.add.reduceat(value * w[at], starts) for w in self.weights]) if len(starts) else np.zeros((2, 0), np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it isn't known."""
        out = np.full(h.shape[1], -1, np.int32)
        going, slot = np.arange(h.shape[1]), (h[0] >> np.uint64(self.shift)).astype(np.int64)
        while len(going):
            place = self.place[slot]
            same = (self.keys[0][slot] == h[0][going]) & (self.keys[1][slot] == h[1][going]) & (place >= 0)
            out[going[same]] = place[same]
            on = ~same & (place >= 0)
            going, slot = going[on], (slot[on] + 1) & (len(self.place) - 1)
        return out

    def _enter(self, h: np.ndarray, places: np.ndarray) -> None:
        going, slot = np.arange(h.shape[1]), (h[0] >> np.uint64(self.shift)).astype(np.int64)
        while len(going):
            free = np.flatnonzero(self.place[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)  # one of those that want the same free slot
            won = free[first]
            self.place[slot[won]] = places[going[won]]
            self.keys[:, slot[won]] = h[:, going[won]]
            left = np.ones(len(going), bool)
            left[won] = False
            going, slot = going[left], (slot[left] + 1) & (len(self.place) - 1)

    def add(self, h: np.ndarray, ids: list[array]) -> np.ndarray:
        """Keep unknown pieces, all different; returns their places."""
        n, counts = len(ids), np.fromiter(map(len, ids), np.int32, len(ids))
        while 2 * (self.size + n) > len(self.place):
            old = np.flatnonzero(self.place >= 0)
            keys, places = self.keys[:, old], self.place[old]
            self.shift -= 1
            self.keys, self.place = np.zeros((2, 2 * len(self.place)), np.uint64), np.full(2 * len(self.place), -1, np.int32)
            self._enter(keys, places)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        self.starts, self.counts = (np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)]) if self.size + n > len(x) else x for x in (self.starts, self.counts))
        self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool)), np.uint32)]) if self.used + len(flat) > len(self.pool) else self.pool
        places = np.arange(self.size, self.size + n, dtype=np.int32)
        self.starts[places], self.counts[places] = self.used + np.cumsum(counts) - counts, counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.used, self.size = self.used + len(flat), self.size + n
        self._enter(h, places)
        return places

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        counts = self.counts[places]
        ends = np.cumsum(counts)
        return self.pool[np.repeat(self.starts[places] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], counts


class ByteTokens:
    """Ids of byte-level tokenizers that cut by their own pattern and keep case and white space.

    Texts of ASCII and of Latin letters in two bytes are cut where the tokenizer cuts, all of a
    block at once, by the classes of neighbouring bytes. Others are cut before single spaces
    between other characters, where it always cuts too; what may hold a special token isn't cut.
    """

    #: Letters of U+00C0 to U+017F; the rest of the bytes from 0x80 on means another way.
    LATIN = re.compile(rb"(?:[\x00-\x7f]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])*+")
    BLOCK = 1 << 20
    SPACES = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known = self.cuts_alike(json.loads(self.tokenizer.to_str()))
        #: The same for pieces that have been cut.
        self.cut_tokenizer = Tokenizer.from_file(vocabulary)
        if self.known:
            self.cut_tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        self.pieces = Pieces()

    @staticmethod
    def cuts_alike(settings: dict) -> bool:
        """Whether a tokenizer cuts as `cuts` does; texts of any other go through it whole."""
        cut = settings["pre_tokenizer"] or {}
        special = all(t["content"].startswith("<|") for t in settings["added_tokens"])
        bytewise = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        return settings["normalizer"] is None and bytewise and special and not (settings["truncation"] or settings["padding"])

    @classmethod
    def of(cls, vocabulary: str) -> ByteTokens:
        """One for each worker process, which later tasks find filled."""
        own = workers.kept(OWNER, lambda: {})
        if vocabulary not in own:
            own.clear()
            own[vocabulary] = cls(vocabulary)
        return own[vocabulary]

    @staticmethod
    def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pieces of joined texts begin; ends: where each text ends (none is empty).

        A piece is a run of letters, digits or others, with the space before it; of white space
        before something else the last character is left out of the run; after an apostrophe
        that begins a piece come s, t, m, d, re, ve or ll and nothing else.
        """
        kind = CLASSES[data]
        begins = np.zeros(len(data), bool)
        begins[0], begins[ends[:-1]] = True, True
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        after = np.empty_like(kind)
        after[-1], after[:-1] = SPACE, kind[1:]
        blank = np.zeros(len(data), bool)  # a space before, in the same text
        blank[1:] = data[:-1] == 32
        white = kind == SPACE
        start = np.where(white, (before != SPACE) | (after != SPACE) & ~last, (kind != before) & ~blank) | begins
        quotes = np.flatnonzero((data == 39) & start)
        if len(quotes):
            text_end = ends[np.searchsorted(ends, quotes, "right")]
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            pair = one.astype(np.uint16) << np.uint16(8) | two
            long = np.isin(pair, [0x7265, 0x7665, 0x6C6C]) & (quotes + 2 < text_end)
            short = np.isin(one, [0x73, 0x74, 0x6D, 0x64]) & (quotes + 1 < text_end)
            for hit, size in ((short, 2), (long, 3)):
                start[quotes[hit] + 1] = False
                following = quotes[hit] + size
                start[following[following < len(data)]] = True
        return np.flatnonzero(start)

    def _encode_latin(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
        starts = self.cuts(data, ends)
        lengths = np.diff(starts, append=len(data))
        if lengths.max() > Pieces.LONG:
            return [self._whole(t) for t in texts]
        h = self.pieces.hashes(data, starts, lengths)
        if self.pieces.size > self.pieces.most:
            self.pieces.clear()
        places = self.pieces.find(h)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            _, first, back = np.unique(h[0][missing] ^ (h[1][missing] >> np.uint64(1)), return_index=True, return_inverse=True)
            raw, new = data.tobytes(), missing[first]
            words = [raw[s : s + n].decode() for s, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)]
            ids = [array("I", e.ids) for at in range(0, len(words), 20_000) for e in self.cut_tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
            places[missing] = self.pieces.add(h[:, new], ids)[back]
        flat, counts = self.pieces.ids(places)
        own = np.add.reduceat(counts, np.searchsorted(starts, ends - sizes))
        raw, stops = flat.astype("<u4").tobytes(), 4 * np.cumsum(own)
        return [raw[b - 4 * n : b] for b, n in zip(stops.tolist(), own.tolist(), strict=True)]

    def _whole(self, raw: bytes) -> bytes:
        text = raw.decode()
        cut = [text] if not self.known or "<|" in text else self.SPACES.split(text)
        return b"".join(array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(cut, add_special_tokens=False))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8) as little-endian 32-bit numbers."""
        out, block, size = [b""] * len(texts), [], 0
        for at, text in enumerate(texts):
            if not text:
                continue
            if not self.known or b"<|" in text or self.LATIN.match(text).end() < len(text):
                out[at] = self._whole(text)
                continue
            block.append(at)
            size += len(text)
            if size >= self.BLOCK:
                for place, ids in zip(block, self._encode_latin([texts[i] for i in block]), strict=True):
                    out[place] = ids
                block, size = [], 0
        if block:
            for place, ids in zip(block, self._encode_latin([texts[i] for i in block]), strict=True):
                out[place] = ids
        return out


def pack_section(keys: list[int | None], tokens: list[bytes]) -> bytes:
    """A section of documents with their ids as little-endian 32-bit numbers."""
    ids = np.frombuffer(b"".join(tokens), "<u4")
    words, escapes, offsets = simple8b.encode(ids)
    known = np.packbits(np.array([k is not None for k in keys], bool))
    head = HEADER.pack(len(keys), len(ids), len(offsets), len(words), len(escapes))
    lengths = np.fromiter(map(len, tokens), "<u8", len(tokens)) // 4
    doc_ids = np.array([k or 0 for k in keys], "<i8")
    return b"".join([head, doc_ids.tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), known.tobytes()])


def _layout(head: bytes) -> tuple[tuple[int, ...], list[int]]:
    """The counts of a section and where its parts begin: doc ids, lengths, offsets, words, escapes, flags, end."""
    docs, ids, blocks, words, escapes = counts = HEADER.unpack(head)
    at = [HEADER.size]
    for size in (8 * docs, 8 * docs, 4 * blocks, 8 * words, 8 * escapes, -(-docs // 8)):
        at.append(at[-1] + size)
    return counts, at


def open_section(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, which of them are known, lengths, all ids) of a section."""
    (docs, n, *_), at = _layout(raw[: HEADER.size])
    if len(raw) != at[-1]:
        raise ValueError(f"a section of {at[-1]} bytes has {len(raw)}")
    doc_ids, lengths, offsets, words, escapes = (np.frombuffer(raw[a:b], kind) for a, b, kind in zip(at[:-2], at[1:-1], ("<i8", "<u8", "<u4", "<u8", "<u8"), strict=True))
    known = np.unpackbits(np.frombuffer(raw[at[-2] :], np.uint8), count=docs).astype(bool)
    return doc_ids, known, lengths.astype(np.int64), simple8b.decode(words, escapes, offsets, n)


def read_ids(reader: files.Reader, uri: str, offset: int, first: int, last: int) -> np.ndarray:
    """The ids `first` to `last` (exclusive) of the section at `offset`, from the blocks that hold them."""
    (docs, n, blocks, words, escapes), at = _layout(reader.read(uri, offset, HEADER.size))
    first, last = max(0, first), min(last, n)
    if first >= last:
        return np.zeros(0, np.uint64)
    lo, hi = first // simple8b.BLOCK, -(-last // simple8b.BLOCK)
    offsets = np.append(np.frombuffer(reader.read(uri, offset + at[2], 4 * blocks), "<u4"), words).astype(np.int64)
    own = np.frombuffer(reader.read(uri, offset + at[3] + 8 * int(offsets[lo]), 8 * int(offsets[hi] - offsets[lo])), "<u8")
    escaped = np.frombuffer(reader.read(uri, offset + at[4], 8 * escapes), "<u8")
    found = simple8b.decode(own, escaped, offsets[lo:hi] - offsets[lo], min(n, hi * simple8b.BLOCK) - lo * simple8b.BLOCK)
    return found[first - lo * simple8b.BLOCK : last - lo * simple8b.BLOCK]


class Writer:
    """One file: magic bytes, sections, and a footer with (offset, length, documents, ids) of each section."""

    def __init__(self, folder: str):
        self.uri, self.stream = files.create(folder, "ids", ".s8b")
        self.stream.write(MAGIC)
        self.at, self.entries = len(MAGIC), []

    def add(self, keys: list[int | None], tokens: list[bytes]) -> tuple[int, int, int, int]:
        raw = pack_section(keys, tokens)
        self.stream.write(raw)
        self.entries.append((self.at, len(raw), len(keys), sum(map(len, tokens)) // 4))
        self.at += len(raw)
        return self.entries[-1]

    def close(self) -> None:
        self.stream.write(b"".join(ENTRY.pack(*e) for e in self.entries) + struct.pack("<Q", len(self.entries)) + MAGIC)
        self.stream.close()


def sections(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, length, documents, ids) of all sections of a file, by its footer."""
    if raw[: len(MAGIC)] != MAGIC or raw[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a whole file of token ids")
    end = len(raw) - len(MAGIC) - 8
    (n,) = struct.unpack("<Q", raw[end : end + 8])
    return list(ENTRY.iter_unpack(raw[end - n * ENTRY.size : end]))


def write_ids(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write all ids; returns the index, a row per section (lazy: write it out before reading back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteTokens.of(vocabulary)
        writer, number, part = None, 0, 0
        keys, tokens, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal writer, number, keys, tokens, size
            if writer is None or writer.at > FILE_BYTES:
                if writer is not None:
                    writer.close()
                writer = Writer(folder)
            offset, length, n_docs, n_ids = writer.add(keys, tokens)
            row = [part, number, writer.uri, offset, length, n_docs, n_ids]
            number, keys, tokens, size = number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        try:
            for batch in batches:
                part = batch.column(2)[0].as_py() if batch.num_rows else part
                own, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for at in range(0, len(texts), 500):
                    for key, found in zip(own[at : at + 500], coder.encode(texts[at : at + 500]), strict=True):
                        keys.append(key)
                        tokens.append(found + END)
                        size += len(found) // 4 + 1
                        if size >= SECTION_IDS:
                            yield flush()
            if keys:
                yield flush()
        finally:
            if writer is not None:
                writer.close()

    schema = pa.schema([("part", pa.int32()), ("section", pa.int32()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("place", F.monotonically_increasing_id())
    keys = [F.col("k").asc_nulls_first(), F.col("h"), F.col("place")]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return placed.select("k", "t", F.spark_partition_id().alias("p")).mapInArrow(workers.task(run, OWNER), INDEX)


def with_start(index: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all sections before: sums by part (as many as tasks have written) and within a part."""
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("own"))
    ahead = F.sum("own").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("section").rowsBetween(W.unboundedPreceding, -1))
    return index.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(parts), "part").withColumn("start", F.col("ahead") + F.col("within")).drop("ahead", "within")


def read_back(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; index: sections with their `start`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.Reader()
        for batch in batches:
            for uri, offset, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, known, lengths, ids = open_section(reader.read(uri, offset, length))
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                view = memoryview(raw)
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=~known), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])
        reader.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(parts, "part", "section").sortWithinPartitions("uri", "offset")
    return dealt.select("uri", "offset", "length", "start").mapInArrow(workers.task(run), RESULT)


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the ids of all texts to files of the shared folder and return what reading them back gives for each document."""
    scratch = Scratch(docs.sparkSession, "ids")
    small_batches(docs.sparkSession)
    index = scratch.table("index", write_ids(docs, vocabulary, scratch.path("files"), id_col, text_col, partitions))
    return read_back(with_start(index))
