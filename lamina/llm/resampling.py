"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features are the word 1- and 2-grams of a text, hashed into buckets by CRC-32. Tasks
turn documents into postings (bucket, document, count), one block of postings per batch
of documents and range of buckets, and count per range how often each bucket occurs in
what they have read. Blocks and counts are shuffled by range of buckets; counts of both
corpora come first, so a task computes the gains of its buckets locally, before it turns
its blocks into contributions (gain x count) by document. These meet by batch of
documents and are added up. The shuffle is by bucket, then by document; no text moves.

A range is dealt over `salts` tasks by batch, each of which gets the range's counts (one
row for each task that has read texts): that splits buckets that a third of all documents
share. Ranks come from a range-partitioned sort, so no task holds all scores.

The checksum of two words with a space between them follows from the checksums of the
words alone: a checksum moves over n further bytes by a linear map, tabulated for each n.

Defined results: a null or wordless text has no features and weight 0; repeated rows and
rows that share an id are documents of their own (of equal score and id in any order);
a null id draws as the empty id and ranks before others of the same score; empty tables
give an empty result, and an empty target is one without counts; other input columns are
ignored, whatever their names. The input's partitions must hold the same rows when they
are read again, as those of files do.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import workers
from lamina.operators.positions import numbered
from lamina.session import Scratch, small_batches

BUCKETS = 10_000
RANGES = 50
#: Bytes of text and documents of one block of postings, unless a single text has more.
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 8192
#: Words of more bytes are hashed on their own.
LONG_WORD = 63
#: Byte by byte: letters in lower case, digits and all that isn't ASCII stay, the rest parts words.
WORD_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
COUNTS, POSTINGS, DOCUMENTS = 0, 1, 2
SPOOL = "dealt int, salt int, kind int, batch long, n long, a binary, b binary, c binary"
SUMS = "batch long, kind int, a binary, b binary, c binary"


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """moves[n, k, x]: what byte x at place k of a checksum becomes n bytes later; spaces[n]: the same for the checksum of a space."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    at = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    space = np.array([zlib.crc32(b" ")], np.uint32)
    moves, spaces = [at], [space]
    for _ in range(LONG_WORD + 1):
        at, space = (table[x & 255] ^ (x >> np.uint32(8)) for x in (at, space))
        moves.append(at)
        spaces.append(space)
    return np.stack(moves), np.concatenate(spaces)


MOVES, SPACES = _moves()


class Checksums(dict):
    """CRC-32 of words in the low 32 bits, their length (LONG_WORD + 1 at most) above; emptied when large, and only words of usual length are kept."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | min(len(word), LONG_WORD + 1) << 32
        if len(word) <= LONG_WORD:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


def feature_checksums(words: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and document of every word and of every two consecutive words of the same document; docs: the document of each word, rising."""
    known = workers.kept("checksums", Checksums)
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    single, length = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), (found >> np.uint64(32)).astype(np.intp)
    pairs = np.flatnonzero(docs[1:] == docs[:-1])
    first, second, size = single[pairs], single[pairs + 1], length[pairs + 1]
    usual = np.minimum(size, LONG_WORD)
    flat, at = MOVES.reshape(-1), (usual + 1) * 1024
    both = second ^ SPACES[usual]
    for k in range(4):
        both ^= flat[at + 256 * k + ((first >> np.uint32(8 * k)) & np.uint32(255))]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        both[i] = zlib.crc32(b" " + words[pairs[i] + 1], int(first[i]))
    return np.concatenate([single, both]), np.concatenate([docs, docs[pairs]])


def postings(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, count) of a list of texts, by bucket and document, and the number of words of each."""
    cut = [t.translate(WORD_BYTES).split() for t in texts]
    n_words = np.fromiter(map(len, cut), np.int64, len(cut))
    words = [w for own in cut for w in own]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    sums, docs = feature_checksums(words, np.repeat(np.arange(len(texts)), n_words))
    key = (sums % np.uint32(buckets)).astype(np.uint64) * np.uint64(len(texts)) + docs.astype(np.uint64)
    key = np.sort(key.astype(np.uint32) if buckets * len(texts) < 2**32 else key)
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    key = key[starts].astype(np.int64)
    return key // len(texts), key % len(texts), np.diff(np.concatenate([starts, [len(docs)]])), n_words


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of bounded size, whole texts."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        own_ids, own, size = [], [], 0
        for i, t in zip(ids, texts, strict=True):
            t = t or b""
            if own and (size + len(t) > BLOCK_BYTES or len(own) >= BLOCK_DOCS):
                yield own_ids, own
                own_ids, own, size = [], [], 0
            own_ids.append(i)
            own.append(t)
            size += len(t)
        if own:
            yield own_ids, own


def _narrow(x: np.ndarray) -> bytes:
    """The numbers in the least of 1, 2, 4 or 8 bytes that holds all, after a byte that says which."""
    most = int(x.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def spool(docs: DataFrame, id_col: str | None, text_col: str, buckets: int, ranges: int, salts: int, target: bool) -> DataFrame:
    """Rows of SPOOL: counts per range and task; of documents also their postings per range and batch, and their ids and numbers of words."""
    width = -(-buckets // ranges)
    names = [c.split()[0] for c in SPOOL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        sums = np.zeros(ranges * width, np.int64)
        for ids, texts in _blocks(batches):
            bucket, doc, count, n_words = postings(texts, buckets)
            sums += np.bincount(bucket, weights=count, minlength=len(sums)).astype(np.int64)
            if target:
                continue
            batch, number = part << 32 | number, number + 1
            bounds = np.searchsorted(bucket, np.arange(ranges + 1) * width)
            rows = []
            for r, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if hi > lo:
                    per = np.bincount(bucket[lo:hi] - r * width, minlength=width)
                    rows.append((r, batch % salts, POSTINGS, batch, len(texts), _narrow(per), _narrow(doc[lo:hi]), _narrow(count[lo:hi])))
            keys = pa.array(ids, pa.int64())
            known = np.array(keys.is_valid())
            rows.append((ranges + batch % ranges, batch % salts, DOCUMENTS, batch, len(texts), np.array(keys.fill_null(0)).tobytes(), np.packbits(known).tobytes(), n_words.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], schema=SCHEMA)
        if sums.any():
            rows = [(r, s, COUNTS, 0, int(sums.sum()), bytes([target]), own.astype("<i8").tobytes(), b"") for r, own in enumerate(sums.reshape(ranges, width)) for s in range(salts)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], schema=SCHEMA)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    SCHEMA = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, SPOOL.split(", "), strict=True)])
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(key.alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(workers.task(run), SPOOL)


def gains(source: np.ndarray, target: np.ndarray, n_source: int, n_target: int, buckets: int) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket; 0 in both corpora is a share too."""
    return np.array([math.floor(1000 * math.log((t + 1) * (n_source + buckets) / ((s + 1) * (n_target + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def contributions(dealt: DataFrame, buckets: int, ranges: int) -> DataFrame:
    """Rows of SUMS: for each block of postings the sum of gains of each of its documents; rows of documents pass through.

    dealt: rows of `spool` by range and salt, counts first.
    """
    width = -(-buckets // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gain, counts, totals = None, None, None, None
        for arrived in batches:
            rows = []
            for r, salt, kind, batch, n, a, b, c in zip(*(x.to_pylist() for x in arrived.columns), strict=True):
                if kind == DOCUMENTS:
                    rows.append((batch, kind, a, b, c))
                    continue
                if at != (r, salt):
                    at, gain, counts, totals = (r, salt), None, np.zeros((2, width), np.int64), [0, 0]
                if kind == COUNTS:
                    counts[a[0]] += np.frombuffer(b, "<i8")
                    totals[a[0]] += n
                    continue
                if gain is None:
                    gain = gains(counts[0], counts[1], totals[0], totals[1], buckets)
                own = np.repeat(gain, _wide(a)) * _wide(c)
                doc = _wide(b)
                order = np.argsort(doc, kind="stable")
                sums = np.zeros(n, np.int64)
                first = np.concatenate([[0], np.flatnonzero(np.diff(doc[order])) + 1])
                sums[doc[order][first]] = np.add.reduceat(own[order], first)
                rows.append((batch, kind, sums.astype("<i8").tobytes(), b"", b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], schema=pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]))

    return dealt.mapInArrow(workers.task(run), SUMS)


def by_document(sums: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, place) of each document; sums: rows of `contributions` by batch."""
    result = "doc_id long, n_words long, n_features long, weight long, place long, batch long"

    def rows_of(batch: int, total: np.ndarray, ids: bytes, known: bytes, words: bytes) -> pa.RecordBatch:
        n_words = np.frombuffer(words, "<i8")
        n = len(n_words)
        missing = np.unpackbits(np.frombuffer(known, np.uint8), count=n) == 0
        n_features = n_words + np.maximum(n_words - 1, 0)
        weight = np.where(n_features > 0, total[:n] // np.maximum(n_features, 1), 0)
        columns = [pa.array(np.frombuffer(ids, np.int64), mask=missing), n_words, n_features, weight, np.arange(n), np.full(n, batch)]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[c.split()[0] for c in result.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, held = None, np.zeros(1, np.int64), None
        for arrived in batches:
            for batch, kind, a, b, c in zip(*(x.to_pylist() for x in arrived.columns), strict=True):
                if at != batch:
                    if held:
                        yield rows_of(at, total, *held)
                    at, total, held = batch, np.zeros(1, np.int64), None
                if kind == DOCUMENTS:
                    held = (a, b, c)
                    total = total + np.zeros(len(c) // 8, np.int64)
                else:
                    total = total + np.frombuffer(a, "<i8")
        if held:
            yield rows_of(at, total, *held)

    return sums.mapInArrow(workers.task(run), result)


def weigh(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", partitions: int | None = None
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, place, batch): the floored mean gain of every document's features; (batch, place) tells rows apart."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, 2 * parts // ranges)
    source = spool(docs, id_col, text_col, buckets, ranges, salts, False)
    rows = source.unionByName(spool(target, None, target_col, buckets, ranges, salts, True))
    dealt = rows.repartition(parts, "dealt", "salt").sortWithinPartitions("dealt", "salt", "kind")
    sums = contributions(dealt, buckets, ranges).repartition(parts, "batch").sortWithinPartitions("batch")
    return by_document(sums)


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Adds `score` (weight plus seeded Gumbel noise in thousandths) and `rank`, 1 for the highest, of the drawn part of the documents with enough words; null for the rest."""
    scratch = Scratch(weighed.sparkSession, "resampling")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = scratch.table("scored", weighed.withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    placed = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("batch"), F.col("place")], "rank")
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, **how) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, weighed towards the texts of `target`; how: see `weigh`."""
    return draw(weigh(docs, target, **how), percent, least_words, seed).select("doc_id", "n_features", "weight", "score", "rank")
