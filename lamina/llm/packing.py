"""Best-fit packing by minimum bin slack.

Texts become token ids (and a final id 0); only what is longer than a sequence is cut.
Bins are planned on the histogram of piece lengths, which has at most `capacity` rows
whatever the corpus: each step anchors the longest length left, a bitset subset-sum
over the lengths available finds the fullest combination beside it, and the
combination is removed as many times as the counts allow. A piece's rank among the
pieces of its length then names its place. Ranks come from counts by (length, hash
bucket), so a length that a third of all pieces share is never ordered in one task.

Tokenising cuts texts where this tokenizer's tokens always end and keeps the ids of
common chunks; chunks met for the first time go through the tokenizer.

Defined results: a null or blank text is the single id 0; repeated rows are packed
each; a null id is packed like any other; an empty table gives an empty result; other
input columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm import workers
from lamina.session import Scratch, small_batches

CAPACITY = 2048
END = b"\0\0\0\0"
OWNER = "chunk ids"
#: Pieces of one length that are ranked in one task, about.
ROWS_RANKED = 200_000
#: Bytes of a kept chunk besides its text and ids: two objects and a place in a table.
ENTRY = 170
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class ChunkIds:
    """Ids of texts as little-endian bytes, put together from the ids of chunks; chunks met twice are kept, up to `most_bytes`.

    A table of bits remembers what was met once, so that chunks of a single text don't take the place.

    No token spans white space. Texts of ASCII and Latin-1 letters are also cut where the
    tokenizer's own pattern cuts, after its lower-casing, so that few chunks are distinct;
    all others (and texts that may hold a special token) are cut at ASCII white space only.
    """

    #: The tokenizer's pattern over lower-case Latin-1 bytes, and the bytes that are neither ASCII nor letters there.
    PATTERN = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d\x20a-z0-9\xdf-\xf6\xf8-\xff]+")
    OTHER = bytes([*range(0x80, 0xC0), 0xD7, 0xF7])
    LOWER = bytes(x + 32 if 65 <= x <= 90 or 0xC0 <= x <= 0xDE and x != 0xD7 else x for x in range(256))

    #: The settings of the tokenizer whose cuts PATTERN makes.
    NORMALIZERS = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, vocabulary: str, most_bytes: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known = self.cuts_alike(json.loads(self.tokenizer.to_str()))
        if not self.known:
            return
        #: The same without lower-casing and pattern, for chunks that have been through both.
        self.cut_tokenizer = Tokenizer.from_file(vocabulary)
        self.cut_tokenizer.normalizer = normalizers.Sequence([])
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        self.cut_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), bytewise])
        #: Whether an id ends a chunk, so that chunks, which hold no line breaks, can go through it as lines of one text.
        suffix = self.cut_tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(1 + max(self.cut_tokenizer.get_vocab().values()), bool)
        self.ends[[i for t, i in self.cut_tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.latin: dict[bytes, bytes] = {}
        self.raw: dict[bytes, bytes] = {}
        self.room = most_bytes
        self.met = bytearray(1 << 20)

    @classmethod
    def cuts_alike(cls, settings: dict) -> bool:
        """Whether a tokenizer cuts texts as PATTERN does; texts of any other go through it whole."""
        normal, cut = settings["normalizer"] or {}, settings["pre_tokenizer"] or {}
        kinds = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in normal.get("normalizers", [])]
        first, *rest = [*cut.get("pretokenizers", []), {}]
        split = first.get("type") == "Split" and first.get("invert") and (first.get("pattern") or {}).get("Regex") == cls.SPLIT
        bytewise = [x.get("type") for x in rest] == ["ByteLevel", None] and not rest[0]["use_regex"] and not rest[0]["add_prefix_space"]
        special = all(t["content"].startswith("<|") for t in settings["added_tokens"])
        return kinds == cls.NORMALIZERS and bool(split) and bytewise and special and not (settings["truncation"] or settings["padding"])

    @classmethod
    def of(cls, vocabulary: str) -> ChunkIds:
        """One for each worker process, which later tasks of packing find filled."""
        own = workers.kept(OWNER, lambda: {})
        if vocabulary not in own:
            own.clear()
            own[vocabulary] = cls(vocabulary)
        return own[vocabulary]

    def keep(self, known: dict[bytes, bytes], fresh: dict[bytes, bytes]) -> None:
        for chunk, ids in fresh.items():
            if self.room <= 0:
                return
            at = hash(chunk) & 0x7FFFFF
            bit = 1 << (at & 7)
            if self.met[at >> 3] & bit:
                known[chunk] = ids
                self.room -= len(chunk) + len(ids) + ENTRY
            else:
                self.met[at >> 3] |= bit

    def words(self, text: str) -> tuple[bool, list[bytes]]:
        """What ASCII white space parts, and whether PATTERN cuts it further."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or b"<|" in raw or not raw.isascii() and len(raw.translate(None, self.OTHER)) < len(raw):
            return False, text.encode().split()
        return True, raw.translate(self.LOWER).split()

    def fresh(self, latin: bool, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks by the tokenizer; those that PATTERN has cut go through it as lines of one text, if each ends in an id that ends chunks."""
        coder = self.cut_tokenizer if latin else self.tokenizer
        if latin:
            ids = np.array(coder.encode_batch_fast([b"\n".join(new).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(new) and ends[-1] == 4 * len(ids):
                raw, ends = ids.tobytes(), ends.tolist()
                return {c: raw[lo:hi] for c, lo, hi in zip(new, [0, *ends], ends)}
        whole = [c.decode("latin-1" if latin else "utf-8") for c in new]
        return {c: array("I", e.ids).tobytes() for c, e in zip(new, coder.encode_batch_fast(whole, add_special_tokens=False), strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.words(t) for t in texts]
        found = [b""] * len(texts)
        for latin, known in ((True, self.latin), (False, self.raw)):
            own = [(i, words) for i, (kind, words) in enumerate(cut) if kind == latin]
            unknown = [w for w in set().union(*(words for _, words in own)) if w not in known]
            chunks = {w: self.PATTERN.findall(w) if latin else [w] for w in unknown}
            new = list({c for part in chunks.values() for c in part if c not in known})
            fresh = {}
            for at in range(0, len(new), 1000):
                fresh |= self.fresh(latin, new[at : at + 1000])
            # for these texts all words are known, afterwards only the chunks that are kept
            known |= fresh
            whole = {w: b"".join(map(known.__getitem__, part)) for w, part in chunks.items() if len(part) > 1}
            known |= whole
            for i, words in own:
                found[i] = b"".join(map(known.__getitem__, words))
            for w in (*whole, *fresh):
                del known[w]
            self.keep(known, fresh)
        return found


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ids stay in the task and only their checksum leaves it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ChunkIds.of(vocabulary)
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["t"]]
            keys = batch["k"].to_list()
            del batch
            for at in range(0, len(texts), 500):
                for key, own in zip(keys[at : at + 500], ids.encode(texts[at : at + 500]), strict=True):
                    own += END
                    n = len(own) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = own[4 * start : 4 * (start + capacity)]
                        rows.append((key, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(workers.task(run, OWNER), PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and multiplicities with the largest sum up to `room`, longer lengths first, by bitset subset-sum."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, multiplicity of the step, sums reached before it
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            grown = (reach | reach << (length * times)) & mask
            if grown != reach:
                steps.append((length, times, reach))
                reach = grown
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:  # the sum needs this step
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: multiplicity}) until the histogram is used up."""
    counts = {x: n for x, n in histogram.items() if n}
    plan = []
    while counts:
        anchor = max(counts)
        counts[anchor] -= 1
        chosen = fullest(counts, capacity - anchor)
        counts[anchor] += 1
        chosen[anchor] = chosen.get(anchor, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        plan.append((times, chosen))
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that go to one place of one kind of bin, sorted by (length, rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def ranked(pieces: DataFrame, buckets: int = 1024) -> DataFrame:
    """Adds `rank`, from 0, among the pieces of the same length; pieces have a `place` that no two share."""
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("length", "bucket").count()
    ahead = F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("length", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("place"))
    return rows.withColumn("own", own).join(sums, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("own") - 1).drop("bucket", "own", "ahead")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    scratch = Scratch(docs.sparkSession, "pack")
    small_batches(docs.sparkSession)
    # written with their places, pieces keep them, also those of rows that share or lack an id
    placed = token_pieces(docs, vocabulary, capacity, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    pieces = scratch.table("pieces", placed)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    places = docs.sparkSession.sparkContext.broadcast(slots(plan_bins(histogram, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = places.value
        keys = (table["length"] << 48) + table["rank"]
        for batch in batches:
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(keys, (batch["length"].to_numpy() << 48) + rank, "right") - 1
            yield batch.drop(columns="rank").assign(sequence_id=table["sequence"][at] + rank - table["rank"][at], offset=table["offset"][at])

    names = [c.split()[0] for c in PIECES.split(", ")]
    buckets = max(1024, max(histogram.values(), default=0) // ROWS_RANKED)
    return ranked(pieces, buckets).select(*names, "rank").mapInPandas(workers.task(place), PACKED)
