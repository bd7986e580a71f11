"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. Hashes fall into the
blocks of a sketch by their high bits, and each block is the XOR of its hashes' words.
Each difference between two sets touches one block only, so of sets whose symmetric
difference is at most d, in a sketch of more than d blocks some block is untouched and
equal. Sizes are cut into bands; a pair meets in the band of its smaller set, whose
largest possible d fixes the number of blocks. Blocks of one element or none say little.
Each band has spare blocks: if a set has no more small blocks than that, some untouched
block is not small, and it emits the larger ones only (at two elements, else at one, else
all). A pair is found at the level of the surer of its sets, whose blocks both emit.

Equal blocks propose candidates. A second, flat parity sketch (one bit for each hash)
bounds the symmetric difference from below by its Hamming distance and removes most of
them; the rest are verified on the sets themselves.

Only links between different sets are looked for: equal sets are one class from the
start. Within a block's bucket each class is first compared with the smallest one. What
those links don't connect is compared pair by pair inside tasks, in tiles of bounded
size; pairs inside one component are never tested again, none across components is
skipped, and a tile gives only links that join components. So components are those of
all links, and no table holds all pairs of a group of copies.

Hashes are 64 bits: of words, of shingles and of whole sets (class ids). A collision of
class ids stops the run.

Defined results: a null or blank text has an empty set, n_shingles 0 and is linked with
nothing; a text with fewer words than a shingle is one shingle; repeated rows and ids
give a row each; component_id is the smallest id reachable (null only if all are null),
which for an empty set is its own id; an empty table gives an empty result; other input
columns are ignored by `link` and kept by `keep_one`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import features, graph, workers
from lamina.session import Scratch, release, small_batches

#: The shortest flat sketch has two to this power bits.
LEAST_BITS = 9
SPARE = 0.2
TILE, TILE_HASHES = 512, 2_000_000
#: Keys that a task gathers before it groups them, and parts that a key's local rows are dealt to.
GATHER, SALTS = 1 << 20, 64
ROWS = "doc_id long, mark long, cls long, proof long, n long, sketch binary"


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (A-Z lower-cased); the whole sequence as one if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = features.word_hashes(words)
    return np.unique(features.window_hashes(h, min(k, len(h))))


class Sets:
    """The sorted distinct shingle hashes of some texts, one after another: those of text i are hashes[starts[i]:starts[i + 1]]."""

    def __init__(self, texts: list[str | None], k: int):
        words = [(t or "").encode().lower().split() for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = features.word_hashes(list(itertools.chain.from_iterable(words)))
        del words
        first = np.r_[0, np.cumsum(counts)]
        lengths = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        at = np.r_[0, np.cumsum(lengths)]
        h = np.zeros(at[-1], np.uint64)
        if len(flat) >= k:
            windows, of_word = features.window_hashes(flat, k), np.repeat(np.arange(len(counts)), counts)
            h[np.repeat(counts >= k, lengths)] = windows[of_word[: len(windows)] == of_word[k - 1 :]]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            h[at[i]] = features.window_hashes(flat[first[i] : first[i + 1]], int(counts[i]))[0]
        for i in np.flatnonzero(lengths > 1):
            h[at[i] : at[i + 1]].sort()
        keep = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        keep[at[:-1][lengths > 0]] = True
        self.hashes, self.number = h[keep], np.repeat(np.arange(len(counts)), lengths)[keep]
        self.sizes = np.bincount(self.number, minlength=len(counts))
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    def __len__(self) -> int:
        return len(self.sizes)

    def only(self, chosen: np.ndarray) -> Sets:
        """Some of the sets, by a mask."""
        out = object.__new__(Sets)
        mine = chosen[self.number]
        out.hashes, out.number, out.sizes = self.hashes[mine], (np.cumsum(chosen) - 1)[self.number[mine]], self.sizes[chosen]
        out.starts = np.r_[0, np.cumsum(out.sizes)]
        return out

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i + 1]]

    def _folded(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self), np.uint64)
        some = self.sizes > 0
        if some.any():
            out[some] = ufunc.reduceat(values, self.starts[:-1][some])
        return out

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each set."""
        size = self.sizes.astype(np.uint64)
        one = self._folded(np.add, self.hashes) + size
        two = self._folded(np.bitwise_xor, features.mixed(self.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + size
        return features.mixed(one ^ features.mixed(two)).view(np.int64), features.mixed(two ^ features.mixed(one)).view(np.int64)

    def sketches(self) -> list[bytes]:
        """Flat parity sketches: one bit for each hash, at least as many bits as elements."""
        out: list[bytes] = [b""] * len(self)
        bits = sketch_bits(self.sizes)
        for width in np.unique(bits).tolist():
            rows = np.flatnonzero(bits == width)
            step = max(1, (1 << 19) // width)
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                place = np.zeros(len(self), np.int64)
                place[own] = np.arange(len(own))
                chosen = np.zeros(len(self), bool)
                chosen[own] = True
                mine = chosen[self.number]
                bit = place[self.number[mine]] * width + (self.hashes[mine] & np.uint64(width - 1)).astype(np.int64)
                packed = np.packbits(np.bincount(bit, minlength=len(own) * width).astype(np.uint8) & 1).reshape(len(own), -1)
                for i, row in zip(own.tolist(), packed, strict=True):
                    out[i] = row.tobytes()
        return out


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the flat sketch of a set of n hashes: a power of two."""
    return np.int64(1) << np.maximum(LEAST_BITS, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def stacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, folded to the shortest of them (a hash's bit is its low bits, so halves XOR)."""
    words = [np.frombuffer(x, np.uint64) for x in sketches]
    least = min(map(len, words), default=0)
    for i, w in enumerate(words):
        while len(w) > least:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        words[i] = w
    return np.stack(words) if words else np.zeros((0, 0), np.uint64)


def in_parts(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """Some texts at a time, about `most` characters (a longer text alone)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def bands(num: int, den: int, most: int) -> np.ndarray:
    """First size of each band up to `most`: a pair's sizes lie in the same or in neighbouring bands."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, starts[-1] * den // num + 1))
    return np.array([*starts, starts[-1] * den // num + 1], np.int64)


def block_keys(sets: Sets, starts: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, number of the set) of the sets' blocks, for the band of each one's size and for the one below."""
    own = np.searchsorted(starts, sets.sizes, "right") - 1
    words = features.mixed(sets.hashes)
    high = sets.hashes >> np.uint64(32)
    for band in (own - 1, own):
        most = (starts[band + 1] - 1) * (den - num) // num  # largest symmetric difference; if 0, only equal sets are similar
        blocks = np.where((band >= 0) & (sets.sizes > 0) & (most > 0), most + 1 + np.ceil(SPARE * (most + 1)).astype(np.int64), 0)
        used = blocks[sets.number] > 0
        if not used.any():
            continue
        number = sets.number[used]
        block = (high[used] * blocks[number].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (number[1:] != number[:-1])])
        value, number, block, size = np.bitwise_xor.reduceat(words[used], first), number[first], block[first], np.diff(np.r_[first, len(block)])
        # a set leaves out blocks of one element, or none, if an untouched fuller block is certain without them
        lacking = [blocks - np.bincount(number[size >= c], minlength=len(sets)) for c in (1, 2)]
        spare = blocks - most - 1
        level = np.where(lacking[1] <= spare, 2, np.where(lacking[0] <= spare, 1, 0))
        keep = size >= level[number]
        key = lambda v, b, n, band=band: features.mixed(v ^ features.mixed(b + ((band[n] + 1).astype(np.uint64) << np.uint64(32))))
        yield key(value[keep], block[keep], number[keep]), number[keep]
        for i in np.flatnonzero((level == 0) & (blocks > 0)):
            empty = np.setdiff1d(np.arange(blocks[i], dtype=np.uint64), block[number == i])
            some = np.full(len(empty), i)
            yield key(np.zeros(len(empty), np.uint64), empty, some), some


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _mark(text: Column) -> Column:
    """With the id, which may be null or repeated, the key of a row: a hash of its text."""
    return F.xxhash64(text.cast("string"))


def set_rows(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, mark, class, second class hash, size and flat sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in in_parts(batch.column(1).to_pylist()):
                sets = Sets(part, k)
                columns = [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), *map(pa.array, sets.classes()), pa.array(sets.sizes.astype(np.int64)), pa.array(sets.sketches(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "cls", "proof", "n", "sketch"])
                at += len(part)

    return texts.withColumn("mark", _mark(F.col("text"))).mapInArrow(workers.task(run), ROWS)


def grouped(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, lead, is lead) of distinct pairs; the lead of a key is its smallest class."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.r_[True, key[1:] != key[:-1]]
    keep = new | np.r_[True, cls[1:] != cls[:-1]]
    key, cls, new = key[keep], cls[keep], new[keep]
    first = np.flatnonzero(new)
    return key, cls, np.repeat(cls[first], np.diff(np.r_[first, len(key)])), new


def key_rows(texts: DataFrame, k: int, num: int, den: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, cls, lead, salt) of the blocks of all classes, or those of one part of the keys.

    Each task gives the blocks of a class once, however many rows have it, and groups its keys:
    one class of each key leads (lead null, salt 0), the others go with it, dealt by salt. So
    what meets in one place for a key is bounded by the number of tasks, not by its rows.
    """
    gather, salts = GATHER, SALTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = bands(num, den, 1 << 20)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()  # of the rows of this task

        def rows() -> pa.RecordBatch:
            key, cls, lead, first = grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
            salt = np.where(first, 0, 1 + cls % salts).astype(np.int32)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(lead, mask=first), pa.array(salt)], names=["key", "cls", "lead", "salt"])

        for batch in batches:
            for some in in_parts(batch.column(1).to_pylist()):
                sets = Sets(some, k)
                cls = sets.classes()[0]
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if not fresh.any():
                    continue
                sets, cls = sets.only(fresh), cls[fresh]
                if sets.sizes.max() >= starts[-2]:
                    starts = bands(num, den, 2 * int(sets.sizes.max()))
                for key, number in block_keys(sets, starts, num, den):
                    if parts > 1:
                        mine = key % np.uint64(parts) == np.uint64(part)
                        key, number = key[mine], number[mine]
                    held.append((key.view(np.int64), cls[number]))
                if sum(len(x) for x, _ in held) > gather:
                    yield rows()
        if held:
            yield rows()

    return texts.mapInArrow(workers.task(run), "key long, cls long, lead long, salt int")


def buckets(keys: DataFrame) -> DataFrame:
    """(key, lead, other) for every key with at least two classes: each class but the smallest has a row, with its task's lead or, if it leads there, the smallest."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartition(parts, "key", "salt").sortWithinPartitions("key", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = lead = last_cls = None
        for batch in batches:
            leading = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            key, cls, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy()
            if not leading.all():
                yield pa.RecordBatch.from_arrays([pa.array(x[~leading]) for x in (key, own, cls)], names=["key", "lead", "other"])
            key, cls = key[leading], cls[leading]
            if not len(key):
                continue
            new = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            leads = np.empty(len(key), np.int64)
            at = first[0] if len(first) else len(key)
            leads[:at] = lead if at else 0
            leads[at:] = np.repeat(cls[first], np.diff(np.r_[first, len(key)]))
            repeat = np.r_[(not new[0]) and cls[0] == last_cls, ~new[1:] & (cls[1:] == cls[:-1])]
            keep = ~new & ~repeat & (cls != leads)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, leads, cls)], names=["key", "lead", "other"])
            last_key, lead, last_cls = key[-1], leads[-1], cls[-1]

    return placed.mapInArrow(workers.task(run), "key long, lead long, other long")


def _bounded(n_a, n_b, hamming, num: int, den: int):
    """Whether sets of these sizes with at least this symmetric difference can reach the similarity."""
    total = n_a + n_b
    return (total - hamming) * den >= (total + hamming) * num


def prune(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, hamming) of the pairs that their sizes and flat sketches allow."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pa.compute.binary_length(batch.column(i)).to_numpy() for i in (4, 5)]
            width = np.minimum(*sizes)
            hamming = np.zeros(batch.num_rows, np.int64)
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                for at in range(0, len(own), max(1, (1 << 23) // int(w))):
                    some = own[at : at + max(1, (1 << 23) // int(w))]
                    one, two = (stacked([*batch.column(i).take(pa.array(some)).to_pylist(), b"\0" * int(w)])[:-1] for i in (4, 5))
                    hamming[some] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            keep = _bounded(batch.column(2).to_numpy(), batch.column(3).to_numpy(), hamming, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[keep]), pa.array(batch.column(1).to_numpy()[keep]), pa.array(hamming[keep])], names=["a", "b", "hamming"])

    return rows.mapInArrow(workers.task(run), "a long, b long, hamming long")


def sets_of(needed: DataFrame, classes: DataFrame, texts: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(cls, s) of the classes needed(cls), made again from one text of each."""
    needed = needed.distinct().join(classes.select("cls", "rep"), "cls")
    reps = needed.select(F.col("rep.doc_id").alias("id"), "rep.mark").distinct()
    found = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("id")) & (_mark(F.col("text")) == F.col("mark")), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch.column(1).to_pylist()):
                sets = Sets(part, k)
                yield pa.RecordBatch.from_arrays([pa.array(sets.classes()[0]), pa.array([sets.of(i).tobytes() for i in range(len(sets))], pa.binary())], names=["cls", "s"])

    sets = found.mapInArrow(workers.task(make), "cls long, s binary")
    return scratch.table(f"sets_{name}", sets.join(needed.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose sets have the similarity."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")), classes, texts, k, scratch, name)
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("s").alias(f"s_{x}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(den * both >= num * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = scratch.table(f"links_{name}", rows.mapInArrow(workers.task(check), "a long, b long"))
    scratch.drop(f"sets_{name}")
    return links


def tiled(members: DataFrame, *carried: str) -> DataFrame:
    """Rows of buckets dealt to pairs of tiles (x <= y), sorted; members(key, cls, root, n, main, mains, total, most, ...).

    A tile has about TILE rows and TILE_HASHES hashes, so a pair of tiles fits a task. Tiles of
    the bucket's largest component come last and don't meet each other: a large group of near
    copies beside a few other classes is dealt once for each tile of those.
    """
    rows_of = F.greatest(F.lit(16), F.least(F.lit(TILE), F.floor(F.lit(TILE_HASHES) / F.col("most")))).cast("long")
    others = F.ceil((F.col("total") - F.col("mains")) / rows_of).cast("int")
    tiles = others + F.ceil(F.col("mains") / rows_of).cast("int")
    hashed = F.xxhash64(F.lit(5), "cls")
    own = F.when(F.col("main"), others + F.pmod(hashed, tiles - others)).otherwise(F.pmod(hashed, others)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.when(F.col("main"), others).otherwise(tiles) - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    rows = members.withColumn("own", own).withColumn("tile", F.explode(spread)).select("key", "tile.x", "tile.y", "own", "cls", "root", "n", *carried)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole pairs of tiles from sorted batches."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        key = np.stack([held.column(i).to_numpy().astype(np.int64) for i in range(3)])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True) if len(ends) else ():
            yield held.slice(i, j - i)
        held = held.slice(ends[-1]) if len(ends) else held
    if held is not None and held.num_rows:
        yield held


class _Tile:
    """One pair of tiles: candidates of a row by root, size and sketch."""

    def __init__(self, rows: pa.RecordBatch, num: int, den: int):
        x, y = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        own, self.cls, self.root, self.n = (rows.column(i).to_numpy() for i in (3, 4, 5, 6))
        self.root = self.root.copy()
        self.words = stacked(rows.column(7).to_pylist())
        self.left, self.right, self.same = np.flatnonzero(own == x), np.flatnonzero(own == y), x == y
        self.num, self.den = num, den

    def fitting(self, i: int) -> np.ndarray:
        """Rows of other components that may be similar to row i, nearest first."""
        j = self.right[self.right > i] if self.same else self.right
        j = j[(self.root[j] != self.root[i]) & (np.minimum(self.n[j], self.n[i]) * self.den >= np.maximum(self.n[j], self.n[i]) * self.num)]
        hamming = np.bitwise_count(self.words[j] ^ self.words[i]).sum(axis=1, dtype=np.int64)
        fit = _bounded(self.n[j], self.n[i], hamming, self.num, self.den)
        return j[fit][np.argsort(hamming[fit], kind="stable")]


def unlike(rows: DataFrame) -> DataFrame:
    """Buckets (key, cls, root, n) of several components, those of the same classes once, with total, largest n and the size of their largest component.

    Counts are made by key and component first, so a bucket of very many classes is never ordered or gathered.
    """
    marks = [F.sum(F.xxhash64("cls", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)]
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("total"), F.max("n").alias("most"), *marks)
    sums = [F.sum(c).alias(c) for c in ("total", "h0", "h1")]
    alike = parts.groupBy("key").agg(*sums, F.max("most").alias("most"), F.count("*").alias("roots"), F.max(F.struct("total", "root")).alias("main"))
    alike = alike.where("roots > 1").groupBy("total", "most", "h0", "h1").agg(F.min(F.struct("key", "main")).alias("e"))
    alike = alike.select("e.key", "total", "most", F.col("e.main.total").alias("mains"), F.col("e.main.root").alias("main_root"))
    return rows.join(alike, "key").withColumn("main", F.col("root") == F.col("main_root")).drop("main_root")


def open_classes(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that may be similar to one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            tile, hit = _Tile(rows, num, den), np.zeros(rows.num_rows, bool)
            for i in tile.left:
                j = tile.fitting(i)
                hit[j] = True
                hit[i] |= len(j) > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(tile.cls[hit])], names=["cls"])

    return tiles.mapInArrow(workers.task(run), "cls long").distinct()


def links_across(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links that join all components of each pair of tiles that have one: at most a link per row, not a row per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            tile, found = _Tile(rows, num, den), []
            sets = [np.frombuffer(s, np.uint64) for s in rows.column(8).to_pylist()]
            for i in tile.left:
                for j in tile.fitting(i):
                    if tile.root[j] != tile.root[i]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                            found.append((tile.cls[i], tile.cls[j]))
                            tile.root[tile.root == tile.root[j]] = tile.root[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(found, np.int64).T.copy()], names=["a", "b"])

    return tiles.mapInArrow(workers.task(run), "a long, b long")


def classes_and_roots(docs: DataFrame, k: int, num: int, den: int, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, cls, n) of all documents and (node, root) of the classes that have links."""
    texts = _texts(docs, id_col, text_col)
    rows = scratch.table("rows", set_rows(texts, k))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("proof").alias("p"), F.max("proof").alias("q"))
    sure = F.when(F.col("p") == F.col("q"), F.col("cls")).otherwise(F.raise_error(F.lit("two sets share a class id")).cast("long"))
    classes = scratch.table("classes", classes.select(sure.alias("cls"), "rep", "n", "sketch"))
    # a set has about 2 * (den - num) / num keys per hash; their shuffles follow one another to bound the disk
    parts = max(1, -(-8 * (den - num) // num))
    stars = None
    for part in range(parts):
        own = scratch.table(f"stars_{part}", buckets(key_rows(texts, k, num, den, part, parts)))
        stars = own if stars is None else stars.unionByName(own)
        release(scratch)

    pairs = stars.select(F.col("lead").alias("a"), F.col("other").alias("b")).distinct()
    tried = scratch.table("tried", prune(pairs, classes, num, den))
    check = lambda some, name: verify(some, classes, texts, k, num, den, scratch, name)
    ends = tried.select(F.explode(F.array(F.struct("a", "b", "hamming", F.col("a").alias("node")), F.struct("a", "b", "hamming", F.col("b").alias("node")))).alias("e")).select("e.*")
    nearest = ends.groupBy("node").agg(F.min(F.struct("hamming", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    first = scratch.table("first", nearest)
    links = check(first, "first")
    roots = scratch.table("roots_first", graph.components(links, scratch, "c_first"))
    release(scratch)

    def apart(some: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs that no path connects yet."""
        side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
        joined = some.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return joined.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")

    rest = scratch.table("rest", apart(tried.join(first, ["a", "b"], "left_anti"), roots))
    if not rest.isEmpty():
        links = scratch.table("links_two", links.unionByName(check(rest, "rest")))
        roots = scratch.table("roots_two", graph.components(links, scratch, "c_two"))
        release(scratch)

    # buckets whose classes are still in several components, beyond those of a single pair, which is settled
    several = stars.groupBy("key").agg(F.count("*").alias("pairs")).where("pairs > 1").select("key")
    placed = stars.join(several, "key").select("key", F.explode(F.array("lead", "other")).alias("cls")).distinct()
    placed = placed.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.select("key", "cls", F.coalesce("root", "cls").alias("root")).join(classes.select("cls", "n"), "cls")
    members = scratch.table("members", unlike(placed))
    if not members.isEmpty():
        sketched = members.join(classes.select("cls", "sketch"), "cls")
        near = scratch.table("near", open_classes(tiled(sketched, "sketch"), num, den))
        release(scratch)
        if not near.isEmpty():
            # few classes are left, and most buckets now hold the same ones
            closer = members.join(near, "cls", "left_semi").select("key", "cls", "root", "n")
            closer = scratch.table("closer", unlike(closer))
            full = closer.join(classes.select("cls", "sketch"), "cls").join(sets_of(near, classes, texts, k, scratch, "near"), "cls")
            release(scratch)
            links = scratch.table("links_three", links.unionByName(links_across(tiled(full, "sketch", "s"), num, den)))
            roots = scratch.table("roots_three", graph.components(links, scratch, "c_three"))
    scratch.drop(*(f"stars_{part}" for part in range(parts)), "tried", "first", "rest", "members", "near", "closer", "sets_near")
    release(scratch)
    return rows.select("doc_id", "mark", "cls", "n"), roots


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and class size of every row; linked where den * intersection >= num * union."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    small_batches(docs.sparkSession)
    rows, roots = classes_and_roots(docs, k, num, den, scratch, id_col, text_col)
    sized = rows.groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    named = sized.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = scratch.table("named", named.join(lows, "root").select("cls", "component_id", "copies"))
    out = rows.join(by_class, "cls")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("copies")).otherwise(1).alias("copies"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id (null last), then class, then mark. Rows without words all stay.

    Rows that share an id, or have none, are documents of their own: only links remove rows.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    small_batches(docs.sparkSession)
    rows, roots = classes_and_roots(docs, k, num, den, Scratch(docs.sparkSession, "jaccard"), id_col, text_col)
    groups = rows.groupBy("doc_id", "mark", "cls").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "mark", "copies")).alias("e")
    by_class = groups.where("n > 0").groupBy("cls").agg(least).select("e.doc_id", "e.cls", "e.mark", "e.copies")
    named = by_class.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    of_words = named.groupBy("root").agg(least).select("e.doc_id", "e.mark", F.col("e.copies") > 1)
    kept = of_words.union(groups.where("n = 0").select("doc_id", "mark", F.lit(False))).toDF("_j_id", "_j_mark", "_j_repeats")
    kept = scratch.table("kept", kept)
    # as one struct the columns of the documents, whatever their names, clash with nothing
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), _mark(F.col(text_col)).alias("mark"))
    found = whole.join(kept, F.col("id").eqNullSafe(F.col("_j_id")) & (F.col("mark") == F.col("_j_mark"))).select("id", "mark", "row", "_j_repeats")
    repeats = found.where("_j_repeats").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return found.where("not _j_repeats").select("row.*").unionByName(repeats.select("row.*"))
