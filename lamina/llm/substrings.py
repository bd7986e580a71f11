"""Removal of long repeated strings, by a suffix sort over a cover of positions.

A difference cover picks positions so that any two suffixes meet picked ones after the
same few bytes; ranks of the picked suffixes then order all others. Here the cover is
content-defined: position a is picked if the 20-byte string there is the smallest (by a
hash, ties leftmost) in one of the windows of 31 starts. Every 50-byte string holds such
a position, and equal strings hold it at the same place, so equality of prefixes needs
no comparison of residues and works as a key of a shuffle.

1. Picked strings are named by a 64-bit hash and sorted by name over the cluster. A name
   that only one text has starts no repeated 50-byte string; it is dropped, with all
   suffixes that depend on it. This loses nothing. Tasks group their names first, so that
   a name which a third of all texts have meets in one place once for each task only.
2. The remaining suffixes are merged in at the names they meet: for each picked place the
   bytes that its windows span go to its name's group, ordered by document.
3. In each group the 50-byte prefixes are sorted and adjacent ones compared: all but
   those of the smallest document of a run are removed.

Equal texts are one text from the start: all but the one with the smallest id lose
everything; a text is known by its SHA-256. Names that more texts share than a task's even
share of all rows ("hot") don't go to one task: their prefixes are aggregated to the
smallest id by fingerprint, pre-aggregated before the shuffle, and joined back. Prefixes
are compared by two 64-bit polynomial fingerprints with random values of the bytes, fixed
by a seed, among those of the same name.

Defined results: a null text is empty; texts shorter than 50 bytes lose nothing; null
ids count as larger than all others and equal to each other; rows that share an id never
remove each other's bytes; repeated rows give repeated output rows; an empty table gives
an empty result; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import workers
from lamina.session import Scratch, release, small_batches

LENGTH, NAME = 50, 20
WINDOW = LENGTH - NAME + 1
#: Texts are read in pieces of this many bytes, which overlap by LENGTH - 1.
PIECE = 1 << 22
#: A name is hot if it has more than its even share of all rows in a task, and this many at least.
LEAST_HOT = 1000
#: Rows of names that a task gathers before it groups them, and parts that a name's local rows are dealt to.
GATHER, SALTS = 1 << 20, 64
_PLACE = np.uint64((1 << 23) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240101)
#: Values of the bytes, for names and prefixes and for the second hash of prefixes.
_VALUES, _OTHERS = (_RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(x: np.ndarray, k: int, values: np.ndarray = _VALUES) -> np.ndarray:
    """Mixed polynomial hash of each k consecutive bytes, from hashes of powers of two."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size, out, done = values[x], 1, None, 0
    while True:
        if k & size:
            # lower powers come last in the window
            part = h[k - done - size : k - done - size + n]
            out = part.copy() if out is None else out + part * np.uint64(pow(_MULTIPLIER, done, 1 << 64))
            done += size
        if size * 2 > k:
            return _mixed(out)
        h = h[:-size] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + h[size:]
        size *= 2


def sliding_minimum(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        v, size = np.minimum(v[:-size], v[size:]), size * 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def picked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-byte window of up to PIECE bytes: the place of its picked string, and the names of all places."""
    names = window_hashes(x, NAME)
    key = (_mixed(names) & ~_PLACE) | np.arange(len(names), dtype=np.uint64)
    return (sliding_minimum(key, WINDOW) & _PLACE).astype(np.int64), names


def pieces(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    x = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(x) - LENGTH + 1), PIECE - LENGTH + 1):
        yield at, x[at : at + PIECE]


def _raw(value) -> bytes:
    return (value.as_py() or "").encode()


def grouped(name: np.ndarray, digest: np.ndarray, salts: int) -> pa.RecordBatch:
    """Distinct (name, digest), sorted, with what is known here: the first text of a name is its hub's (salt 0), and whether another one has it."""
    order = np.lexsort((digest, name))
    name, digest = name[order], digest[order]
    new = np.r_[True, name[1:] != name[:-1]]
    keep = new | np.r_[True, digest[1:] != digest[:-1]]
    name, digest, new = name[keep], digest[keep], new[keep]
    sure = ~new | np.r_[~new[1:], False]
    salt = np.where(new, 0, 1 + digest % salts).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (name, digest, salt, sure)], names=["name", "digest", "salt", "sure"])


def name_rows(texts: DataFrame) -> DataFrame:
    """(name, digest, salt, sure): the distinct names of each text; texts(digest, text).

    Each task groups its rows: one text of each name goes to the name's hub, the others, already known
    to share it, are dealt by salt. So what meets at a hub is bounded by the number of tasks.
    """
    gather, salts = GATHER, SALTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digests, size = [], [], 0
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [names[np.unique(place)] for _, x in pieces(_raw(text)) for place, names in (picked(x),)]
                if own:
                    own = np.unique(np.concatenate(own))
                    held.append(own), digests.append(np.full(len(own), digest, np.int64))
                    size += len(own)
                if size > gather:
                    yield grouped(np.concatenate(held).view(np.int64), np.concatenate(digests), salts)
                    held, digests, size = [], [], 0
        if size:
            yield grouped(np.concatenate(held).view(np.int64), np.concatenate(digests), salts)

    return texts.mapInArrow(workers.task(run), "name long, digest long, salt int, sure boolean")


def shared_names(names: DataFrame) -> DataFrame:
    """(name, digest) of the names that at least two texts have, by one sort."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = names.repartition(parts, "name", "salt").sortWithinPartitions("name", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # the first row of a name, until a second one comes; the third line is `sure`
        last = None  # else the last row, which is out
        for batch in batches:
            rows = np.hstack([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)])])
            before = np.hstack([np.array([last]).T if last else rows[:2, :1], rows[:2, :-1]])
            again = (rows[:2] == before).all(axis=0)
            again[:1] &= last is not None
            again &= rows[2] == 0  # a row met again brings nothing new, unless it says that the name is shared
            rows = rows[:, ~again]
            if not rows.shape[1]:
                continue
            other = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]
            new = np.r_[last is None or rows[0, 0] != last[0], rows[0, 1:] != rows[0, :-1]]
            # rows of one name are neighbours: it is shared if one of them says so or a second text follows
            group = np.cumsum(new)
            shared = np.zeros(group[-1] + 1, bool)
            shared[group[(rows[2] == 1) | ~new & other]] = True
            if not new[0]:
                shared[0] = True
            keep = shared[group] & other
            open_group = group == group[-1]
            hold = not shared[group[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0, keep]), pa.array(rows[1, keep])], names=["name", "digest"])
            held, last = (rows[:, open_group], None) if hold else (rows[:, :0], tuple(rows[:2, -1].tolist()))

    return placed.mapInArrow(workers.task(run), "name long, digest long")


def _windows(text, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows that meet a wanted name at one place: (offset of the piece, its bytes, first window, last window, name)."""
    wanted = np.sort(wanted.astype(np.int64).view(np.uint64))
    for offset, x in pieces(_raw(text)):
        place, names = picked(x)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        name = names[place[first]]
        at = np.searchsorted(wanted, name)
        hit = wanted[np.minimum(at, len(wanted) - 1)] == name
        if hit.any():
            yield offset, x, first[hit], last[hit], name[hit]


def context_rows(rows: DataFrame) -> DataFrame:
    """(name, doc, digest, start, bytes) for every run of windows at a shared name; rows(doc, digest, names, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, digest = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                wanted = batch.column(2)[i].values.to_numpy()
                for offset, x, first, last, name in _windows(batch.column(3)[i], wanted):
                    raw, n = x.tobytes(), len(first)
                    spans = [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64)), pa.array(np.full(n, doc)), pa.array(np.full(n, digest)), pa.array(first + offset), pa.array(spans, pa.binary())],
                        names=["name", "doc", "digest", "start", "bytes"],
                    )

    return rows.select("doc", "digest", "names", "text").mapInArrow(workers.task(run), "name long, doc long, digest long, start long, bytes binary")


def _rebatched(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows`."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _runs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order in which rows equal in both hashes are neighbours, and where their runs begin."""
    order = np.argsort(one, kind="stable")
    unlike = two[order][1:] != two[order][:-1]
    if (unlike & (one[order][1:] == one[order][:-1])).any():  # different prefixes with the same first hash
        order = np.lexsort((two, one))
        unlike = two[order][1:] != two[order][:-1]
    return order, np.r_[True, unlike | (one[order][1:] != one[order][:-1])]


def removed_windows(contexts: DataFrame) -> DataFrame:
    """(doc, digest, start, mask): bit t is set where the window at start + t occurs in a smaller document; one sort by name and document."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = contexts.repartition(parts, "name").sortWithinPartitions("name", "doc", "digest", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # prefixes of the last name's group, by both hashes, and their smallest document
        last_name, seen, seen_too, low = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in _rebatched(batches):
            name, doc, digest, start = (batch.column(i).to_numpy() for i in range(4))
            spans = batch.column(4)
            x = np.frombuffer(b"".join(spans.to_pylist()), np.uint8)
            sizes = pa.compute.binary_length(spans).to_numpy().astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            windows = sizes - LENGTH + 1
            row = np.repeat(np.arange(len(sizes)), windows)
            t = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            prefix, other = (window_hashes(x, LENGTH, values)[begin[row] + t] for values in (_VALUES, _OTHERS))
            # the open group's earlier prefixes come first, so that they lead their runs
            every, every_too, docs = np.r_[seen, prefix], np.r_[seen_too, other], np.r_[low, doc[row]]
            order, head = _runs(every, every_too)
            lead = docs[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            gone = np.zeros(len(every), bool)
            gone[order] = docs[order] > lead
            gone = gone[len(seen) :]
            mask = np.zeros(len(sizes), np.int64)
            np.bitwise_or.at(mask, row[gone], np.int64(1) << t[gone])
            keep = mask != 0
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, digest, start, mask)], names=["doc", "digest", "start", "mask"])
            own = (name == name[-1])[row]
            n = len(seen) if last_name == name[-1] else 0
            pool, pool_too, pool_docs = np.r_[seen[:n], prefix[own]], np.r_[seen_too[:n], other[own]], np.r_[low[:n], doc[row[own]]]
            order, head = _runs(pool, pool_too)
            at = order[head]
            seen, seen_too, low, last_name = pool[at], pool_too[at], pool_docs[at], name[-1]

    return placed.mapInArrow(workers.task(run), "doc long, digest long, start long, mask long")


def hot_windows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for hot names, without a group per name: smallest document by prefix, pre-aggregated, then joined back.

    Prefixes with more than a task's even share of the rows are fewer than the tasks, so their smallest
    documents travel to the rows; all others are joined by prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, digest = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for offset, x, first, last, _ in _windows(batch.column(3)[i], batch.column(2)[i].values.to_numpy()):
                    n = last - first + 1
                    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    both = [pa.array(window_hashes(x, LENGTH, values)[at].view(np.int64)) for values in (_VALUES, _OTHERS)]
                    columns = [*both, pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), digest)), pa.array(at + offset)]
                    yield pa.RecordBatch.from_arrays(columns, names=["prefix", "other", "doc", "digest", "start"])

    windows = rows.select("doc", "digest", "names", "text").mapInArrow(workers.task(run), "prefix long, other long, doc long, digest long, start long")
    windows, key = scratch.table("hot_windows", windows), ["prefix", "other"]
    lowest = windows.groupBy(*key).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high")
    lowest = scratch.table("lowest", lowest.select(*key, "low", "n"))
    share = max(LEAST_HOT, windows.count() // int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = F.broadcast(lowest.where(F.col("n") > share))  # fewer rows than partitions
    found = windows.join(few, key).unionByName(windows.join(few.select(*key), key, "left_anti").join(lowest.where(F.col("n") <= share), key))
    return found.where("doc > low").select("doc", "digest", "start", F.lit(1).cast("long").alias("mask"))


def apply_masks(rows: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, kept) from rows(digest, text, marks); marks are (start, mask) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = _raw(batch.column(2)[i])
                marks = batch.column(3)[i].values
                start, mask = (marks.field(c).to_numpy().astype(np.int64) for c in ("start", "mask"))
                bits = (mask[:, None] >> np.arange(WINDOW)) & 1
                r, t = np.nonzero(bits)
                at = start[r] + t
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "digest", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc", "digest", "text", "marks").mapInArrow(workers.task(run), "doc long, digest long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def once_each(texts: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """texts(doc, digest, text) with one row of each (doc, digest); rows is the same without texts.

    Only keys that have several rows are grouped, and tasks keep one of their rows before the shuffle.
    """
    key = ["doc", "digest"]
    several = scratch.table("several", rows.groupBy(*key).count().where("count > 1").select(*key))
    if several.isEmpty():
        return texts
    grouped_ = texts.join(several, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(several, key, "left_anti").unionByName(grouped_)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    hot: texts that make a name hot; by default more than a partition's share of the shared names' rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    last = (1 << 63) - 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    texts = texts.withColumns({"doc": F.coalesce("doc_id", F.lit(last)), "digest": F.xxhash64("text", F.octet_length("text"))})
    rows = scratch.table("rows", texts.select("doc_id", "doc", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    # a text is its SHA-256; its short digest only says in tables of names and marks which text of a document is meant
    owners = scratch.table("owners", rows.groupBy("sha").agg(F.min("doc").alias("doc"), F.first("digest").alias("digest")))

    single = once_each(texts.select("doc", "digest", "text"), rows, scratch)

    shared = scratch.table("shared", shared_names(name_rows(texts.select("digest", "text"))))
    release(scratch)  # the shuffle of names
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = max(LEAST_HOT, shared.count() // parts) if hot is None else hot
    very = scratch.table("very", shared.groupBy("name").count().where(F.col("count") > hot).select("name"))  # fewer names than partitions
    any_hot = not very.isEmpty()

    def gathered(some: DataFrame) -> DataFrame:
        """Texts, once each, with their names of `some`."""
        lists = some.groupBy("digest").agg(F.collect_list("name").alias("names"))  # bounded by the text's own length
        lists = lists.join(owners.select("digest", "doc"), "digest").dropDuplicates(["doc", "digest"])
        return single.join(lists, ["doc", "digest"])

    usual = shared.join(very, "name", "left_anti") if any_hot else shared
    marks = removed_windows(context_rows(gathered(usual)))
    if any_hot:
        marks = marks.unionByName(hot_windows(gathered(shared.join(very, "name", "left_semi")), scratch))
    marks = scratch.table("marks", marks)
    scratch.drop("shared", "very", "hot_windows", "lowest")
    release(scratch)
    lists = marks.groupBy("doc", "digest").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    cut = scratch.table("cut", apply_masks(single.join(lists, ["doc", "digest"])).drop("kept"))
    scratch.drop("marks")

    named = rows.join(owners.select("sha", F.col("doc").alias("owner")), "sha").join(cut, ["doc", "digest"], "left")
    copy = (F.col("doc") > F.col("owner")) & (F.col("n_bytes") >= LENGTH)
    return named.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
