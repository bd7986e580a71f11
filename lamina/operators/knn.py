"""Nearest neighbours by cosine distance: exact for one query, exact for a query set, and hashed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions import vectors


def nearest(corpus: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector, by rounded distance and then id: a scan and a top-k, no join."""
    if k == 0:
        return corpus.withColumn("distance", F.lit(0.0)).limit(0)
    scored = corpus.where(F.size(vec_col) == len(query)).withColumn("distance", vectors.rounded(vectors.cosine_distance(F.col(vec_col), vectors.literal(query))))
    return scored.orderBy("distance", id_col).limit(k)


def nearest_per_id(corpus: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k ids nearest to one vector where an id may have several: each counts by its nearest one, once."""
    scored = corpus.where(F.size(vec_col) == len(query)).select(id_col, vectors.rounded(vectors.cosine_distance(F.col(vec_col), vectors.literal(query))).alias("distance"))
    return scored.groupBy(id_col).agg(F.min("distance").alias("distance")).orderBy("distance", id_col).limit(k)


def _query_blocks(queries: DataFrame, vec_col: str, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the query set, in blocks of bounded size."""
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.select("qid", vec_col).withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    for b in range(blocks):
        own = numbered.where(F.col("_b") == b).orderBy("qid").collect()
        if own:
            yield np.array([r["qid"] for r in own], np.int64), np.array([r[vec_col] for r in own], np.float64)


def _merged_best(best: tuple[np.ndarray, np.ndarray], d: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest (distance, id) of each row, of those so far and new ones."""
    last = best[0].max(axis=1)
    if d.shape[1] > k and not np.isfinite(last).all():
        last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1])
    row, at = np.nonzero(d <= last[:, None])  # what may come in, with what ties
    return _merged(best, row, d[row, at], key[at], k)


def _merged(best: tuple[np.ndarray, np.ndarray], row: np.ndarray, d: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As _merged_best, of new ones given as (row, distance, id)."""
    if not len(row):
        return best
    some = np.unique(row)
    rows = np.r_[np.repeat(some, k), row]
    ds, ids = np.r_[best[0][some].reshape(-1), d], np.r_[best[1][some].reshape(-1), key]
    order = np.lexsort((ids, ds, rows))
    rows, ds, ids = rows[order], ds[order], ids[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    out = (best[0].copy(), best[1].copy())
    out[0][rows[keep], place[keep]], out[1][rows[keep], place[keep]] = ds[keep], ids[keep]
    return out


def _kept(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    hit = np.isfinite(best[0])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, hit.sum(axis=1))), pa.array(best[1][hit]), pa.array(best[0][hit])], names=["qid", "id", "distance"])


#: Rows of the corpus and queries that are compared with each other at once, and bytes of the queries that a cell holds, about.
STEP, HELD = 2048, 64 << 20


def _held(d: int, k: int) -> int:
    """Queries of d dimensions that a cell holds, with their k best rows."""
    return max(STEP, HELD // (8 * d + 16 * k))


def _in_cells(cells: DataFrame, k: int, d: int, parts: int) -> DataFrame:
    """(qid, id, distance) of at most k rows per query and cell; cells(cell, kind, key, v, most): queries are kind 0, rows of the corpus kind 1.

    Rows farther from a query than its `most` don't count. The queries of a cell come first and
    stay in memory, the rows of the corpus stream past.
    """
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell", "kind").select("cell", "kind", "key", "v", "most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, ids, q, most, best = None, [], None, None, None, None
        for batch in batches:
            cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            group = cell.astype(np.int64) * 2 + kind
            bounds = np.flatnonzero(np.diff(group, prepend=-1))
            for lo, hi in zip(bounds.tolist(), [*bounds[1:].tolist(), len(group)], strict=True):
                if cell[lo] != at:
                    if best is not None:
                        yield _kept(ids, best)
                    at, waiting, best = cell[lo], [], None
                key = batch.column(2).slice(lo, hi - lo).to_numpy()
                x = batch.column(3).slice(lo, hi - lo).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                if kind[lo] == 0:
                    waiting.append((key, x, batch.column(4).slice(lo, hi - lo).to_numpy()))
                    continue
                if not waiting:
                    continue  # a part without queries
                if best is None:
                    ids, q, most = (np.concatenate(c) for c in zip(*waiting, strict=True))
                    best = (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max))
                for s in range(0, len(x), STEP):
                    for r in range(0, len(q), STEP):
                        alike, so_far = q[r : r + STEP] @ x[s : s + STEP].T, (best[0][r : r + STEP], best[1][r : r + STEP])
                        last = np.minimum(so_far[0].max(axis=1), most[r : r + STEP])
                        if np.isfinite(last).all():  # few may come in: the others need no rounding
                            row, col = np.nonzero(alike >= (1.0 - last - 1e-6)[:, None])
                            distance = np.round(1.0 - alike[row, col], 6) + 0.0
                            near = distance <= last[row]
                            found = _merged(so_far, row[near], distance[near], key[s + col[near]], k)
                        else:
                            distance = np.round(1.0 - alike, 6) + 0.0
                            distance[distance > most[r : r + STEP, None]] = np.inf
                            found = _merged_best(so_far, distance, key[s : s + STEP], k)
                        best[0][r : r + STEP], best[1][r : r + STEP] = found
        if best is not None:
            yield _kept(ids, best)

    return dealt.mapInArrow(run, "qid long, id long, distance double")


def _deal(n: int) -> Column:
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _gridded(corpus: DataFrame, queries: DataFrame, k: int, d: int, blocks: int, asked: int) -> DataFrame:
    """(qid, id, distance) of at most k rows per query and part of the corpus, both sides shuffled.

    The corpus is dealt over parts, the queries over blocks, and each pair of a part and a
    block is a cell: a part goes to the cells of all blocks, a block to those of all parts.
    There are about four cells for a core, whatever the number of shuffle partitions, which
    grows with the rows: so what is shuffled grows with the rows alone. Only where a block
    would hold more than HELD bytes of queries there are more blocks.
    """
    tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism
    blocks = min(blocks, max(-(-asked // _held(d, k)), 2 * math.isqrt(tasks)))
    parts = -(-2 * tasks // blocks)
    most = F.lit(float("inf")).alias("most")
    left = queries.select("qid", "v").withColumn("b", _deal(blocks)).select(_every(parts).alias("p"), "b", F.lit(0).alias("kind"), F.col("qid").alias("key"), "v", most)
    right = corpus.withColumn("p", _deal(parts)).select("p", _every(blocks).alias("b"), F.lit(1).alias("kind"), F.col("id").alias("key"), "v", most)
    return _in_cells(left.unionByName(right).withColumn("cell", F.col("p") * blocks + F.col("b")), k, d, blocks * parts)


def nearest_in_lists(corpus: DataFrame, queries: DataFrame, k: int, d: int, lists: int) -> DataFrame:
    """(qid, id, distance, rank) of the k nearest rows of corpus(id, v, list) that are no farther than `most`, in the lists of each query; queries(qid, v, most, list) has a row for each list."""
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, blocks = max(1, -(-2 * tasks // lists)), max(1, -(-queries.count() // (lists * _held(d, k))))
    left = queries.withColumn("b", _deal(blocks)).select("list", _every(parts).alias("p"), "b", F.lit(0).alias("kind"), F.col("qid").alias("key"), "v", "most")
    right = corpus.withColumn("p", _deal(parts)).select("list", "p", _every(blocks).alias("b"), F.lit(1).alias("kind"), F.col("id").alias("key"), "v", F.lit(0.0).alias("most"))
    cells = left.unionByName(right).withColumn("cell", ((F.col("list") * parts + F.col("p")) * blocks + F.col("b")).cast("int"))
    return _ranked([_in_cells(cells, k, d, tasks)], corpus, k)


def _scanned(corpus: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """(qid, id, distance) of at most k rows per query and task; with centres, only rows of the `probes` lists nearest to the query are compared."""
    open_lists = None if centres is None else np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max))
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ok = lengths == q.shape[1]
            key = batch.column(0).to_numpy()[ok]
            x = batch.column(1).filter(pa.array(ok)).flatten().to_numpy().astype(np.float64).reshape(-1, q.shape[1])
            if centres is None:
                groups = [(slice(None), slice(at, at + STEP)) for at in range(0, len(x), STEP)]
            else:
                own = np.argmax(x @ centres.T, axis=1)
                groups = [(np.flatnonzero((open_lists == c).any(axis=1)), np.flatnonzero(own == c)) for c in np.unique(own).tolist()]
            for rows, some in groups:
                d = np.round(1.0 - q[rows] @ x[some].T, 6) + 0.0
                found = _merged_best((best[0][rows], best[1][rows]), d, key[some], k)
                best[0][rows], best[1][rows] = found
        yield _kept(ids, best)

    return corpus.mapInArrow(scan, "qid long, id long, distance double")


def _ranked(parts: list[DataFrame], corpus: DataFrame, k: int) -> DataFrame:
    if not parts:
        return corpus.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", block: int = 2000) -> DataFrame:
    """(qid, id, distance, rank) of the k nearest rows for every row of queries(qid, embedding); vectors of another length than the first query's don't count.

    A query set of one block at most travels to the tasks, which scan the corpus where it is.
    A larger one is never on the driver: both sides are shuffled in blocks. Either way a task
    keeps k candidates per query, and those of all tasks meet in the final ranking.
    """
    empty = corpus.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")
    asked = queries.where(F.size(vec_col) > 0).select(F.col("qid").cast("long").alias("qid"), F.col(vec_col).cast("array<float>").alias("v"))
    first = asked.select(F.size("v")).first()
    if k == 0 or first is None:
        return empty
    asked = asked.where(F.size("v") == first[0])
    n = asked.count()
    blocks = -(-n // block)
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.size("v") == first[0])
    if blocks > 1:
        return _ranked([_gridded(rows, asked, k, first[0], blocks, n)], corpus, k)
    return _ranked([_scanned(rows, ids, q, k) for ids, q in _query_blocks(asked, "v", block)], corpus, k)


def centres_of(corpus: DataFrame, lists: int, sample: int, id_col: str = "id", vec_col: str = "embedding", rounds: int = 12) -> np.ndarray:
    """Directions of `lists` groups of unit vectors, by spherical k-means on a bounded sample (the smallest hashes of the ids)."""
    rows = corpus.select(id_col, vec_col).orderBy(F.xxhash64(F.lit(3), id_col), id_col).limit(sample).collect()
    x = np.array([r[vec_col] for r in rows], np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            total = x[own == c].sum(axis=0)
            size = np.sqrt((total**2).sum())
            if size > 0:
                centres[c] = total / size
    return centres


def nearest_lists(
    corpus: DataFrame, queries: DataFrame, k: int, lists: int = 32, probes: int = 16, sample: int = 20_000,
    id_col: str = "id", vec_col: str = "embedding", block: int = 2000,
) -> DataFrame:
    """Approximate `nearest_batch`: every row belongs to the list of its nearest centre, and a query meets the rows of its `probes` nearest lists only."""
    centres = centres_of(corpus, lists, sample, id_col, vec_col)
    rows = corpus.select(F.col(id_col).cast("long"), vec_col)
    return _ranked([_scanned(rows, ids, q, k, centres, probes) for ids, q in _query_blocks(queries, vec_col, block)], corpus, k)


def nearest_lsh(corpus: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding", tables: int = 8, length: float = 1.0) -> DataFrame:
    """Approximate: random-projection hashing proposes rows, exact distances rank them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = corpus.select(id_col, vec_col, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=length, numHashTables=tables, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(query), 4 * k)
    return nearest(near.select(id_col, vec_col), query, k, id_col, vec_col).select(id_col, "distance")
