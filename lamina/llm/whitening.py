"""Embedding whitening by matrix-free block Lanczos.

The covariance is never formed. Each step multiplies it with a block of vectors in one
pass over the rows: a task centres its rows, multiplies them with the block and adds up
(dimension x block) sums, and the sums of the tasks are added by Spark. The driver holds
the basis and its image, dimension x steps numbers, whatever the number of rows. New
blocks are orthogonalised against the whole basis twice; directions that vanish
(a breakdown: the basis spans an invariant space) are replaced by random ones. Steps end
when the residuals of all wanted pairs are at the level of rounding, or when the basis
spans the space.

Entries are whole numbers x = floor(scale * c) + shift, so n and the sums S are exact and
a centred entry is (n * x - S) / n, rounded once.

Defined results: vectors that are null or hold null or non-finite entries are dropped,
and so are those whose length isn't the most frequent one (of equal counts the larger);
repeated rows and rows that share or lack an id each count and each give their rows; an
empty table, and rows that are all alike, give an empty result, since no direction has
variance; a component whose variance is below 1e-10 of the largest is rounding and is
left out; a deviation beyond 63 bits is null; entries whose scaled value doesn't fit 63
bits are an error. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import workers
from lamina.session import Scratch

#: Numbers that a task centres and multiplies at once.
ENTRIES = 1 << 21
#: Variance below this part of the largest is taken for rounding.
LEAST = 1e-10


def scaled(rows: DataFrame, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors without null or non-finite entries, as whole numbers."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = rows.where(v.isNotNull() & whole)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, rows as a matrix of whole numbers) in slices of bounded size."""
    step = max(1, ENTRIES // max(d, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, d)


def summed(table: DataFrame, d: int, size: int, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of `part`, which makes `size` numbers of a matrix of rows: added up within tasks, then by Spark."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(size, dtype), False
        for _, x in _matrices(batches, d):
            total += part(x).reshape(size)
            met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(dtype)))], names=["s"])

    sums = table.select("vec_id", "x").mapInArrow(workers.task(run), f"s array<{kind}>")
    found = sums.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # `size` rows
    out = np.zeros(size, dtype)
    for i, v in found:
        out[i] = v
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, least: float) -> np.ndarray:
    """An orthonormal block of the same width (less where the space is used up) that is orthogonal to the basis.

    Directions of the block that are no larger than `least` once the basis is taken out are replaced by random ones.
    """
    d, width = basis.shape[0], min(block.shape[1], basis.shape[0] - basis.shape[1])
    out = np.zeros((d, 0))
    for tried in range(50):
        held = np.hstack([basis, out])
        new = block if tried == 0 else rng.standard_normal((d, width - out.shape[1]))
        for _ in range(2):
            new = new - held @ (held.T @ new)
        left, sizes, _ = np.linalg.svd(new, full_matrices=False)
        fresh = left[:, sizes > (least if tried == 0 else 1e-6)][:, : width - out.shape[1]]
        fresh = fresh - held @ (held.T @ fresh)
        out = np.hstack([out, np.linalg.qr(fresh)[0]]) if fresh.shape[1] else out
        if out.shape[1] == width:
            break
    return out


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = 16, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, falling, of a symmetric operator, unit eigenvectors as columns, and the number of steps."""
    rng = np.random.default_rng(seed)
    basis, image, steps = np.zeros((d, 0)), np.zeros((d, 0)), 0
    q = orthonormal(rng.standard_normal((d, min(block, d))), basis, rng, 0.0)
    tolerance = 16 * np.finfo(float).eps * np.sqrt(d)
    while True:
        w = apply(q)
        basis, image, steps = np.hstack([basis, q]), np.hstack([image, w]), steps + 1
        projected = basis.T @ image
        values, s = np.linalg.eigh((projected + projected.T) / 2)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        vectors = basis @ s
        residuals = np.sqrt(((image @ s - vectors * values) ** 2).sum(axis=0))
        largest = max(float(np.abs(values).max()), np.finfo(float).tiny)
        if basis.shape[1] >= d or basis.shape[1] >= k and residuals.max() <= tolerance * largest:
            return values, vectors / np.sqrt((vectors**2).sum(axis=0)), steps
        q = orthonormal(w, basis, rng, 1e-11 * largest)


def whiten(
    rows: DataFrame, components: int = 32, block: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every kept row and component."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = scratch.table("entries", scaled(rows, scale, shift, id_col, vec_col))
    lengths = table.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], result)
    d, n = lengths[0]["d"], lengths[0]["count"]
    table = table.where(F.size("x") == d)
    sums = summed(table, d, d, "long", lambda x: x.sum(axis=0))
    centred = lambda x: (n * x - sums) / n
    trace = float(summed(table, d, 1, "double", lambda x: (centred(x) ** 2).sum())[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return summed(table, d, d * q.shape[1], "double", part).reshape(d, q.shape[1]) / n

    values, vectors, _ = block_lanczos(apply, d, min(components, d), block)
    kept = (values > LEAST * values[0]) & (values > 0)
    values, vectors = values[kept], vectors[:, kept]
    m = len(values)
    if not m:
        return spark.createDataFrame([], result)
    spread = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ spread
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = summed(table, d, m * m + m, "double", moments).reshape(m + 1, m) / n
    identity_error = float(np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, d):
            exact = n * x - sums
            fits = (exact.astype(float) ** 2).sum(axis=1) < 2.0**63
            deviation = pa.array((exact**2).sum(axis=1), mask=~fits)
            w, rows_here = (exact / n) @ spread, len(x)
            at = np.repeat(np.arange(rows_here), m)
            columns = [ids.take(pa.array(at)), np.tile(np.arange(1, m + 1, dtype=np.int32), rows_here), np.full(len(at), n), deviation.take(pa.array(at)), w.reshape(-1), np.tile(explained, rows_here), np.full(len(at), identity_error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[c.split()[0] for c in result.split(", ")])

    return table.select("vec_id", "x").mapInArrow(workers.task(run), result)
