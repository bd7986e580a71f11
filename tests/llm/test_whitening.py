import math

import numpy as np
import pytest

from lamina.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, s string, n string, component string, deviation string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows], SCHEMA)


def brute(vectors, k):
    """n, deviations, eigenvalues and shares of the whole covariance, by a dense solver."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    exact = n * x - x.sum(axis=0)
    c = exact / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, [sum(int(v) ** 2 for v in row) for row in exact], values, c @ basis / np.sqrt(values), (c * c).sum() / n


def compare(got, ids, vectors, k):
    n, deviations, values, whitened, trace = brute(vectors, k)
    table = {}
    for r in got:
        table.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(table) == list(range(1, k + 1)) and len(got) == k * n
    for c in table:
        own = np.array([table[c][i]["whitened"] for i in ids])
        sign = np.sign(own @ whitened[:, c - 1])
        assert np.allclose(sign * own, whitened[:, c - 1], atol=1e-8)
        for place, i in enumerate(ids):
            r = table[c][i]
            assert (r["n"], r["deviation"]) == (n, deviations[place])
            assert abs(r["explained"] - values[c - 1] / trace) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((12, 12))
    vectors = [(rng.standard_normal(12) @ mix).astype(np.float32).tolist() for _ in range(300)]
    got = whitening.whiten(frame(spark, list(enumerate(vectors))), components=5, block=3).collect()
    compare(got, range(300), vectors, 5)


def test_query_on_the_whole_table(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op13_embedding_whitening(spark, small_dir).collect()
    compare(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 32)


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [math.nan, 1.0, 1.0, 1.0]), (103, [math.inf, 1.0, 1.0, 1.0]), (104, [-math.inf, 1.0, 1.0, 1.0]), (105, []), (106, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    compare(got, range(40), [v for _, v in good], 4)


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(5)
    base = [rng.standard_normal(3).astype(np.float32).tolist() for _ in range(10)]
    rows = [(7, base[0])] * 20 + [(None, v) for v in base] + [(7, base[1])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 3 * len(rows) and {r["n"] for r in got} == {len(rows)}
    assert sum(r["vec_id"] is None for r in got) == 30 and got[0]["identity_error"] < 1e-9
    assert abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-9


def test_no_variance(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5])])).collect() == []
    assert whitening.whiten(frame(spark, [(i, [0.5, 0.5]) for i in range(5)])).collect() == []
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and abs(flat[0]["explained"] - 1) < 1e-9


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [1e12 * i, 1.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got if r["deviation"] is None} and got[0]["identity_error"] < 1e-4


@pytest.mark.parametrize("d,k,block", [(1, 1, 4), (30, 4, 2), (200, 8, 8), (64, 64, 16), (50, 10, 1)])
def test_lanczos(d, k, block):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(1.5 ** -np.arange(d) * 100)[::-1]
    a = (q * values) @ q.T
    got, vectors, steps = whitening.block_lanczos(lambda b: a @ b, d, k, block)
    assert np.allclose(got, values[:k], atol=1e-10) and np.allclose(a @ vectors, vectors * got, atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert steps * block < d + block
    if d == 200:
        assert steps * block < d / 2


def test_lanczos_restarts_where_the_basis_is_invariant():
    a = np.diag([5.0] * 6 + [0.0] * 20 + [2.0])
    got, vectors, _ = whitening.block_lanczos(lambda b: a @ b, 27, 7, 2)
    assert np.allclose(got, [5.0] * 6 + [2.0]) and np.allclose(vectors.T @ vectors, np.eye(7), atol=1e-10)
