"""Whitening against exact integer arithmetic and numpy's covariance."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import whitening as w
from scrivener.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>"


def whole_numbers(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]


def check(rows, vectors, top):
    """``rows`` of the query against plain sums over ``vectors`` (id, vector)."""
    x = whole_numbers(v for _, v in vectors)
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    off = [[n * r[d] - sums[d] for d in range(dims)] for r in x]
    want = {}
    for (i, _), o in zip(vectors, off):
        want.setdefault(i, []).append(sum(v * v for v in o))
    centred = np.array([[v / n for v in o] for o in off])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1][:top]
    total = np.trace(cov) or 1.0
    assert len(rows) == n * len(values)
    for r in rows:
        assert r.n == n and int(r.deviation) in want[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / total, rel=1e-9, abs=1e-15)
    return x, centred, cov, values


def test_whitened_components(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(301, 12)) * np.linspace(2.0, 0.1, 12)
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] * 12),
           (1004, [1.0, 2.0]), (1005, [])]
    df = spark.createDataFrame([*vectors, *bad], SCHEMA).repartition(5)
    for c in ("n", "component", "whitened", "deviation", "i", "_k", "d"):
        df = df.withColumn(c, F.lit(c))
    rows = w.whiten(df).collect()
    _, centred, cov, values = check(rows, vectors, 8)
    white = np.zeros((301, 8))
    for r in rows:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9
    assert rows[0].identity_error < 1e-9
    for k in range(8):                       # each column is the projection on one unit eigenvector
        axis = centred.T @ white[:, k] / 301 / math.sqrt(values[k])
        assert np.linalg.norm(axis) == pytest.approx(1, abs=1e-9)
        assert np.abs(cov @ axis - values[k] * axis).max() < 1e-6


def test_scatter_is_exact_for_any_width(spark):
    rows = [[0.0, 1e9, -3.5, 7.0], [1e-4, -1e9, -3.5, 8.0], [123.456, 2.0, -3.5, 7.5]] * 30
    df = w.whole(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)],
                                       "vec_id long, embedding array<double>").repartition(3))
    low, high = w.ranges(df, "embedding", 4)
    met = w.scatter(df, "embedding", low, high)
    x = [[math.floor(1024 * c) + 100_000 - lo for c, lo in zip(r, low.tolist())] + [1] for r in rows]
    for i in range(5):
        for j in range(i, 5):
            assert met.get((i, j), 0) == sum(r[i] * r[j] for r in x)


def test_packed_planes_give_back_the_numbers():
    x = np.random.default_rng(0).integers(0, 32, (130, 3))
    planes = w.planes(x, [5, 5, 5])
    bits = np.unpackbits(planes.view(np.uint8), axis=1)[:, :130]
    assert (bits[[0, 5, 10]].T == x & 1).all()
    assert (bits[4] == x[:, 0] >> 4).all() and bits[-1].all()


def test_large_deviations_are_exact_or_null():
    off = np.array([[10 ** 17, 3], [10 ** 19, 10 ** 19]], dtype=object)
    assert w.deviations(off, False).to_pylist() == [Decimal(10 ** 34 + 9), None]


@pytest.mark.parametrize("vectors", [[(1, [0.5, 0.25])], [(1, [1.0, 2.0])] * 7, [(None, [1.0]), (2, [3.0]), (2, [3.0])]])
def test_few_or_equal_rows(spark, vectors):
    rows = w.whiten(spark.createDataFrame(vectors, SCHEMA)).collect()
    check(rows, vectors, 8)
    if len({tuple(v) for _, v in vectors}) == 1:
        assert all(r.whitened == 0 and r.explained == 0 and r.identity_error == 1 for r in rows)
    else:
        assert all(r.identity_error < 1e-9 for r in rows)


def test_nothing(spark):
    want = w.whiten(spark.createDataFrame([(1, [0.5, 0.25])], SCHEMA)).dtypes
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        got = w.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.dtypes == want


def test_query_on_the_table(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op13_whitening"](spark, SF_SMALL)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), vectors, 8)
