"""Whitening of embeddings through a bit-sliced scatter matrix.

Entries become integers: x = floor(1024 * c) + 100000. For the scatter matrix a
task shifts each dimension by its least value, cuts the shifted integers into
bit planes and packs every plane across the rows, 64 rows a word. The sum of
x_i * x_j over the rows is then the sum over plane pairs (p, q) of
2^(p + q) * popcount(plane_ip AND plane_jq): exact, whatever the number of rows.
A plane of ones adds the sums and the row count. Tasks emit one number for each
pair of dimensions, Spark adds them as decimals, and the driver (which holds
dimensions squared, nothing that grows with the rows) centres in whole numbers
before ``eigh``.

Edge cases: vectors that are null or hold a null or non-finite entry are left
out; so are vectors whose length is not the commonest one (the longest of
several such). Entries beyond +-2^48 after scaling count as that bound. Null and
repeated ids stay as rows of their own, repeated rows count as often as they
occur. Components without variance (one row, equal rows) are whitened to 0.
Fewer than ``top`` dimensions give as many components as there are. A deviation
that needs more than 38 digits is null. An empty table, or one with empty
vectors only, gives an empty result. Of the table only the kept columns and the
vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.llm.common import stored

SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 48)
TOP = 8
BLOCK = 1 << 14           # rows packed at a time
DIGITS = 10 ** 38
FLAT = 1e-13              # share of the trace below which a component has no variance


@dataclass(frozen=True)
class Model:
    n: int
    low: np.ndarray        # least x of each dimension
    sums: list[int]        # sums of x - low
    values: np.ndarray     # eigenvalues of the leading components, falling
    vectors: np.ndarray    # their unit eigenvectors, one a column
    trace: float


def whole(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is usable and of the commonest length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = rows.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    common = (rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("k"))
              .agg(F.max(F.struct("k", "d"))["d"]).first()[0])
    return rows.where(F.size(v) == F.lit(common or 0))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """x of a batch of vectors, one row each."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    scaled = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT)
    return scaled.astype(np.int64).reshape(-1, dims) + SHIFT


def _columns(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ranges(rows: DataFrame, vector: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            x = integers(_columns(b, vector), dims)
            if len(x):
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)],
                                             ["i", "low", "high"])

    got = (rows.select(F.col(f"`{vector}`")).mapInArrow(run, "i int, low long, high long")
           .groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect())
    return (np.array([r["low"] for r in got], np.int64), np.array([r["high"] for r in got], np.int64))


def planes(shifted: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of each dimension (lowest bit first), then a plane of ones;
    each packed across the rows into 64-bit words."""
    n, dims = shifted.shape
    words = -(-n // 64)
    out = np.zeros((sum(bits) + 1, words * 8), np.uint8)
    first = np.concatenate([[0], np.cumsum(bits)]).astype(int)
    for p in range(max(bits, default=0)):
        some = [d for d in range(dims) if bits[d] > p]
        packed = np.packbits(((shifted[:, some] >> p) & 1).astype(np.uint8), axis=0)
        out[first[some] + p, :packed.shape[0]] = packed.T
    ones = np.packbits(np.ones(n, np.uint8))
    out[-1, :len(ones)] = ones
    return out.view(np.uint64)


def scatter(rows: DataFrame, vector: str, low: np.ndarray, high: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sums over the rows of (x_i - low_i) * (x_j - low_j), i <= j, where
    dimension ``dims`` is constantly one."""
    dims = len(low)
    bits = [int(h - lo).bit_length() for lo, h in zip(low.tolist(), high.tolist())]
    owner = np.array([d for d, b in enumerate(bits) for _ in range(b)] + [dims])
    power = np.array([p for b in bits for p in range(b)] + [0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.zeros((2 * max(bits, default=0) + 1, dims + 1, dims + 1), np.int64)   # by p + q
        for b in batches:
            shifted = integers(_columns(b, vector), dims) - low
            for at in range(0, len(shifted), BLOCK):
                plane = planes(shifted[at:at + BLOCK], bits)
                for a in range(len(plane)):
                    met = np.bitwise_count(plane[a] & plane[a:]).sum(axis=1, dtype=np.int64)
                    # a pair of planes of one dimension stands for both orders
                    met[(owner[a:] == owner[a]) & (power[a:] != power[a])] *= 2
                    np.add.at(levels, (power[a] + power[a:], owner[a], owner[a:]), met)
        if not levels.any():
            return
        i, j = np.triu_indices(dims + 1)
        total = [0] * len(i)
        for s, level in enumerate(levels[:, i, j]):
            if level.any():
                total = [t + (v << s) for t, v in zip(total, level.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "j", "v"])

    got = (rows.select(F.col(f"`{vector}`")).mapInArrow(run, "i int, j int, v decimal(38,0)")
           .groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect())
    return {(r["i"], r["j"]): int(r["v"]) for r in got}


def fit(rows: DataFrame, vector: str = "embedding", top: int = TOP) -> Model | None:
    """Leading principal components of all ``rows`` (from ``whole``); None
    without rows or dimensions."""
    v = F.col(f"`{vector}`")
    first = rows.select(F.size(v).alias("d")).first()
    dims = first["d"] if first else 0
    if not dims:
        return None
    low, high = ranges(rows, vector, dims)
    met = scatter(rows, vector, low, high)
    n = met[dims, dims]
    sums = [met.get((d, dims), 0) for d in range(dims)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * met.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:top]
    lead = vectors[:, order]
    lead = lead * np.where(lead[np.abs(lead).argmax(axis=0), range(lead.shape[1])] < 0, -1.0, 1.0)
    return Model(n, low, sums, np.maximum(values[order], 0.0), lead, float(np.trace(cov)))


def deviations(off: np.ndarray, small: bool) -> pa.Array:
    """Sum of squares of each row, exact, as decimal(38,0)."""
    if small:
        return pa.array((off.astype(np.int64) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    total = (off * off).sum(axis=1).tolist()
    return pa.array([Decimal(t) if t < DIGITS else None for t in total], pa.decimal128(38, 0))


def project(rows: DataFrame, model: Model, vector: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, deviation decimal(38,0) and ``whitened`` (array, by component)."""
    dims, n = len(model.low), model.n
    spread = model.values > FLAT * max(model.trace, 0.0)
    axes = model.vectors * np.where(spread, 1 / np.sqrt(np.where(spread, model.values, 1.0)), 0.0)
    picked = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`"))
    schema = T.StructType([*[picked.schema[c] for c in keep], T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    low, sums = model.low, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shifted = integers(_columns(b, vector), dims) - low
            if not len(shifted):
                continue
            far = n * int(shifted.max()) + max(sums)
            small = dims * far * far < 1 << 63
            # exact n * x - S, in Python integers where 64 bits are too few
            off = shifted * n - np.array(sums) if far < 1 << 62 else (
                shifted.astype(object) * n - np.array(sums, dtype=object))
            white = (off / n).astype(np.float64) @ axes
            yield pa.RecordBatch.from_arrays(
                [*[_columns(b, c) for c in keep],
                 deviations(off if small else off.astype(object), small),
                 pa.ListArray.from_arrays(pa.array(range(0, white.size + 1, white.shape[1]), pa.int32()),
                                          pa.array(white.ravel()))],
                [*keep, "deviation", "whitened"])

    return picked.mapInArrow(run, schema)


def identity_error(white: DataFrame, top: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    w: list[Column] = [F.col("whitened")[k] for k in range(top)]
    mean = white.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(top) for j in range(i, top)]
    cov = white.agg(*[F.avg((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def whiten(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
           top: int = TOP) -> DataFrame:
    """One row per usable vector and component: ``keep``, component, n,
    deviation, whitened, explained, identity_error."""
    rows = whole(rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`")), vector)
    model = fit(rows, vector, top)
    names = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return rows.select(*names, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
                           F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"),
                           F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).limit(0)
    white = stored(project(rows, model, vector, keep), "whitened")
    count = len(model.values)
    error = identity_error(white, count)
    share = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.values])
    return white.select(*names, "deviation", F.posexplode("whitened").alias("_k", "_w")).select(
        *names, (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("_w").alias("whitened"), share[F.col("_k")].alias("explained"), F.lit(error).alias("identity_error"))
