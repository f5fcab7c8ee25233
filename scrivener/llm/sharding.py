"""Uniform shuffle into shards of exact size, by a hypergeometric communication
matrix.

A uniform random permutation of all rows sends a partition's rows to the shards
in counts that follow the multivariate hypergeometric law. Those counts are
drawn first (a table of partitions by shards); each partition then permutes its
labels locally, rows are exchanged, and each shard permutes what it got. Shard
sizes are exact (at most one apart) and every row is equally likely everywhere.

The partitions are the files of a written copy, and a row's labels follow from
its file and its place in it. They stay the same whatever tasks read the files,
so a lost executor, a new split or another batch size changes nothing.

Inside a shard the second permutation runs over random blocks (as many as the
session has reducers), so a shard of any size is never sorted in one task:
block sizes give the offsets, the rank in the block the rest of the slot.

Edge cases: null text has size 1 (0 bytes plus 1) and the checksum of the empty
text. Repeated rows and ties are separate rows. With fewer rows than shards
some shards are empty; an empty table gives an empty result. The draw is
repeatable for the same rows in the same input partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.llm.common import fresh, slots, stored

SHARDS = 16
SEED = 20240


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. Inversion from the
    mode by the ratio of neighbouring probabilities, for populations of any
    size; 40 standard deviations either way hold all mass a double can tell."""
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    total = good + bad
    mode = min(max(((n + 1) * (good + 1)) // (total + 2), low), high)
    sd = math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(total - 1, 1))
    reach = int(40 * sd) + 50
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    up = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    down = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    cdf = np.cumsum(np.r_[down[::-1], 1.0, up])
    return mode - len(down) + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Counts of partition p's rows that go to shard s; row sums are ``rows``,
    column sums ``sizes``."""
    rng = np.random.default_rng([seed, 0])
    left = [int(s) for s in sizes]
    out = np.zeros((len(rows), len(sizes)), dtype=np.int64)
    for p, n in enumerate(rows):
        need, rest = int(n), sum(left)
        for s, good in enumerate(left):
            if not need:
                break
            k = hypergeometric(rng, good, rest - good, need)
            out[p, s] = k
            rest -= good
            need -= k
            left[s] -= k
    return out


def _labels(files: dict[str, int], matrix: np.ndarray, seed: int):
    """UDF of (file path, row in the file): file number x shards + shard. The
    permutation of a file's labels depends on the file alone, so a row gets the
    same label in any task, split, batch or retry."""
    shards = matrix.shape[1]

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, labels = None, np.zeros(0, dtype=np.int64)
        for path, row in batches:
            out = np.empty(len(row), dtype=np.int64)
            for name, at in path.groupby(path).indices.items():
                p = files[name]
                if p != last:
                    rng = np.random.default_rng([seed, 1, p])
                    last, labels = p, rng.permutation(np.repeat(np.arange(shards, dtype=np.int64), matrix[p]))
                out[at] = p * shards + labels[row.to_numpy()[at]]
            yield pd.Series(out)

    return F.pandas_udf(run, T.LongType())


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED,
          names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``docs`` with its shard (int) and slot (long, gapless from 0 per shard).
    A column of ``docs`` that has one of the ``names`` stays; the new column then
    gets that name with underscores before it."""
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns}
    names = tuple(fresh(docs, n) if n.lower() in taken else n for n in names)
    held = stored(docs, "to-shard")
    meta = held.metadataColumn("_metadata")
    path, at = meta["file_path"], meta["row_index"]
    counts = {r["f"]: r["n"] for r in held.select(path.alias("f")).groupBy("f")
              .agg(F.count(F.lit(1)).alias("n")).collect()}         # one row per written file
    files = {f: p for p, f in enumerate(sorted(counts))}
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[f] for f in files], sizes, seed)
    blocks = max(1, math.ceil(2 * slots(spark) / shards))
    label = _labels(files, matrix, seed)
    s, b, o, first = (fresh(docs, x) for x in ("shard", "block", "order", "first"))

    def labelled(columns: list[Column]) -> DataFrame:
        """``columns`` of the rows with shard, random block and second-permutation key."""
        row = fresh(docs, "row")
        rows = held.select(*columns, label(path, at).alias(s), at.alias(row))
        p = F.floor(F.col(s) / shards)
        return rows.select(
            *columns, (F.col(s) % shards).cast("int").alias(s),
            F.pmod(F.xxhash64(F.lit(seed), p, row), F.lit(blocks)).cast("int").alias(b),
            F.xxhash64(F.lit(seed + 1), p, row).alias(o))

    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    start = stored(labelled([]).groupBy(s, b).agg(F.count(F.lit(1)).alias("n")).select(     # shards x blocks rows
        F.col(s).alias(f"{first}_s"), F.col(b).alias(f"{first}_b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)), "blocks")
    rank = F.row_number().over(Window.partitionBy(s, b).orderBy(o)) - 1
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return (labelled(kept).withColumn(o, rank)
            .join(F.broadcast(start), (F.col(s) == F.col(f"{first}_s")) & (F.col(b) == F.col(f"{first}_b")))
            .select(*kept, F.col(s).alias(names[0]), (F.col(first) + F.col(o)).cast("long").alias(names[1])))
