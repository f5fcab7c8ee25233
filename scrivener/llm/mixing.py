"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Of all document rates that meet the
targets, the one nearest to "every document once" in relative entropy is an
exponential tilt: rate = exp(lambda * size / mean size), cut at the largest
number of copies. Lambda, one per source, solves the convex dual: safeguarded
Newton steps, each an aggregate of the words taken and their slope over all
documents (grouped by source and size beforehand, which is exact).

Rates become whole copies so that the words a source yields stay near its
target: sizes are gone through from the largest down, each size getting the
nearest whole number of copies for its rate plus the words still owed. Within a
size, the documents that get one copy more are drawn by a hash of the row.

Edge cases: null text has size 0 and stays once, taking no words. A null source
is a source of its own, ranked last. If all texts are empty, all targets are 0.
An empty table gives an empty result. Rows that repeat are drawn separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.llm.common import WORD, fresh, slots, stored

WEIGHTS = (5, 2, 1)
CAP = 3                  # most copies of a document, and most times its size for a source
TOLERANCE = 1e-6         # of the target, where the Newton steps end
MAX_STEPS = 80


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _told(field: T.StructField) -> list[Column]:
    """Values that differ wherever two values of the column do. Arrays, maps and
    structs go by their JSON, which keeps elements and nulls apart."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false",
                                                   "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                                                   "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    elif isinstance(field.dataType, (T.StringType, T.BinaryType, T.IntegralType, T.BooleanType)):
        value = c
    else:
        value = c.cast("string")
    return [value, c.isNull()]


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two independent hashes (96 bits) of all columns, nulls told apart."""
    parts = [p for f in docs.schema.fields for p in _told(f)]
    return [F.xxhash64(*parts), F.hash(*parts)]


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with the rank (from 0) of its unique ``key``: positions in
    range partitions plus the partitions' offsets, so any number of sources
    is ranked without one task holding them all."""
    n = slots(sources.sparkSession)
    rows = stored(sources.repartitionByRange(n, key).sortWithinPartitions(key)
                  .withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))         # at most n rows
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_part").orderBy(key)
    return (rows.join(F.broadcast(starts), "_part")
            .withColumn("rank", F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_start"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``totals`` (key, source_size) with each source's target: shares by
    weight of all words, none above ``cap`` times the source's size, what is
    over shared again by weight among the rest until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    t = stored(ranked(totals, "key").withColumn("weight", weight), "weights")
    most = F.col("source_size") * float(cap)
    first = t.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    per = (first["size"] or 0) / (first["weight"] or 1)
    while True:
        above = F.col("weight") * F.lit(per) > most
        row = t.agg(F.sum(F.when(above, most).otherwise(0.0)).alias("held"),
                    F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (first["size"] - row["held"]) / row["open"]
        if new <= per * (1 + 1e-12):
            break
        per = new
    return t.withColumn("target", F.least(most, F.col("weight") * F.lit(float(per))))


def tilt(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """Lambda per source: Newton on the dual. ``cells`` has (key, size, n)."""
    inf = float("inf")
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")).otherwise(1.0)
    state = stored(goals.select(
        "key", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-inf).alias("lo"),
        F.lit(inf).alias("hi"),
        # all words of the source, cap times: no finite tilt gives that
        (F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-9)).alias("full"),
        F.lit(False).alias("done")), "dual")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (cells.join(state.where("not full and not done"), "key").groupBy("key").agg(
            F.sum(words * F.least(rate, F.lit(float(cap)))).alias("got"),
            F.sum(F.when(rate < cap, words * x * rate).otherwise(0.0)).alias("slope")))
        s = state.join(sums, "key", "left")
        over = F.col("got") - F.col("target")
        lo = F.when(over < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - over / F.col("slope"))
        halved = (F.when((lo > -inf) & (hi < inf), (lo + hi) / 2)
                  .when(lo > -inf, F.greatest(2 * lo, F.lit(0.0)) + 1).otherwise(F.least(2 * hi, F.lit(0.0)) - 1))
        done = F.col("done") | F.col("got").isNull() | (F.abs(over) <= TOLERANCE * F.col("target"))
        step = F.when((newton > lo) & (newton < hi), newton).otherwise(halved)
        state = stored(s.select(
            "key", "target", "mean", F.when(done, F.col("lam")).otherwise(step).alias("lam"),
            F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), "full", done.alias("done")), "dual")
        if state.where("not full and not done").isEmpty():
            break
    else:
        raise RuntimeError(f"a source's words are off its target by more than {TOLERANCE} after {MAX_STEPS} Newton steps")
    return state.select("key", "mean", "lam", "full")


def _round(cap: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, n, rate in zip(p["size"], p["n"], p["rate"]):
            if not size:
                copies.append(n)
                continue
            owed += n * rate * size
            k = min(max(int(owed / size + 0.5), 0), cap * n)
            owed -= k * size
            copies.append(k)
        return p.assign(copies=copies)[["key", "size", "n", "rate", "copies"]]

    return run


def plan(docs: DataFrame, source: str = "source", text: str = "text",
         weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``keep`` columns, _hash and _hash2 (of the whole
    row), size, source_size, target, rate and copies."""
    h, h2 = row_hashes(docs)
    rows = stored(docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("z")).alias("key"),
        n_words(F.col(f"`{text}`")).alias("size"), h.alias("_hash"),
        h2.alias("_hash2")), "sizes")
    cells = stored(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                      F.sum("n").alias("n_docs"))
    goals = stored(targets(totals, weights, cap), "targets")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = cells.join(tilt(cells, goals, cap), "key").select("key", "size", "n", rate.alias("rate"))
    # a source has at most sqrt(2 x its words) different sizes, so this group is small
    whole = rated.groupBy("key").applyInPandas(
        _round(cap), "key string, size long, n long, rate double, copies long")
    whole = stored(whole.join(goals.select("key", "source_size", "target"), "key"), "copies")
    base = (F.col("copies") / F.col("n")).cast("long")
    whole = whole.select("key", "size", "rate", "source_size", "target", base.alias("base"),
                         (F.col("copies") - base * F.col("n")).alias("extra"))
    # the rows of a size are ranked in hash blocks; block counts give the offsets
    rows = rows.withColumn("block", F.pmod("_hash", F.lit(4 * slots(docs.sparkSession))))
    before = Window.partitionBy("key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("key", "size", "block").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
              .join(whole, ["key", "size"]))
    inside = Window.partitionBy("key", "size", "block").orderBy("_hash", "_hash2")
    return (rows.join(starts.hint("shuffle_merge"), ["key", "size", "block"])
            .withColumn("_at", F.col("start") + F.row_number().over(inside))
            .withColumn("copies", F.col("base") + (F.col("_at") <= F.col("extra")).cast("long"))
            .select(*keep, "_hash", "_hash2", "size", "source_size", "target", "rate", "copies"))


def mix(docs: DataFrame, source: str = "source", text: str = "text",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    a, b, copies = fresh(docs, "hash"), fresh(docs, "hash2"), fresh(docs, "copies")
    # rows alike in every column are interchangeable: their copies are added up
    taken = (plan(docs, source, text, weights, cap).groupBy("_hash", "_hash2")
             .agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
             .select(F.col("_hash").alias(f"{a}_r"), F.col("_hash2").alias(f"{b}_r"), copies))
    h, h2 = row_hashes(docs)
    rows = docs.withColumn(a, h).withColumn(b, h2)
    once = rows.join(taken.hint("shuffle_merge"), (F.col(a) == F.col(f"{a}_r")) & (F.col(b) == F.col(f"{b}_r")))
    return (once.dropDuplicates([a, b]).withColumn(a, F.explode(F.sequence(F.lit(1), copies)))
            .drop(a, b, copies, f"{a}_r", f"{b}_r"))
