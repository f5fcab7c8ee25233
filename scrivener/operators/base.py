"""Plan helpers shared by operators: pinned shuffle joins, skew-safe ranking and
latest/first-per-key as partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trunc_time(df: DataFrame, unit: str, col: str) -> Column:
    """``date_trunc`` that keeps the column's type: Spark returns TIMESTAMP
    even for TIMESTAMP_NTZ input, which would turn naive wall times into
    zone-dependent instants downstream."""
    t = F.date_trunc(unit, F.col(col))
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        return t.cast("timestamp_ntz")
    return t


def shuffle_join(df: DataFrame) -> DataFrame:
    """Mark ``df`` for a shuffle (sort-merge) join. For sides whose size grows
    with the data but whose estimate does not (rows built by ``explode``, or
    aggregates over them): the planner's estimate could otherwise pick a
    broadcast that does not fit."""
    return df.hint("shuffle_merge")


def _order_struct(order_cols, payload_cols) -> Column:
    return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                    F.struct(*[F.col(c) for c in payload_cols]).alias("_row"))


def latest_per_key(df: DataFrame, keys, order_cols, payload=None) -> DataFrame:
    """Last write wins per key (G1): ``max`` of a struct ordered by ``order_cols``.

    This is an ordinary aggregate, so Spark combines it map-side before the
    shuffle; a hot key with a third of all rows reaches the reducer as one
    partial row per map task, never as a sorted group.
    """
    keys = list(keys)
    payload = [c for c in (payload or df.columns) if c not in keys]
    agg = df.groupBy(*keys).agg(F.max(_order_struct(order_cols, payload)).alias("_m"))
    return agg.select(*keys, "_m._row.*")


def first_per_key(df: DataFrame, keys, order_cols, payload=None) -> DataFrame:
    """First arrival per key (batch form of E8 dedupe)."""
    keys = list(keys)
    payload = [c for c in (payload or df.columns) if c not in keys]
    agg = df.groupBy(*keys).agg(F.min(_order_struct(order_cols, payload)).alias("_m"))
    return agg.select(*keys, "_m._row.*")


def rank_desc(df: DataFrame, keys, order_cols, bucket: Column, out: str = "rank") -> DataFrame:
    """Dense position (1 = newest) of every row within ``keys`` ordered by
    ``order_cols`` descending, without sorting a whole key group in one task.

    ``bucket`` must be monotone in the first order column (e.g. its month).
    Rows are numbered inside (key, bucket) and shifted by the row count of the
    newer buckets of the same key; those counts are a small (key, bucket)
    table, so a hot key is spread over its buckets.
    """
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_b").orderBy(*[F.desc(c) for c in order_cols])
    ranked = b.withColumn("_rn", F.row_number().over(local))
    return (ranked.join(offsets, [*keys, "_b"])
            .withColumn(out, F.col("_rn") + F.col("_off"))
            .drop("_b", "_rn", "_off"))


def row_number_asc(df: DataFrame, keys, order_cols, bucket: Column, out: str = "rn") -> DataFrame:
    """Ascending row number within ``keys`` (1 = oldest), computed in
    (key, bucket) slices plus the row counts of older buckets, like
    :func:`rank_desc`. ``bucket`` must be monotone in the order."""
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    older = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(older), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order_cols)
    ranked = b.withColumn("_rn", F.row_number().over(local))
    return (ranked.join(offsets, [*keys, "_b"])
            .withColumn(out, F.col("_rn") + F.col("_off"))
            .drop("_b", "_rn", "_off"))


def running_count(df: DataFrame, keys, order_cols, flag: str, bucket: Column,
                  out: str = "running") -> DataFrame:
    """Running count of rows where ``flag`` is true, per key in order
    (inclusive), computed like :func:`row_number_asc`: a local running sum in
    (key, bucket) slices plus the flag totals of older buckets."""
    keys = list(keys)
    b = df.withColumn("_b", bucket).withColumn("_f", F.col(flag).cast("int"))
    counts = b.groupBy(*keys, "_b").agg(F.sum("_f").alias("_n"))
    older = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(older), F.lit(0)).alias("_off"))
    local = (Window.partitionBy(*keys, "_b").orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = b.withColumn("_run", F.sum("_f").over(local))
    return (run.join(offsets, [*keys, "_b"])
            .withColumn(out, F.col("_run") + F.col("_off"))
            .drop("_b", "_f", "_run", "_off"))


def previous_value(df: DataFrame, keys, order_cols, value: str, bucket: Column,
                   out: str = "prev") -> DataFrame:
    """``lag(value)`` per series without one task per series.

    Inside a (series, bucket) slice the ordinary lag is used; the first row
    of a slice takes the last value of the series' previous non-empty
    bucket, found in a small (series, bucket) table."""
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    last = b.groupBy(*keys, "_b").agg(
        F.max(F.struct(*[F.col(c) for c in order_cols], F.col(value).alias("_v"))).alias("_last"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    carry = last.select(*keys, "_b", F.lag(F.col("_last._v")).over(by_bucket).alias("_carry"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order_cols)
    lagged = b.withColumn("_lag", F.lag(value).over(local)).withColumn(
        "_first", F.row_number().over(local) == 1)
    return (lagged.join(carry, [*keys, "_b"])
            .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_b", "_lag", "_first", "_carry"))


def last_before(df: DataFrame, keys, order_cols, value: str, bucket: Column,
                out: str = "last") -> DataFrame:
    """Last non-null ``value`` strictly before each row, per key in order
    (``last(value, ignorenulls) OVER (... ROWS UNBOUNDED PRECEDING TO 1
    PRECEDING)``), computed in (key, bucket) slices with the last non-null
    value of older buckets carried in from a small (key, bucket) table."""
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    order_struct = F.struct(*[F.col(c) for c in order_cols], F.col(value).alias("_v"))
    last = b.groupBy(*keys, "_b").agg(
        F.max(F.when(F.col(value).isNotNull(), order_struct)).alias("_last"))
    older = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_b", F.last(F.col("_last._v"), ignorenulls=True).over(older).alias("_carry"))
    local = (Window.partitionBy(*keys, "_b").orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, -1))
    within = b.withColumn("_in", F.last(value, ignorenulls=True).over(local))
    return (within.join(carry, [*keys, "_b"])
            .withColumn(out, F.coalesce("_in", "_carry"))
            .drop("_b", "_in", "_carry"))


def top_n_per_key(df: DataFrame, keys, order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """Top-n rows per key. ``row_number() <= n`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most n
    rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
