"""Streaming aggregates without lost rows.

A watermark drops what comes later than it. Here nothing is dropped: what a
batch adds is merged into a ``MergeTable``, so late events repair their window,
open windows are in the result, and the end state equals the batch result
whatever the order of arrival.

* ``windows_table`` / ``accumulate_sink``: counts and sums per window. A batch
  adds the accumulators of its own events and reads nothing else.
* ``sessions_table``: sessions as (first, last, counts, sums). A batch adds the
  sessions of its own events; those that meet are joined when read or compacted.
* ``recompute_sink``: for aggregates that do not add up (first event per key).
  Events are kept, and the scopes a batch touched (a window) are aggregated anew
  from the partitions they are in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import windows as W
from scrivener.operators.base import first_per_key
from scrivener.streaming.merge_table import SEQ, Merge, MergeTable, bucket, day, stored

SCOPE = "_scope"


def accumulate_sink(table: Callable[[SparkSession], MergeTable], partials: Callable[[DataFrame], DataFrame]):
    """``foreachBatch`` function: the accumulators of a batch go to ``table``."""
    def sink(df: DataFrame, batch_id: int) -> None:
        table(df.sparkSession).apply(partials(df), batch_id)
    return sink


# ------------------------------------------------------------------- windows

def window_rows(events: DataFrame, size: str = W.DEFAULT_WINDOW, time_col: str = "ts") -> DataFrame:
    """Accumulators of the windows of some events."""
    return (events.groupBy(F.window(time_col, size).alias("w")).agg(*W.window_partials())
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *W.PARTIALS))


def _add_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_start", "window_end").agg(*W.add_partials())


def windows_table(spark: SparkSession, root: str) -> MergeTable:
    return MergeTable(spark, root, day(F.col("window_start")), _add_windows)


def read_windows(spark: SparkSession, root: str) -> DataFrame:
    """D1 of all events that were accumulated."""
    return stored(spark, root, _add_windows).select("window_start", "window_end", *W.finish_partials())


# ------------------------------------------------------------------ sessions

def _join_sessions(keys: tuple[str, ...], gap: int) -> Merge:
    return lambda rows: W.merge_sessions(rows, keys, gap)


def sessions_table(spark: SparkSession, root: str, keys: tuple[str, ...], gap_seconds: int = 1800) -> MergeTable:
    return MergeTable(spark, root, bucket(list(keys)), _join_sessions(keys, gap_seconds))


def read_sessions(spark: SparkSession, root: str, keys: tuple[str, ...], gap_seconds: int = 1800) -> DataFrame:
    """E10 of all events that were accumulated."""
    rows = stored(spark, root, _join_sessions(keys, gap_seconds))
    return rows.select(*keys, F.col("first").alias("window_start"),
                       (F.col("last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("window_end"),
                       *W.finish_partials())


# --------------------------------------------------- scopes aggregated anew

def _newest_scopes(rows: DataFrame) -> DataFrame:
    """Per scope, the rows of the last batch that touched it."""
    last = rows.groupBy(F.col(SCOPE).alias("_s")).agg(F.max(SEQ).alias("_q"))
    return rows.join(last, F.col(SCOPE).eqNullSafe(F.col("_s")) & (F.col(SEQ) == F.col("_q")), "left_semi")


def recompute_sink(store: str, out: str, scope: Column, part: Column,
                   aggregate: Callable[[DataFrame], DataFrame],
                   dedupe: Merge | None = None,
                   then: Callable[[DataFrame, int], None] | None = None):
    """``foreachBatch`` function. ``scope`` is what is aggregated together and
    ``part`` a coarser value of it (an hour, a bucket) by which the tables are
    partitioned, so a batch reads only the parts it touched. ``aggregate`` gets
    the events of the touched scopes (column _scope) and must keep _scope;
    ``dedupe`` says which events are kept; ``then`` gets what was written."""
    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df.withColumn(SCOPE, scope).withColumn("_in", part.cast("string"))
        events = MergeTable(spark, store, F.col("_in"), dedupe or (lambda r: r))
        parts = events.apply(rows, batch_id)
        if not parts:
            return
        touched = rows.select(F.col(SCOPE).alias("_t"), F.col("_in").alias("_p")).distinct()
        mine = events.read(parts).join(touched, F.col(SCOPE).eqNullSafe(F.col("_t")), "left_semi")
        place = touched.groupBy("_t").agg(F.min("_p").alias("_in"))
        made = aggregate(mine.drop("_in")).withColumn(SEQ, F.lit(batch_id).cast("long"))
        made = made.join(place, F.col(SCOPE).eqNullSafe(F.col("_t")), "left").drop("_t")
        results = MergeTable(spark, out, F.col("_in"), _newest_scopes)
        results.apply(made, batch_id)
        if then:
            new = results.rows(parts).where(F.col(SEQ) == batch_id).drop(SEQ, "_in")
            then(new, batch_id)
    return sink


def read_recomputed(spark: SparkSession, out: str) -> DataFrame:
    """The current result: per scope, the rows of the last batch that touched it."""
    return stored(spark, out, _newest_scopes).drop(SCOPE, SEQ, "_in")


def first_of(keys: list[str], order: list[str], within: list[str] | None = None) -> Merge:
    """A ``dedupe`` that keeps the first event per ``keys`` in ``order``, in
    each group of equal ``within`` on its own; events without any key are all kept."""
    def run(events: DataFrame) -> DataFrame:
        known = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
        first = first_per_key(events.where(known), [*(within or []), *keys], order)
        return first.select(events.columns).unionByName(events.where(~known))
    return run
