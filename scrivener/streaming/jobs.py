"""Streaming jobs (E1-E9, A10, A11, C4 streaming form).

Every job reuses the batch operators: a stage is ``DataFrame -> DataFrame``
and only the source, watermark, trigger and sink differ. Checkpoints go to
the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.operators import windows as W
from scrivener.operators.base import first_per_key, latest_per_key
from scrivener.session import checkpoint_dir
from scrivener.streaming import merge_table as MT

# Watermark (bounded out-of-orderness) and checkpoint trigger
# of the reference stream job.
WATERMARK = "5 seconds"
TRIGGER = {"processingTime": "60 seconds"}
# Large window / dedupe / join state lives in RocksDB, not on the JVM heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A stream-stream join keeps each row in its state under three keys on either side.
# One store with four column families per partition, not four stores, and no reading
# of a key before each write (which only serves the count of rows in the progress).
# The state is on disk twice, in the store and in the checkpoint: its rows, half of
# them zeros, are packed well, and files of older batches are kept for a restart from
# the last two batches, not the last hundred.
JOIN_STATE = {"spark.sql.streaming.join.stateFormatVersion": "3",
              "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
              "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
              "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "16",
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
              "spark.sql.streaming.minBatchesToRetain": "2"}
# The shuffle files of a step are removed when it ends, so the disk holds those of one
# step at a time. For steps that store their results.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def use_rocksdb(spark: SparkSession) -> None:
    """Pick the RocksDB state store unless the session already chose one."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, STATE_STORE)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` for queries that start inside; what the session had comes back."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def join_state(spark: SparkSession) -> dict[str, str]:
    """``JOIN_STATE`` where joins are kept in RocksDB, else nothing."""
    use_rocksdb(spark)
    rocks = spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(".RocksDBStateStoreProvider")
    return JOIN_STATE if rocks else {}


def release_shuffles(batch: DataFrame) -> list[int]:
    """Removes the shuffle files that the rows of a stateful query's ``batch`` came
    through, once these are written; returns the shuffles. Spark would keep those of
    all batches till the driver forgets the query. Read again, a batch is shuffled again."""
    sc = batch.sparkSession.sparkContext
    leaves = batch._jdf.queryExecution().logical().collectLeaves()
    todo = [x.rdd() for x in (leaves.apply(k) for k in range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRDD"]
    seen, gone = set(), []
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        deps = rdd.dependencies()
        for dep in (deps.apply(k) for k in range(deps.size())):
            todo.append(dep.rdd())
            if dep.getClass().getSimpleName() == "ShuffleDependency":
                gone.append(dep.shuffleId())
    for shuffle in gone:
        sc._jsc.sc().shuffleDriverComponents().removeShuffle(shuffle, True)
    return gone


def drop_checkpoint(spark: SparkSession, name: str) -> None:
    """Deletes the checkpoint of a query that has ended and is never started again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_for(spark, name))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", name)


def run_stage(source: DataFrame, transform: Callable[[DataFrame], DataFrame], sink,
              name: str, trigger: dict | None = None, output_mode: str = "append"):
    """Consume -> transform -> produce as one checkpointed query.

    ``sink`` is a format name ("parquet", "memory", ...) plus path in a
    tuple, or a ``foreachBatch`` function ``(df, batch_id) -> None``."""
    spark = source.sparkSession
    use_rocksdb(spark)
    out = transform(source)
    w = (out.writeStream.queryName(name).outputMode(output_mode)
         .option("checkpointLocation", checkpoint_for(spark, name))
         .trigger(**(trigger or TRIGGER)))
    if callable(sink):
        return w.foreachBatch(sink).start()
    fmt, path = sink
    if fmt == "memory":
        return w.format("memory").start()
    return w.format(fmt).start(path)


def window_analytics_stream(events: DataFrame, size: str = W.DEFAULT_WINDOW,
                            watermark: str = WATERMARK, time_col: str = "ts",
                            slide: str | None = None, kind: str = "tumbling",
                            gap: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """D1 as a stream (tumbling, sliding, or per-key session
    windows). Append mode emits each window once, when the watermark passes
    its end; rows later than the watermark are dropped and counted (E4:
    ``numRowsDroppedByWatermark``)."""
    ev = event_time(events, time_col).withWatermark(time_col, watermark)
    return W.window_analytics(ev, time_col=time_col, size=size, slide=slide, kind=kind,
                              gap=gap, keys=keys)


def late_rows(query) -> int:
    """Rows dropped by the watermark so far (from the query progress)."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p["stateOperators"]:
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total


def dedupe_stream(events: DataFrame, keys: list[str], time_col: str = "ts",
                  watermark: str = "10 minutes") -> DataFrame:
    """Drop repeated events with the same key arriving within the
    watermark (state is bounded by the watermark)."""
    ev = event_time(events, time_col).withWatermark(time_col, watermark)
    return ev.dropDuplicatesWithinWatermark(keys)


def _last(keys: list[str], order_cols: list[str]):
    return lambda rows: latest_per_key(rows, keys, [MT.SEQ, *order_cols]).select(rows.columns)


def _first(keys: list[str], order_cols: list[str]):
    return lambda rows: first_per_key(rows, keys, order_cols).select(rows.columns)


def upsert_batch(path: str, keys: list[str], order_cols: list[str]):
    """``foreachBatch`` sink keeping the newest row per key in a
    ``MergeTable``: last write wins by batch, then order."""
    def sink(df: DataFrame, batch_id: int) -> None:
        table = MT.MergeTable(df.sparkSession, path, MT.bucket(keys), _last(keys, order_cols))
        table.apply(df.withColumn(MT.SEQ, F.lit(batch_id).cast("long")), batch_id)
    return sink


def read_upserted(spark: SparkSession, path: str, keys: list[str], order_cols: list[str]) -> DataFrame:
    """Current table of an upsert sink."""
    return MT.stored(spark, path, _last(keys, order_cols)).drop(MT.SEQ)


def first_batch(path: str, keys: list[str], order_cols: list[str]):
    """``foreachBatch`` sink keeping the first row per key of all batches."""
    def sink(df: DataFrame, batch_id: int) -> None:
        MT.MergeTable(df.sparkSession, path, MT.bucket(keys), _first(keys, order_cols)).apply(df, batch_id)
    return sink


def read_first(spark: SparkSession, path: str, keys: list[str], order_cols: list[str]) -> DataFrame:
    """First row per key of a :func:`first_batch` sink."""
    return MT.stored(spark, path, _first(keys, order_cols))
