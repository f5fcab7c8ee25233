"""Topic sources and sinks (A1, A2, A5) for Structured Streaming.

A topic is a Kafka topic in production; offline (tests, no broker) it is a
folder of JSON-lines files per topic with the same record shape
``(topic, value, timestamp)``. Either way the rest of the plan is the same.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.operators.events import JSON_OPTIONS, decode

FILE_TOPIC_SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def kafka_source_options(bootstrap: str, topics: list[str], starting: str = "earliest",
                         max_offsets_per_trigger: int | None = None,
                         fail_on_data_loss: bool = True) -> dict[str, str]:
    """A1: subscribe to topics from the earliest offset (value-only JSON). Lost
    offsets stop the query unless the caller asks to go on without them."""
    opts = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


def read_topics(spark: SparkSession, topics: list[str], bootstrap: str | None = None,
                folder: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A1/A5: a stream of ``(topic, value STRING, timestamp)`` over one or
    more topics. Kafka when ``bootstrap`` is given, else topic folders under
    ``folder`` (one sub-folder per topic)."""
    if bootstrap:
        raw = (spark.readStream.format("kafka")
               .options(**kafka_source_options(bootstrap, topics)).load())
        return raw.select("topic", F.col("value").cast("string").alias("value"), "timestamp")
    out = None
    for t in topics:
        r = spark.readStream.schema(FILE_TOPIC_SCHEMA).format("text")
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        s = r.load(os.path.join(folder, t)).select(
            F.lit(t).alias("topic"), "value", F.current_timestamp().alias("timestamp"))
        out = s if out is None else out.unionByName(s)
    return out


def read_records(spark: SparkSession, topics: list[str], schema: T.StructType, **kw):
    """A1+A3: topic stream decoded to typed records; returns (good, bad)."""
    return decode(read_topics(spark, topics, **kw), schema, col="value")


def to_topic_records(df: DataFrame, cols: list[str] | None = None, raw: str | None = None) -> DataFrame:
    """A2/A4: rows as JSON ``value`` (nulls kept), no message key. With ``raw``
    (the record as it came in), its fields that the row does not have are
    passed on as they are."""
    cols = cols or [c for c in df.columns if c != raw]
    own = F.to_json(F.struct(*cols), {"ignoreNullFields": "false", **JSON_OPTIONS})
    if raw is None:
        return df.select(own.alias("value"))
    more = F.map_filter(F.from_json(F.col(raw), "map<string, variant>"), lambda k, v: ~k.isin(cols))
    merged = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","),
                      F.substring(F.to_json(more), F.lit(2), F.length(F.to_json(more))))
    return df.select(F.when(F.size(more) > 0, merged).otherwise(own).alias("value"))


def write_topic(df: DataFrame, topic: str, checkpoint: str, bootstrap: str | None = None,
                folder: str | None = None, trigger: dict | None = None, raw: str | None = None):
    """A2: start a query writing ``df`` to a topic (Kafka or a topic folder).

    Kafka delivery is at-least-once: a replay can repeat a record, so readers
    drop repeats by the record's own key (E8). The file sink is exactly-once.
    """
    recs = to_topic_records(df, raw=raw)
    w = recs.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "60 seconds"}))
    if bootstrap:
        return (w.format("kafka").option("kafka.bootstrap.servers", bootstrap)
                .option("topic", topic).start())
    return w.format("text").outputMode("append").start(os.path.join(folder, topic))
