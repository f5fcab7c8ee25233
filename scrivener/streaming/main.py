"""Production entry point for the streaming stages.

    spark-submit --py-files scrivener.zip scrivener/streaming/main.py enrich  --bootstrap host:9092
    spark-submit --py-files scrivener.zip scrivener/streaming/main.py windows --bootstrap host:9092
    spark-submit --py-files scrivener.zip scrivener/streaming/main.py notify  --bootstrap host:9092 \
        --users /data/users --submissions /data/submissions --out /data/notifications

``--folder`` replaces ``--bootstrap`` with topic folders (no broker). Each
stage is one checkpointed query under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener import schemas
from scrivener.functions import messages as M
from scrivener.operators import events as E
from scrivener.operators import windows as W
from scrivener.operators.tables import rejected_rows, valid_rows
from scrivener.session import checkpoint_dir, get_session
from scrivener.streaming import jobs as J
from scrivener.streaming import merge_table as MT
from scrivener.streaming import recompute as RC
from scrivener.streaming import topics as TP

# Topic names of the stages.
RAW_UPLOADS = "paper_uploaded"
RAW_CHECKS = "plagiarism_checked"
UPLOADS = "paper_uploaded_processed"
CHECKS = "plagiarism_checked_processed"
WINDOWS = "analytics_window"


def _ck(spark: SparkSession, name: str, root: str | None = None) -> str:
    """Checkpoint of a stage: fixed per stage so a restart resumes."""
    return os.path.join(root or os.path.join(checkpoint_dir(spark), "stages"), name)


def enrich_stage(spark: SparkSession, bootstrap=None, folder=None, trigger=None, ck_root=None):
    """B1/B2 as streams: raw topics -> processed topics. Fields the schema does
    not know are passed on; records that are no JSON go to ``<topic>_malformed``."""
    kw = {"bootstrap": bootstrap, "folder": folder}
    J.use_rocksdb(spark)
    now = F.current_timestamp()
    queries = []
    for raw_topic, schema, enrich, topic in (
            (RAW_UPLOADS, schemas.SUBMISSION,
             lambda df, processed_at: E.enrich_submission(E.submission_defaults(df, processed_at), processed_at), UPLOADS),
            (RAW_CHECKS, schemas.CHECK_RESULT, E.enrich_check, CHECKS)):
        good, bad = TP.read_records(spark, [raw_topic], schema, **kw)
        out = enrich(good.drop("topic", "timestamp"), processed_at=now)
        queries.append(TP.write_topic(out, topic, _ck(spark, f"enrich_{raw_topic}", ck_root), trigger=trigger,
                                      raw="_raw", **kw))
        queries.append(TP.write_topic(bad, f"{raw_topic}_malformed", _ck(spark, f"malformed_{raw_topic}", ck_root),
                                      trigger=trigger, **kw))
    return queries


def decode_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, malformed records) of a batch of the processed topics. The time
    of an event is its upload time, for checks its processing time."""
    good, bad = E.decode(df, schemas.PROCESSED_EVENT)
    return good.withColumn("ts", F.coalesce("uploaded_at", "processed_at")), bad


def _quarantine(bad: DataFrame, path: str, batch_id: int) -> None:
    bad.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def windows_stage(spark: SparkSession, bootstrap=None, folder=None, trigger=None, out=None,
                  ck_root=None):
    """D1 as a stream: processed topics -> 5-minute windows. Every batch
    recomputes the windows it touches from all their events, repeats of an
    upload or of a submission's check within a window dropped, so late events
    count and no watermark cuts. The windows are in ``out`` (read them with
    ``recompute.read_recomputed``; by default beside the checkpoint) and, without
    ``out``, on the window topic too, where a later record of a window replaces
    an earlier one. Malformed records and events without a time are kept in
    ``<checkpoint>-malformed``."""
    J.use_rocksdb(spark)
    ck = _ck(spark, "windows", ck_root)
    window = F.window("ts", W.DEFAULT_WINDOW).getField("start")

    def publish(rows: DataFrame, batch_id: int) -> None:
        recs = TP.to_topic_records(rows.drop(RC.SCOPE))
        if bootstrap:
            (recs.write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
             .option("topic", WINDOWS).save())
        else:
            recs.write.mode("append").text(os.path.join(folder, WINDOWS))

    sink = RC.recompute_sink(
        f"{ck}-events", out or f"{ck}-windows", window, MT.hour(window),
        lambda ev: W.window_analytics(ev).withColumn(RC.SCOPE, F.col("window_start")),
        dedupe=RC.first_of(["id", "submission_id"], ["ts", "processed_at"], within=[RC.SCOPE, "topic"]),
        then=None if out else publish)

    def each(df: DataFrame, batch_id: int) -> None:
        good, bad = decode_events(df)
        timeless = good.where(F.col("ts").isNull()).withColumn("error", F.lit("no time")).select(bad.columns)
        _quarantine(bad.unionByName(timeless), f"{ck}-malformed", batch_id)
        sink(good.where(F.col("ts").isNotNull()).drop("_raw"), batch_id)

    return (TP.read_topics(spark, [UPLOADS, CHECKS], bootstrap=bootstrap, folder=folder).writeStream
            .queryName("windows").option("checkpointLocation", ck).trigger(**(trigger or J.TRIGGER))
            .foreachBatch(each).start())


def _fresh(table) -> DataFrame:
    """A table as it is now: a function of nothing (called for each batch) or a
    DataFrame that does not change."""
    return table() if callable(table) else table


def notify_stage(spark: SparkSession, users, submissions, out: str,
                 bootstrap=None, folder=None, trigger=None, ck_root=None):
    """B12/B13/C4 as a stream: processed events -> notifications (append).

    ``users`` and ``submissions`` are functions that read the tables; they are
    called for each batch, so rows stored meanwhile are seen. A check whose
    submission is not stored yet waits (``<checkpoint>-waiting``) and is tried
    again with each batch; events of unknown users and malformed records go to
    ``<checkpoint>-rejected`` with their reason."""
    J.use_rocksdb(spark)
    ck = _ck(spark, "notify", ck_root)
    waiting, rejected = f"{ck}-waiting", f"{ck}-rejected"
    columns = ["submission_id", "internal_score", "external_score", "ai_generated_probability", "severity",
               "requires_review", "ts"]

    def each(df: DataFrame, batch_id: int) -> None:
        known = _fresh(users)
        owners = _fresh(submissions).select(F.col("id").alias("submission_id"), F.col("user_id").alias("_owner"))
        good, bad = decode_events(df)
        checks = good.where(F.col("topic") == CHECKS).select(*columns)
        if batch_id > 0:
            checks = checks.unionByName(
                spark.read.schema(checks.schema).parquet(os.path.join(waiting, f"batch_id={batch_id - 1}")))
        found = checks.join(owners, "submission_id", "left")
        (found.where(F.col("_owner").isNull()).select(*columns)
         .write.mode("overwrite").parquet(os.path.join(waiting, f"batch_id={batch_id}")))
        ups = good.where(F.col("topic") == UPLOADS).select(
            M.hash_id(F.lit("upload"), "id").alias("id"), "user_id",
            M.upload_message("id", "text_length").alias("message"), F.col("ts").alias("created_at"))
        # made of the check itself, not of when it was processed: a replay gives the same id
        chk = found.where(F.col("_owner").isNotNull()).select(
            M.hash_id(F.lit("check"), *columns[:5]).alias("id"), F.col("_owner").alias("user_id"),
            M.check_message("submission_id", "internal_score", "severity", "requires_review").alias("message"),
            F.col("ts").alias("created_at"))
        notes = ups.unionByName(chk)
        valid_rows(notes, known).write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
        unknown = rejected_rows(notes, known).select(
            F.to_json(F.struct("*")).alias("_raw"),
            F.format_string(E.USER_NOT_FOUND, F.col("user_id").cast("string")).alias("error"))
        _quarantine(unknown.unionByName(bad.select("_raw", "error")), rejected, batch_id)

    return (TP.read_topics(spark, [UPLOADS, CHECKS], bootstrap=bootstrap, folder=folder).writeStream
            .queryName("notify").option("checkpointLocation", ck).trigger(**(trigger or J.TRIGGER))
            .foreachBatch(each).start())


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="scrivener.streaming.main")
    p.add_argument("stage", choices=["enrich", "windows", "notify"])
    p.add_argument("--bootstrap")
    p.add_argument("--folder")
    p.add_argument("--out")
    p.add_argument("--users")
    p.add_argument("--submissions")
    p.add_argument("--checkpoint-root", help="stage checkpoints (default: spark.checkpoint.dir/stages)")
    p.add_argument("--once", action="store_true", help="process what is there, then stop")
    a = p.parse_args(argv)
    spark = get_session(app=f"scrivener-{a.stage}")
    trigger = {"availableNow": True} if a.once else None
    if a.stage == "enrich":
        qs = enrich_stage(spark, a.bootstrap, a.folder, trigger, a.checkpoint_root)
    elif a.stage == "windows":
        qs = [windows_stage(spark, a.bootstrap, a.folder, trigger, a.out, a.checkpoint_root)]
    else:
        qs = [notify_stage(spark, lambda: spark.read.parquet(a.users),
                           lambda: spark.read.parquet(a.submissions), a.out, a.bootstrap, a.folder, trigger, a.checkpoint_root)]
    for q in qs:
        q.awaitTermination()


if __name__ == "__main__":
    main()
