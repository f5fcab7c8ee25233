"""Domain views over the driver tables, Spark side.

Each view is a lazy DataFrame; Catalyst prunes the columns a query does not
use and pushes filters into the parquet scan. ``scrivener.plans.sql_views``
holds the same definitions in DuckDB SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import scoring
from scrivener.sources.tables import read_table


def users(spark: SparkSession, d: str, max_nation: int = 20) -> DataFrame:
    """customer rows with nation < 20 are the registered users."""
    c = read_table(spark, d, "customer")
    return c.where(F.col("c_nationkey") < max_nation).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_nationkey") < 5, F.lit("faculty")).otherwise(F.lit("student")).alias("role"),
    )


def submissions(spark: SparkSession, d: str, with_text: bool = False) -> DataFrame:
    """orders as submissions; text from documents (same key) when asked for."""
    o = submissions_from(read_table(spark, d, "orders"))
    if not with_text:
        return o
    docs = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text"))
    return o.join(docs, "id", "left")


def submissions_from(o: DataFrame) -> DataFrame:
    """The submissions view over an orders DataFrame (batch or stream)."""
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("assignment_id"),
        F.col("o_orderdate").alias("uploaded_at"),
    )


def submissions_with_length(spark: SparkSession, d: str) -> DataFrame:
    """Submissions with text_length (NULL without a text): the length is taken
    in the scan of the texts, so no text is shuffled for it."""
    lengths = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.length("text").alias("text_length"))
    return submissions(spark, d).join(lengths, "id", "left")


def checks(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as check results: several rows per submission."""
    return checks_from(read_table(spark, d, "lineitem"))


def checks_from(li: DataFrame) -> DataFrame:
    """The checks view over a lineitem DataFrame (batch or stream)."""
    return li.select(
        F.col("l_orderkey").alias("submission_id"),
        (F.col("l_discount") * 10).alias("internal_score"),
        (F.col("l_tax") * 12.5).alias("external_score"),
        (F.col("l_quantity") / 50).alias("ai_generated_probability"),
        F.col("l_shipdate").alias("checked_at"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    )


# Columns that order checks of one submission (last write wins, G1).
CHECK_ORDER = ("checked_at", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """events as the processed-event stream: signup = upload, purchase = check."""
    return event_stream_from(read_table(spark, d, "events"))


def event_stream_from(e: DataFrame) -> DataFrame:
    """The event-stream view over an events DataFrame (batch or stream)."""
    up = F.col("event_type") == "signup"
    chk = F.col("event_type") == "purchase"
    internal = F.when(chk, F.least(F.col("value") / 100, F.lit(1.0)))
    k = F.from_json("props", "k BIGINT").getField("k")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(up, F.lit("paper_uploaded")).when(chk, F.lit("plagiarism_checked"))
         .otherwise(F.col("event_type")).alias("event_type"),
        internal.alias("internal_score"),
        F.when(chk, k / 100).alias("external_score"),
        F.when(chk, (F.col("event_id") % 100) / 100).alias("ai_generated_probability"),
        scoring.severity(internal).alias("severity"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """conversations as pages of a document: conv = document, turn = page."""
    c = read_table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def _job_index():
    return F.col("user_id") % 5


def requests(spark: SparkSession, d: str) -> DataFrame:
    """events as a request log of five services."""
    return requests_from(read_table(spark, d, "events"))


def requests_from(e: DataFrame) -> DataFrame:
    """The request-log view over an events DataFrame (batch or stream)."""
    job = F.concat(F.lit("svc"), _job_index().cast("string"), F.lit("-service"))
    return e.select(
        "event_id", "ts",
        job.alias("job"),
        F.concat(job, F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("pod"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        (F.col("value") / 100).alias("latency_s"),
        "value",
    )


def user_changes(spark: SparkSession, d: str) -> DataFrame:
    """orders as a change log of users: op by key % 10, seq a sortable string."""
    o = read_table(spark, d, "orders")
    m = F.col("o_orderkey") % 10
    return o.select(
        F.col("o_custkey").alias("id"),
        F.when(m == 0, F.lit("delete")).when(m <= 3, F.lit("insert"))
         .otherwise(F.lit("update")).alias("op"),
        F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"),
                 F.lpad(F.col("o_orderkey").cast("string"), 20, "0")).alias("seq"),
        F.concat(F.lit("User "), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("-"),
                 F.col("o_orderkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("faculty"))
         .otherwise(F.lit("student")).alias("role"),
    )


def base_users(spark: SparkSession, d: str) -> DataFrame:
    """Base table for the change-log test: users of nations below 10."""
    return users(spark, d, max_nation=10)


# --- metric samples and alerts (H rows) -------------------------------------

MIB = 1048576


def counter_samples(spark: SparkSession, d: str) -> DataFrame:
    """Request counter per job: the r-th request of a job (by ts, event_id)
    has counter value r % 100, so the series resets every 100 requests."""
    from scrivener.operators.base import row_number_asc
    r = requests(spark, d).select("event_id", "ts", "job")
    rn = row_number_asc(r, ["job"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return rn.select("job", "ts", "event_id", F.lit("http_requests_total").alias("metric"),
                     (F.col("rn") % 100).cast("double").alias("value"))


def pod_memory(spark: SparkSession, d: str) -> DataFrame:
    """Hourly memory gauge per pod: max request value in MiB, as bytes."""
    from scrivener.operators.base import trunc_time
    r = requests(spark, d)
    return r.groupBy("job", "pod", trunc_time(r, "hour", "ts").alias("ts")).agg(
        (F.max("value") * MIB).alias("value")).withColumn(
        "metric", F.lit("memory_working_set_bytes"))


def job_memory(spark: SparkSession, d: str) -> DataFrame:
    """Hourly memory usage and limit per job (usage / limit feed C11, H8)."""
    from scrivener.operators.base import trunc_time
    e = read_table(spark, d, "events")
    job = F.concat(F.lit("svc"), _job_index().cast("string"), F.lit("-service"))
    return e.groupBy(job.alias("job"), trunc_time(e, "hour", "ts").alias("ts")).agg(
        (F.max("value") * MIB).alias("usage"),
        ((F.lit(300) + F.lit(50) * F.max(_job_index())) * MIB).cast("double").alias("limit"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts per (pod, hour) from the hourly average request value."""
    from scrivener.functions.messages import fixed
    from scrivener.operators.base import trunc_time
    r = requests(spark, d)
    a = r.groupBy("job", "pod", trunc_time(r, "hour", "ts").alias("ts")).agg(F.avg("value").alias("v"))
    sev = (F.when(F.col("v") > 70, F.lit("critical")).when(F.col("v") > 50, F.lit("warning"))
           .when(F.col("v") > 30, F.lit("info")))
    return a.where(sev.isNotNull()).select(
        "ts", F.lit("HighValue").alias("alertname"), sev.alias("severity"),
        F.lit("primary").alias("cluster"), F.col("job").alias("service"),
        F.col("job").alias("instance"), "pod", F.lit(None).cast("string").alias("dev"),
        F.lit(None).cast("string").alias("namespace"),
        F.when(F.col("job") == "svc0-service", F.lit("prometheus"))
         .when(F.col("job") == "svc1-service", F.lit("loki")).alias("component"),
        F.concat(F.col("pod"), F.lit(" avg "), fixed("v", 2)).alias("description"),
    )
