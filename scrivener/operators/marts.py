"""Dashboard marts: user fallback (C5), student mart (C6, D6), faculty
mart (C7, D5), group-all result statistics (D3), display formatting (B21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions import messages as M
from scrivener.functions.numeric import round_half_away
from scrivener.operators.base import top_n_per_key

# Fixed values of the faculty view: newest submissions shown, flagged estimate
# applies above this average.
FACULTY_RECENT = 10
FLAG_AVG_THRESHOLD = 0.5
SPIKE_THRESHOLD = 10


def user_fallback(requests: DataFrame, users: DataFrame, id_col: str = "user_id",
                  role_col: str = "role") -> DataFrame:
    """Requested users; unknown ids get a stand-in "Demo {Role}" user."""
    u = users.select(F.col("id").alias(id_col), F.col("name").alias("_n"),
                     F.col("email").alias("_e"), F.col("role").alias("_r"))
    j = requests.join(u, id_col, "left")
    return j.select(
        F.col(id_col).alias("id"),
        F.coalesce("_n", F.concat(F.lit("Demo "), F.initcap(role_col))).alias("name"),
        F.coalesce("_e", F.concat(F.col(id_col).cast("string"), F.lit("@example.com"))).alias("email"),
        F.coalesce("_r", F.col(role_col)).alias("role"),
    )


def student_dashboard(users: DataFrame, submissions: DataFrame, notifications: DataFrame,
                      latest_window: DataFrame, n_messages: int = 5) -> DataFrame:
    """One row per student: submission count, has-notifications, the
    newest messages (at most ``n_messages``) and the latest window's averages.

    Counts are partial aggregates; the message list is a top-n per user
    (bounded); the latest window is one row, attached as a scalar subquery.
    """
    students = users.where(F.col("role") == "student").select(
        F.col("id").alias("user_id"), "name")
    counts = submissions.groupBy("user_id").agg(F.count(F.lit(1)).alias("submissions_count"))
    recent = (top_n_per_key(notifications, ["user_id"], [F.desc("created_at"), F.desc("id")],
                            n_messages, out="_rank")
              .groupBy("user_id")
              .agg(F.sort_array(F.collect_list(F.struct("_rank", "message"))).alias("_m")))
    # The latest window is one row: a scalar subquery, evaluated once.
    lw = latest_window.limit(1).select(F.struct(
        F.col("window_start").alias("latest_window_start"), "avg_internal_score",
        "avg_external_score", "avg_ai_probability")).scalar()
    out = (students.join(counts, "user_id", "left").join(recent, "user_id", "left")
           .withColumn("_lw", lw).select("*", "_lw.*"))
    return out.select(
        "user_id", "name",
        F.coalesce("submissions_count", F.lit(0)).alias("submissions_count"),
        F.col("_m").isNotNull().alias("has_notifications"),
        F.transform(F.coalesce("_m", F.array()), lambda x: x["message"]).alias("recent_messages"),
        "latest_window_start", "avg_internal_score", "avg_external_score", "avg_ai_probability",
    )


def student_submissions(users: DataFrame, submissions: DataFrame) -> DataFrame:
    """The submissions of all students, however many users there are
    (the reference looks at the first ten only to save calls; a join need not)."""
    students = users.where(F.col("role") == "student").select(F.col("id").alias("user_id"))
    return submissions.join(students, "user_id", "left_semi")


def faculty_recent(users: DataFrame, submissions: DataFrame, n: int = FACULTY_RECENT) -> DataFrame:
    """the ``n`` newest submissions of students (ties by id), as the list
    that is shown."""
    return student_submissions(users, submissions).orderBy(F.desc("uploaded_at"), F.desc("id")).limit(n)


def faculty_summary(submissions: DataFrame, latest_window: DataFrame) -> DataFrame:
    """Number of student submissions, flagged estimate and spike flag.

    avg_plagiarism := latest avg_internal_score; spike := submission_count > 10.
    """
    total = submissions.agg(F.count(F.lit(1)).alias("total_submissions"))
    lw = latest_window.limit(1).select(F.struct(
        F.col("avg_internal_score").alias("avg_plagiarism"), "submission_count")).scalar()
    j = total.withColumn("_lw", lw).select("*", "_lw.*")
    avg = F.col("avg_plagiarism")
    return j.select(
        "total_submissions",
        F.when(avg > FLAG_AVG_THRESHOLD, (F.col("total_submissions") * avg).cast("bigint"))
         .otherwise(F.lit(0).cast("bigint")).alias("flagged_count"),
        F.coalesce(F.col("submission_count") > SPIKE_THRESHOLD, F.lit(False)).alias("spike_detected"),
        F.coalesce(avg, F.lit(0.0)).alias("avg_plagiarism"),
    )


def result_stats(results: DataFrame) -> DataFrame:
    """D3: group-all averages and count; zeros when there are no results."""
    return results.agg(
        F.coalesce(F.avg("internal_score"), F.lit(0.0)).alias("avg_internal_score"),
        F.coalesce(F.avg("external_score"), F.lit(0.0)).alias("avg_external_score"),
        F.coalesce(F.avg("ai_generated_probability"), F.lit(0.0)).alias("avg_ai_probability"),
        F.count(F.lit(1)).alias("total_results"),
    )


def display_rows(results: DataFrame, submissions: DataFrame) -> DataFrame:
    """Dashboard formatting of results joined to their submission."""
    s = submissions.select(F.col("id").alias("submission_id"), "uploaded_at")
    j = results.join(s, "submission_id")
    return j.select(
        "submission_id",
        M.short_id(M.hash_id("submission_id")).alias("short_id"),
        M.minute_stamp("uploaded_at").alias("uploaded"),
        M.percent("internal_score").alias("internal_pct"),
        M.percent("ai_generated_probability").alias("ai_pct"),
    )


def display_windows(windows: DataFrame) -> DataFrame:
    """Window rows as the faculty view shows them: start time to the
    minute, upload rate per minute with 2 decimals, average score as a
    percentage (rate = uploads / 60 over a 5-minute window, as shown there)."""
    return windows.select(
        "window_start",
        M.minute_stamp("window_start").alias("window"),
        M.fixed(F.col("submission_count") / 60.0, 2).alias("rate"),
        # Formatted from the average rounded to 6 digits, so float noise of
        # the summation order cannot flip a displayed digit.
        M.percent(round_half_away("avg_internal_score", 6)).alias("avg_plagiarism_pct"),
        (F.col("submission_count") > SPIKE_THRESHOLD).alias("spike_detected"),
    )
