"""Registered mart queries: C5, C6/D6, C7/F4/F8, D3, D5, B21."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.operators import base as B
from scrivener.operators import marts as MT
from scrivener.operators import windows as W
from scrivener.plans import views as V
from scrivener.plans.q_notify import NOTIFICATIONS_CTE, newest
from scrivener.plans.q_windows import WINDOWS_CTE, WINDOWS_RAW_CTE, windows
from scrivener.plans.registry import query
from scrivener.plans.sql_views import with_views
from scrivener.sources.tables import read_table

STUDENT_SUBMISSIONS_SQL = """
SELECT s.* FROM submissions s WHERE s.user_id IN (SELECT id FROM users WHERE role = 'student')"""
FACULTY_RECENT_SQL = STUDENT_SUBMISSIONS_SQL + """
ORDER BY s.uploaded_at DESC, s.id DESC LIMIT 10"""


@query("user_fallback", with_views("""
SELECT r.user_id AS id, coalesce(u.name, 'Demo Student') AS name,
       coalesce(u.email, CAST(r.user_id AS VARCHAR) || '@example.com') AS email,
       coalesce(u.role, 'student') AS role
FROM (SELECT DISTINCT user_id FROM events) r LEFT JOIN users u ON u.id = r.user_id""", "users"))
def user_fallback(spark, d):
    """Users requested by the event stream; unknown ids get a stand-in."""
    req = read_table(spark, d, "events").select("user_id").distinct().withColumn("role", F.lit("student"))
    return MT.user_fallback(req, V.users(spark, d))


@query("student_dashboard", with_views("""
SELECT u.id AS user_id, u.name, coalesce(cnt.n, 0) AS submissions_count,
       rec.user_id IS NOT NULL AS has_notifications, coalesce(rec.msgs, '') AS recent_messages,
       lw.window_start AS latest_window_start, lw.avg_internal_score, lw.avg_external_score,
       lw.avg_ai_probability
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n FROM submissions GROUP BY user_id) cnt ON cnt.user_id = u.id
LEFT JOIN (SELECT user_id, string_agg(message, chr(10) ORDER BY rk) AS msgs FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rk
             FROM notifications) WHERE rk <= 5 GROUP BY user_id) rec ON rec.user_id = u.id
LEFT JOIN (SELECT * FROM windows ORDER BY window_start DESC LIMIT 1) lw ON true
WHERE u.role = 'student'""", "users", "submissions", "submissions_text", "checks", "event_stream",
                                        extra=[NOTIFICATIONS_CTE, WINDOWS_CTE]))
def student_dashboard(spark, d):
    """The student mart for every student."""
    m = MT.student_dashboard(V.users(spark, d), V.submissions(spark, d),
                             newest(spark, d).drop("rank"), W.latest_window(windows(spark, d)))
    return m.withColumn("recent_messages", F.array_join("recent_messages", "\n"))


@query("faculty_recent", with_views(FACULTY_RECENT_SQL, "users", "submissions"))
def faculty_recent(spark, d):
    """Newest 10 submissions of all students."""
    return MT.faculty_recent(V.users(spark, d), V.submissions(spark, d))


@query("faculty_summary", with_views(f"""
SELECT t.total_submissions,
       CASE WHEN lw.avg_internal_score > 0.5
            THEN CAST(trunc(t.total_submissions * lw.avg_internal_score) AS BIGINT) ELSE 0 END AS flagged_count,
       coalesce(lw.submission_count > 10, false) AS spike_detected,
       coalesce(lw.avg_internal_score, 0.0) AS avg_plagiarism
FROM (SELECT count(*) AS total_submissions FROM ({STUDENT_SUBMISSIONS_SQL})) t
LEFT JOIN (SELECT * FROM windows_raw ORDER BY window_start DESC LIMIT 1) lw ON true""",
                                     "users", "submissions", "event_stream", extra=[WINDOWS_RAW_CTE]))
def faculty_summary(spark, d):
    """Faculty totals, flagged estimate and spike flag from the latest window."""
    subs = MT.student_submissions(V.users(spark, d), V.submissions(spark, d))
    return MT.faculty_summary(subs, W.latest_window(windows(spark, d)))


@query("result_stats", with_views("""
SELECT round(coalesce(avg(internal_score), 0.0), 6) AS avg_internal_score,
       round(coalesce(avg(external_score), 0.0), 6) AS avg_external_score,
       round(coalesce(avg(ai_generated_probability), 0.0), 6) AS avg_ai_probability,
       count(*) AS total_results
FROM checks""", "checks"))
def result_stats(spark, d):
    """D3: group-all statistics of the stored results."""
    return MT.result_stats(V.checks(spark, d))


@query("display_rows", with_views("""
SELECT c.submission_id, left(sha256(CAST(c.submission_id AS VARCHAR)), 8) AS short_id,
       strftime(s.uploaded_at, '%Y-%m-%d %H:%M') AS uploaded,
       printf('%.1f%%', c.internal_score * 100) AS internal_pct,
       printf('%.1f%%', c.ai_generated_probability * 100) AS ai_pct
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY checked_at DESC,
        l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
        l_discount DESC, l_tax DESC) AS rn FROM checks) WHERE rn = 1) c
JOIN submissions s ON s.id = c.submission_id""", "checks", "submissions"))
def display_rows(spark, d):
    """Formatted dashboard rows of the latest result per submission."""
    c = V.checks(spark, d)
    latest = B.latest_per_key(c, ["submission_id"], V.CHECK_ORDER, payload=list(c.columns))
    return MT.display_rows(latest, V.submissions(spark, d))


@query("display_windows", with_views("""
SELECT window_start, strftime(window_start, '%Y-%m-%d %H:%M') AS window,
       printf('%.2f', submission_count / 60.0) AS rate,
       printf('%.1f%%', avg_internal_score * 100) AS avg_plagiarism_pct,
       submission_count > 10 AS spike_detected
FROM windows""", "event_stream", extra=[WINDOWS_CTE]))
def display_windows(spark, d):
    """Formatted window rows of the faculty dashboard."""
    return MT.display_windows(windows(spark, d))
