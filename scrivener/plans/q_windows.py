"""Registered window queries: D1, D2, D4, E10, F5-F7, S1."""

from __future__ import annotations


from scrivener.operators import windows as W
from scrivener.plans import views as V
from scrivener.plans.registry import query
from scrivener.plans.sql_views import with_views

_D1_SELECT = """
  count(*) FILTER (WHERE event_type = 'paper_uploaded') AS submission_count,
  round(coalesce(avg(coalesce(internal_score, 0.0)) FILTER (WHERE event_type = 'plagiarism_checked'), 0.0), 6) AS avg_internal_score,
  round(coalesce(avg(coalesce(external_score, 0.0)) FILTER (WHERE event_type = 'plagiarism_checked'), 0.0), 6) AS avg_external_score,
  round(coalesce(avg(coalesce(ai_generated_probability, 0.0)) FILTER (WHERE event_type = 'plagiarism_checked'), 0.0), 6) AS avg_ai_probability,
  count(*) FILTER (WHERE event_type = 'plagiarism_checked' AND severity = 'high') AS high_risk_count,
  count(*) FILTER (WHERE event_type = 'plagiarism_checked') AS total_checks"""

D1_SQL = with_views(f"""
SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start,
       time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end,
       {_D1_SELECT}
FROM event_stream GROUP BY 1, 2""", "event_stream")

# CTE: the tumbling windows of D1, for queries built on top of them.
WINDOWS_CTE = f"""
windows AS (
  SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start,
         time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end,
         {_D1_SELECT}
  FROM event_stream GROUP BY 1, 2)"""


# The same windows with unrounded averages (for values derived from them).
WINDOWS_RAW_CTE = WINDOWS_CTE.replace("windows AS (", "windows_raw AS (").replace(
    "round(coalesce(", "(coalesce(").replace("), 0.0), 6) AS avg_", "), 0.0)) AS avg_")


def windows(spark, d):
    return W.window_analytics(V.event_stream(spark, d))


@query("window_analytics", D1_SQL)
def window_analytics(spark, d):
    """D1 flagship: 5-minute tumbling window metrics over the event stream."""
    return windows(spark, d)


@query("window_count", with_views("""
SELECT CAST(epoch_ms(time_bucket(INTERVAL 5 MINUTES, ts)) AS BIGINT) AS window_start,
       CAST(epoch_ms(time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES) AS BIGINT) AS window_end,
       count(*) AS event_count
FROM event_stream GROUP BY 1, 2""", "event_stream"))
def window_count(spark, d):
    """Per-window event count with epoch-millisecond bounds."""
    return W.window_count(V.event_stream(spark, d))


@query("spike_window", with_views("""
SELECT date_trunc('hour', ts) AS timestamp,
       round(count(*) FILTER (WHERE event_type = 'paper_uploaded') / 60.0, 6) AS submission_rate,
       round(coalesce(avg(coalesce(internal_score, 0.0)) FILTER (WHERE event_type = 'plagiarism_checked'), 0.0), 6) AS avg_plagiarism,
       round(coalesce(avg(coalesce(internal_score, 0.0)) FILTER (WHERE event_type = 'plagiarism_checked'), 0.0) * 0.8, 6) AS avg_ai_probability,
       count(*) FILTER (WHERE event_type = 'paper_uploaded') > 10 AS spike_detected
FROM event_stream GROUP BY 1""", "event_stream"))
def spike_window(spark, d):
    """Legacy on-demand window per hour bucket."""
    return W.legacy_window(V.event_stream(spark, d))


@query("sliding_metrics", with_views(f"""
SELECT window_start, window_start + INTERVAL 10 MINUTES AS window_end, {_D1_SELECT}
FROM (SELECT e.*, time_bucket(INTERVAL 5 MINUTES, ts) - INTERVAL 5 MINUTES * o.k AS window_start
      FROM event_stream e, (VALUES (0), (1)) o(k))
GROUP BY 1, 2""", "event_stream"))
def sliding_metrics(spark, d):
    """D1 metrics over 10-minute windows sliding by 5 minutes."""
    return W.window_analytics(V.event_stream(spark, d), size="10 minutes", slide="5 minutes")


@query("session_metrics", with_views(f"""
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTES AS window_end, {_D1_SELECT}
FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM event_stream))
GROUP BY user_id, sid""", "event_stream"))
def session_metrics(spark, d):
    """D1 metrics per user session (30-minute gap)."""
    return W.session_analytics(V.event_stream(spark, d), ("user_id",), gap_seconds=1800,
                               tie="event_id")


@query("latest_window", with_views("""
SELECT * FROM windows ORDER BY window_start DESC LIMIT 1""", "event_stream", extra=[WINDOWS_CTE]))
def latest_window(spark, d):
    """newest window."""
    return W.latest_window(windows(spark, d))


@query("window_history", with_views("""
SELECT * FROM windows""", "event_stream", extra=[WINDOWS_CTE]))
def window_history(spark, d):
    """the whole window history."""
    return W.window_history(windows(spark, d))


@query("faculty_windows", with_views("""
SELECT * FROM windows ORDER BY window_start DESC LIMIT 10""", "event_stream", extra=[WINDOWS_CTE]))
def faculty_windows(spark, d):
    """ten newest windows for the faculty view."""
    return W.newest_windows(windows(spark, d), 10)


@query("window_records", D1_SQL)
def window_records(spark, d):
    """D1 windows written as JSON window records and consumed back
    with the consumer's defaults (round trip equals D1)."""
    from scrivener.operators.events import encode
    return W.consume_window_records(encode(windows(spark, d)))
