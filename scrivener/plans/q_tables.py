"""Registered table/join queries: A6, A7, B18, B19, C1-C3, E8, F1, G1-G4."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.functions import scoring as S
from scrivener.operators import base as B
from scrivener.operators import tables as TB
from scrivener.plans import views as V
from scrivener.plans.q_events import CHECK_FLAGS_SQL
from scrivener.plans.registry import query
from scrivener.plans.sql_views import with_views

LOOKUP_ID = 7

CHECK_COLS = ("submission_id", "internal_score", "external_score", "ai_generated_probability",
              "checked_at", "l_linenumber", "l_partkey", "l_suppkey")
_CHECK_ORDER_SQL = ("checked_at {d}, l_linenumber {d}, l_partkey {d}, l_suppkey {d}, l_quantity {d}, "
                    "l_extendedprice {d}, l_discount {d}, l_tax {d}")


def _results(spark, d):
    return S.with_check_flags(V.checks(spark, d))


@query("scan_users", with_views("SELECT * FROM users", "users"))
def scan_users(spark, d):
    """Relational scan of users."""
    return V.users(spark, d)


@query("scan_submissions", with_views("SELECT * FROM submissions_text", "submissions_text"))
def scan_submissions(spark, d):
    """All submissions with their text."""
    return V.submissions(spark, d, with_text=True)


@query("scan_results", with_views(f"""
SELECT submission_id, internal_score, external_score, ai_generated_probability, checked_at,
       l_linenumber, l_partkey, l_suppkey, {CHECK_FLAGS_SQL}
FROM checks""", "checks"))
def scan_results(spark, d):
    """Check results with every column kept (severity and flags too)."""
    return _results(spark, d).select(*CHECK_COLS, "severity", "requires_review",
                                     "ai_generated_likely")


@query("lookup_submission", with_views(f"SELECT * FROM submissions_text WHERE id = {LOOKUP_ID}",
                                        "submissions_text"))
def lookup_submission(spark, d):
    """Point lookup by key; the filter is pushed to the scans."""
    return TB.lookup(V.submissions(spark, d, with_text=True), "id", LOOKUP_ID)


@query("eligible_submissions", with_views("""
SELECT s.* FROM submissions s WHERE s.user_id IN (SELECT id FROM users WHERE role = 'student')""",
                                           "users", "submissions"))
def eligible_submissions(spark, d):
    """Submissions of students only."""
    return TB.eligible(V.submissions(spark, d), V.users(spark, d), "student")


@query("valid_submissions", with_views("""
SELECT s.* FROM submissions s WHERE s.user_id IN (SELECT id FROM users)""", "users", "submissions"))
def valid_submissions(spark, d):
    """Submissions whose user exists."""
    return TB.valid_rows(V.submissions(spark, d), V.users(spark, d))


@query("rejected_submissions", with_views("""
SELECT s.* FROM submissions s WHERE s.user_id NOT IN (SELECT id FROM users)""", "users", "submissions"))
def rejected_submissions(spark, d):
    """Submissions whose user is unknown (404 / skipped)."""
    return TB.rejected_rows(V.submissions(spark, d), V.users(spark, d))


@query("text_backfill", with_views("""
SELECT c.submission_id, c.l_linenumber, c.l_partkey, c.l_suppkey,
       length(nullif(s.text, '')) AS text_length,
       CASE WHEN nullif(s.text, '') IS NULL THEN 'rejected' ELSE 'ok' END AS status
FROM checks c LEFT JOIN submissions_text s ON s.id = c.submission_id""", "checks", "submissions_text"))
def text_backfill(spark, d):
    """Check events carry no text; take it from the stored submission,
    reject when there is none."""
    ev = V.checks(spark, d).select("submission_id", "l_linenumber", "l_partkey", "l_suppkey",
                                   F.lit(None).cast("int").alias("text_length"))
    out = TB.backfill_length(ev, V.submissions_with_length(spark, d))
    return out.select("submission_id", "l_linenumber", "l_partkey", "l_suppkey",
                      F.col("text_length").cast("bigint").alias("text_length"), "status")


@query("latest_results", with_views(f"""
SELECT submission_id, internal_score, external_score, ai_generated_probability, checked_at,
       l_linenumber, l_partkey, l_suppkey, {CHECK_FLAGS_SQL}
FROM (SELECT *, row_number() OVER (PARTITION BY submission_id
                                   ORDER BY {_CHECK_ORDER_SQL.format(d='DESC')}) AS rn FROM checks)
WHERE rn = 1""", "checks"))
def latest_results(spark, d):
    """One result per submission, last write wins."""
    c = V.checks(spark, d)
    latest = B.latest_per_key(c, ["submission_id"], V.CHECK_ORDER, payload=list(c.columns))
    return S.with_check_flags(latest).select(*CHECK_COLS, "severity", "requires_review",
                                             "ai_generated_likely")


@query("dedupe_checks", with_views(f"""
SELECT submission_id, internal_score, external_score, ai_generated_probability, checked_at,
       l_linenumber, l_partkey, l_suppkey
FROM (SELECT *, row_number() OVER (PARTITION BY submission_id
                                   ORDER BY {_CHECK_ORDER_SQL.format(d='ASC')}) AS rn FROM checks)
WHERE rn = 1""", "checks"))
def dedupe_checks(spark, d):
    """E8 (batch form): the first check of each submission; repeats dropped."""
    c = V.checks(spark, d)
    first = B.first_per_key(c, ["submission_id"], V.CHECK_ORDER, payload=list(c.columns))
    return first.select(*CHECK_COLS)


@query("apply_user_changes", with_views("""
SELECT id, name, email, role FROM (
  SELECT k.id,
         CASE WHEN u.s > st.s THEN u.name ELSE st.name END AS name,
         CASE WHEN u.s > st.s THEN u.email ELSE st.email END AS email,
         CASE WHEN u.s > st.s THEN u.role ELSE st.role END AS role
  FROM (SELECT id FROM base_users UNION SELECT id FROM user_changes) k
  LEFT JOIN (SELECT id, max(seq) AS last_del FROM user_changes WHERE op = 'delete' GROUP BY id) dl
         ON dl.id = k.id
  LEFT JOIN (SELECT c.id, min(c.seq) AS s FROM user_changes c
             LEFT JOIN (SELECT id, max(seq) AS last_del FROM user_changes WHERE op = 'delete' GROUP BY id) d2
                    ON d2.id = c.id
             WHERE c.op = 'insert' AND (d2.last_del IS NULL OR c.seq > d2.last_del) GROUP BY c.id) fi
         ON fi.id = k.id
  LEFT JOIN base_users b ON b.id = k.id
  LEFT JOIN LATERAL (
     SELECT CASE WHEN b.id IS NOT NULL AND dl.last_del IS NULL THEN '' ELSE fi.s END AS s,
            CASE WHEN b.id IS NOT NULL AND dl.last_del IS NULL THEN b.name ELSE ci.name END AS name,
            CASE WHEN b.id IS NOT NULL AND dl.last_del IS NULL THEN b.email ELSE ci.email END AS email,
            CASE WHEN b.id IS NOT NULL AND dl.last_del IS NULL THEN b.role ELSE ci.role END AS role
     FROM (SELECT 1) one LEFT JOIN user_changes ci ON ci.id = k.id AND ci.seq = fi.s AND ci.op = 'insert'
  ) st ON true
  LEFT JOIN (SELECT id, seq AS s, name, email, role FROM (
               SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
               FROM user_changes WHERE op = 'update') WHERE rn = 1) u ON u.id = k.id
  WHERE st.s IS NOT NULL)""", "base_users", "user_changes"))
def apply_user_changes(spark, d):
    """Apply the insert/update/delete change log to the base users."""
    return TB.apply_changes(V.base_users(spark, d), V.user_changes(spark, d))


@query("change_conflicts", with_views("""
SELECT id, seq, op, conflict FROM (
  SELECT id, seq, op,
         CASE WHEN op = 'insert' AND live THEN 'insert of a live id'
              WHEN op = 'update' AND NOT live THEN 'update of an absent id'
              WHEN op = 'delete' AND NOT live THEN 'delete of an absent id' END AS conflict
  FROM (SELECT *, CASE WHEN prev_op IS NULL THEN base_live ELSE prev_op = 'insert' END AS live
        FROM (SELECT c.*, b.id IS NOT NULL AS base_live,
                     last_value(CASE WHEN c.op IN ('insert', 'delete') THEN c.op END IGNORE NULLS)
                       OVER (PARTITION BY c.id ORDER BY c.seq
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_op
              FROM user_changes c LEFT JOIN base_users b ON b.id = c.id)))
WHERE conflict IS NOT NULL""", "base_users", "user_changes"))
def change_conflicts(spark, d):
    """G2 report: inserts of live ids and updates/deletes of absent ids."""
    return TB.change_conflicts(V.base_users(spark, d), V.user_changes(spark, d))


@query("unique_violations", with_views("""
SELECT 'users.id' AS constraint, CAST(id AS VARCHAR) AS key, count(*) AS n FROM users GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'users.email', email, count(*) FROM users GROUP BY email HAVING count(*) > 1
UNION ALL
SELECT 'submissions.id', CAST(id AS VARCHAR), count(*) FROM submissions GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'results.submission_id', CAST(submission_id AS VARCHAR), count(*) FROM checks
GROUP BY submission_id HAVING count(*) > 1""", "users", "submissions", "checks"))
def unique_violations(spark, d):
    """Primary-key / unique violations of users, submissions and results."""
    u = V.users(spark, d)
    return (TB.duplicate_keys(u, ["id"], "users.id")
            .unionByName(TB.duplicate_keys(u, ["email"], "users.email"))
            .unionByName(TB.duplicate_keys(V.submissions(spark, d), ["id"], "submissions.id"))
            .unionByName(TB.duplicate_keys(V.checks(spark, d), ["submission_id"],
                                           "results.submission_id")))


@query("submissions_by_user", with_views("""
SELECT user_id, id, uploaded_at,
       row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, id DESC) AS position
FROM submissions""", "submissions"))
def submissions_by_user(spark, d):
    """every user's submissions, newest first (position 1 = newest)."""
    s = V.submissions(spark, d).select("user_id", "id", "uploaded_at")
    return TB.by_user_newest_first(s).select("user_id", "id", "uploaded_at",
                                             F.col("position").cast("bigint").alias("position"))
