"""Registered event-ETL queries: A3, A4, A5, B1, B2, B4-B9, B20, S1."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions import messages as M
from scrivener.functions import scoring as S
from scrivener.operators import events as E
from scrivener.operators import windows as W
from scrivener.plans import views as V
from scrivener.plans.registry import query
from scrivener.plans.sql_views import with_views
from scrivener.sources.tables import read_table

_K_SCHEMA = T.StructType([T.StructField("k", T.LongType())])

CHECK_FLAGS_SQL = """
  CASE WHEN internal_score >= 0.7 THEN 'high' WHEN internal_score >= 0.4 THEN 'medium'
       WHEN internal_score IS NOT NULL THEN 'low' END AS severity,
  coalesce(internal_score >= 0.5, false) AS requires_review,
  coalesce(ai_generated_probability >= 0.7, false) AS ai_generated_likely"""


@query("decode_events", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       coalesce(json_valid(props), false) AS is_valid
FROM events""")
def decode_events(spark, d):
    """A3: decode the JSON ``props`` of events; malformed rows kept apart."""
    ev = read_table(spark, d, "events").select("event_id", "props")
    good, bad = E.decode(ev, _K_SCHEMA, col="props", keep_raw=False)
    return (good.select("event_id", "k", F.lit(True).alias("is_valid"))
            .unionByName(bad.select("event_id", F.lit(None).cast("bigint").alias("k"),
                                    F.lit(False).alias("is_valid"))))


@query("encode_events", with_views("""
SELECT event_id,
       '{"event_id":' || CAST(event_id AS VARCHAR) || ',"user_id":' || CAST(user_id AS VARCHAR)
       || ',"event_type":' || CAST(to_json(event_type) AS VARCHAR)
       || ',"severity":' || coalesce(CAST(to_json(severity) AS VARCHAR), 'null') || '}' AS value
FROM event_stream""", "event_stream"))
def encode_events(spark, d):
    """A4: records to JSON text with null fields kept."""
    es = V.event_stream(spark, d)
    return es.select("event_id", F.to_json(
        F.struct("event_id", "user_id", "event_type", "severity"),
        {"ignoreNullFields": "false"}).alias("value"))


@query("dispatch_by_topic", with_views("""
SELECT event_id, event_type || '_processed' AS topic, user_id,
       format('✓ Your paper (submission {}, {} characters) has been successfully uploaded and is queued for plagiarism checking', event_id, 0) AS message
FROM event_stream WHERE event_type = 'paper_uploaded'
UNION ALL
SELECT event_id, event_type || '_processed' AS topic, user_id,
       CASE WHEN severity = 'high' THEN '⚠️ HIGH RISK: Plagiarism check for submission ' || event_id || ' detected ' || printf('%.1f%%', internal_score * 100) || ' similarity. Manual review required.'
            WHEN internal_score >= 0.5 THEN '⚠️ REVIEW NEEDED: Plagiarism check for submission ' || event_id || ' detected ' || printf('%.1f%%', internal_score * 100) || ' similarity.'
            ELSE '✓ Plagiarism check completed for submission ' || event_id || ': ' || printf('%.1f%%', internal_score * 100) || ' similarity (' || severity || ' risk)' END AS message
FROM event_stream WHERE event_type = 'plagiarism_checked'""", "event_stream"))
def dispatch_by_topic(spark, d):
    """A5: one multi-topic read, routed by topic; unhandled topics dropped."""
    es = V.event_stream(spark, d).withColumn(
        "topic", F.concat(F.col("event_type"), F.lit("_processed")))
    handlers = {
        "paper_uploaded_processed": lambda df: df.select(
            "event_id", "topic", "user_id",
            M.upload_message("event_id", F.lit(None)).alias("message")),
        "plagiarism_checked_processed": lambda df: df.select(
            "event_id", "topic", "user_id",
            M.check_message("event_id", "internal_score", "severity",
                            S.requires_review("internal_score")).alias("message")),
    }
    return E.dispatch(es, handlers)


@query("enrich_submission", with_views("""
SELECT id, user_id, assignment_id, uploaded_at, 'paper_uploaded' AS event_type,
       'submission-service' AS processing_pipeline, length(text) AS text_length
FROM submissions_text""", "submissions_text"))
def enrich_submission(spark, d):
    """Upload events with metadata and text length (NULL text kept)."""
    s = E.enrich_submission(V.submissions_with_length(spark, d))
    return s.select("id", "user_id", "assignment_id", "uploaded_at", "event_type",
                    "processing_pipeline", F.col("text_length").cast("bigint").alias("text_length"))


@query("enrich_check", with_views(f"""
SELECT submission_id, l_linenumber, internal_score, external_score, ai_generated_probability,
       {CHECK_FLAGS_SQL}, 'plagiarism_checked' AS event_type, 'plagiarism-service' AS processing_pipeline
FROM checks""", "checks"))
def enrich_check(spark, d):
    """B2: check events with metadata; other fields pass through."""
    c = E.enrich_check(S.with_check_flags(V.checks(spark, d)))
    return c.select("submission_id", "l_linenumber", "internal_score", "external_score",
                    "ai_generated_probability", "severity", "requires_review",
                    "ai_generated_likely", "event_type", "processing_pipeline")


@query("severity", with_views(f"""
SELECT submission_id, l_linenumber, internal_score, ai_generated_probability, {CHECK_FLAGS_SQL}
FROM checks""", "checks"))
def severity(spark, d):
    """Severity, requires_review and ai_generated_likely."""
    c = S.with_check_flags(V.checks(spark, d))
    return c.select("submission_id", "l_linenumber", "internal_score",
                    "ai_generated_probability", "severity", "requires_review",
                    "ai_generated_likely")


@query("check_record", with_views(f"""
SELECT event_id AS submission_id, internal_score, external_score, ai_generated_probability,
       0 AS n_flagged, {CHECK_FLAGS_SQL}
FROM event_stream WHERE event_type = 'plagiarism_checked'""", "event_stream"))
def check_record(spark, d):
    """Assemble check records from the check events of the stream."""
    es = V.event_stream(spark, d).where(F.col("event_type") == W.CHECK)
    rec = S.check_record(es, submission_id="event_id", flagged=None)
    return rec.withColumn("n_flagged", F.size("flagged_sections")).drop("flagged_sections")


@query("text_cap", """
SELECT doc_id, length(substring(text, 1, 4000)) AS capped_length,
       md5(substring(text, 1, 4000)) AS capped_md5
FROM documents""")
def text_cap(spark, d):
    """The first 4000 characters of each text go to scoring."""
    docs = read_table(spark, d, "documents")
    capped = S.text_cap("text")
    return docs.select("doc_id", F.length(capped).cast("bigint").alias("capped_length"),
                       F.md5(capped).alias("capped_md5"))


@query("dead_letter", with_views("""
SELECT s.id, s.user_id,
       CASE WHEN u.id IS NULL THEN 'User ' || CAST(s.user_id AS VARCHAR) || ' not found'
            WHEN s.text IS NULL OR s.text = '' THEN 'Research paper text is required for plagiarism check' END AS error
FROM submissions_text s LEFT JOIN users u ON u.id = s.user_id
WHERE u.id IS NULL OR s.text IS NULL OR s.text = ''""", "users", "submissions_text"))
def dead_letter(spark, d):
    """Submission events that fail the check stage, with an error text."""
    subs = V.submissions_with_length(spark, d)
    u = V.users(spark, d).select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    tagged = E.tag_errors(subs.join(u, "user_id", "left"), [
        (F.col("_known").isNull(), F.format_string(E.USER_NOT_FOUND, F.col("user_id").cast("string"))),
        (F.coalesce("text_length", F.lit(0)) == 0, E.TEXT_REQUIRED),
    ])
    _, bad = E.split_errors(tagged)
    return bad.select("id", "user_id", "error")


@query("validate_records", with_views("""
SELECT event_id, concat_ws(',',
  CASE WHEN NOT coalesce(event_type IN ('paper_uploaded', 'plagiarism_checked'), false) THEN 'event_type' END,
  CASE WHEN NOT coalesce(user_id IS NOT NULL, false) THEN 'user_id' END,
  CASE WHEN NOT coalesce(event_type <> 'plagiarism_checked' OR internal_score BETWEEN 0 AND 1, false) THEN 'internal_score' END,
  CASE WHEN NOT coalesce(event_type <> 'plagiarism_checked' OR external_score BETWEEN 0 AND 1, false) THEN 'external_score' END,
  CASE WHEN NOT coalesce(event_type <> 'plagiarism_checked' OR ai_generated_probability BETWEEN 0 AND 1, false) THEN 'ai_generated_probability' END,
  CASE WHEN NOT coalesce(event_type <> 'plagiarism_checked' OR severity IN ('low', 'medium', 'high'), false) THEN 'severity' END
) AS violations
FROM event_stream
WHERE NOT coalesce(event_type IN ('paper_uploaded', 'plagiarism_checked'), false)
   OR NOT coalesce(user_id IS NOT NULL, false)
   OR NOT coalesce(event_type <> 'plagiarism_checked' OR internal_score BETWEEN 0 AND 1, false)
   OR NOT coalesce(event_type <> 'plagiarism_checked' OR external_score BETWEEN 0 AND 1, false)
   OR NOT coalesce(event_type <> 'plagiarism_checked' OR ai_generated_probability BETWEEN 0 AND 1, false)
   OR NOT coalesce(event_type <> 'plagiarism_checked' OR severity IN ('low', 'medium', 'high'), false)
""", "event_stream"))
def validate_records(spark, d):
    """Domain violations of processed-event records."""
    v = V.event_stream(spark, d).withColumn("_v", E.violations(E.processed_event_rules()))
    return v.where(F.size("_v") > 0).select("event_id", F.array_join("_v", ",").alias("violations"))


@query("union_streams", with_views("""
SELECT 'paper_uploaded' AS event_type, id, user_id, NULL::BIGINT AS submission_id,
       NULL::DOUBLE AS internal_score FROM submissions
UNION ALL
SELECT 'plagiarism_checked', NULL, NULL, submission_id, internal_score FROM checks""",
                                    "submissions", "checks"))
def union_streams(spark, d):
    """N-way union of the upload and check streams by column name."""
    ups = E.enrich_submission(V.submissions(spark, d).withColumn("text", F.lit(None).cast("string")))
    chk = E.enrich_check(V.checks(spark, d))
    u = W.union_streams(ups.select("event_type", "id", "user_id"),
                        chk.select("event_type", "submission_id", "internal_score"))
    return u.select("event_type", "id", "user_id", "submission_id", "internal_score")
