"""Record schemas as StructTypes."""

from pyspark.sql import types as T

USER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("role", T.StringType()),
])

SUBMISSION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("assignment_id", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("file_url", T.StringType()),
    T.StructField("text", T.StringType()),
])

CHECK_RESULT = T.StructType([
    T.StructField("submission_id", T.StringType()),
    T.StructField("internal_score", T.DoubleType()),
    T.StructField("external_score", T.DoubleType()),
    T.StructField("ai_generated_probability", T.DoubleType()),
    T.StructField("flagged_sections", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("requires_review", T.BooleanType()),
    T.StructField("ai_generated_likely", T.BooleanType()),
])

# Events on the processed topics: union of the upload and check shapes plus
# the metadata the enrich stages add. Unknown fields survive in ``_raw``.
PROCESSED_EVENT = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("processing_pipeline", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("assignment_id", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_length", T.IntegerType()),
    T.StructField("submission_id", T.StringType()),
    T.StructField("internal_score", T.DoubleType()),
    T.StructField("external_score", T.DoubleType()),
    T.StructField("ai_generated_probability", T.DoubleType()),
    T.StructField("flagged_sections", T.ArrayType(T.StringType())),
    T.StructField("severity", T.StringType()),
    T.StructField("requires_review", T.BooleanType()),
    T.StructField("ai_generated_likely", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

ANALYTICS_WINDOW = T.StructType([
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("submission_count", T.LongType()),
    T.StructField("avg_internal_score", T.DoubleType()),
    T.StructField("avg_external_score", T.DoubleType()),
    T.StructField("avg_ai_probability", T.DoubleType()),
    T.StructField("high_risk_count", T.LongType()),
    T.StructField("total_checks", T.LongType()),
])

LEGACY_WINDOW = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("submission_rate", T.DoubleType()),
    T.StructField("avg_plagiarism", T.DoubleType()),
    T.StructField("avg_ai_probability", T.DoubleType()),
    T.StructField("spike_detected", T.BooleanType()),
])

NOTIFICATION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

OBJECT_CREATED = T.StructType([
    T.StructField("Records", T.ArrayType(T.StructType([
        T.StructField("s3", T.StructType([
            T.StructField("bucket", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("object", T.StructType([T.StructField("key", T.StringType())])),
        ])),
    ]))),
])

# Topic record as delivered by a broker / file topic.
TOPIC_RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
