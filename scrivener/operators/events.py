"""Event ETL: decode/encode (A3, A4), topic dispatch (A5), enrich stages
(B1, B2), error tagging (B9) and domain validation (B20)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions import messages as M
from scrivener.functions import scoring

# Event types and pipeline names the stages stamp.
UPLOAD_EVENT = "paper_uploaded"
CHECK_EVENT = "plagiarism_checked"
UPLOAD_PIPELINE = "submission-service"
CHECK_PIPELINE = "plagiarism-service"
# Error texts of a check request for an unknown user and
# without text.
USER_NOT_FOUND = "User %s not found"
TEXT_REQUIRED = "Research paper text is required for plagiarism check"

CORRUPT = "_corrupt_record"
# Timestamps on topics keep microseconds (Spark's JSON default stops at ms).
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def decode(df: DataFrame, schema: T.StructType, col: str = "value",
           keep_raw: bool = True) -> tuple[DataFrame, DataFrame]:
    """A3: JSON text -> typed columns. Returns (good, bad).

    Malformed JSON lands in ``bad`` with the raw text, instead of being
    logged and lost. The raw string stays in ``_raw`` so unknown fields
    pass through to later stages.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = F.col(col).cast("string")
    parsed = df.withColumn("_p", F.from_json(
        raw, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **JSON_OPTIONS}))
    bad_pred = F.col("_p").isNull() | F.col(f"_p.{CORRUPT}").isNotNull()
    others = [c for c in df.columns if c != col]
    good_cols = others + [F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]
    if keep_raw:
        good_cols.append(raw.alias("_raw"))
    good = parsed.where(~bad_pred).select(*good_cols)
    bad = parsed.where(bad_pred).select(*others, raw.alias("_raw"),
                                        F.lit("malformed JSON").alias("error"))
    return good, bad


def encode(df: DataFrame, cols: list[str] | None = None, out: str = "value") -> DataFrame:
    """A4: record -> JSON text, null fields included."""
    cols = cols or df.columns
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", **JSON_OPTIONS}).alias(out))


def dispatch(df: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]],
             topic_col: str = "topic") -> DataFrame:
    """Route rows by topic to a handler each; unhandled topics drop.

    One read of a multi-topic subscription; each branch is a filter, the
    results are unioned by name.
    """
    out = None
    for topic, fn in handlers.items():
        branch = fn(df.where(F.col(topic_col) == topic))
        out = branch if out is None else out.unionByName(branch, allowMissingColumns=True)
    return out


def enrich_submission(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Upload metadata. NULL text keeps the row with NULL length. A
    ``text_length`` that the rows bring along is kept, so callers can take it
    before a join instead of shuffling the text."""
    cols = {"event_type": F.lit(UPLOAD_EVENT), "processing_pipeline": F.lit(UPLOAD_PIPELINE)}
    if "text_length" not in df.columns:
        cols["text_length"] = F.length("text")
    if processed_at is not None:
        cols["processed_at"] = processed_at
    return df.withColumns(cols)


def enrich_check(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """B2: check metadata; the rest passes through."""
    cols = {
        "event_type": F.lit(CHECK_EVENT),
        "processing_pipeline": F.lit(CHECK_PIPELINE),
    }
    if processed_at is not None:
        cols["processed_at"] = processed_at
    return df.withColumns(cols)


def tag_errors(df: DataFrame, rules: list[tuple[Column, str]], out: str = "error") -> DataFrame:
    """``error`` = message of the first failing rule (a rule is a column
    that is True when the row is bad; the message a string or a Column),
    NULL when the row is fine."""
    expr = None
    for bad, msg in rules:
        m = msg if isinstance(msg, Column) else F.lit(msg)
        expr = F.when(bad, m) if expr is None else expr.when(bad, m)
    return df.withColumn(out, expr)


def split_errors(df: DataFrame, col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, dead-letter) by the error column."""
    return df.where(F.col(col).isNull()).drop(col), df.where(F.col(col).isNotNull())


def violations(rules: dict[str, Column]) -> Column:
    """Array of the names of failed rules (a rule is True when valid;
    NULL counts as failed)."""
    return F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda x: x.isNotNull())


def in_range(c: str, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.col(c).between(lo, hi)


def user_rules(roles: tuple[str, ...] = ("student", "faculty")) -> dict[str, Column]:
    """Domain rules of a user record."""
    return {"id": F.col("id").isNotNull() & (F.col("id").cast("string") != ""),
            "role": F.col("role").isin(*roles)}


def submission_rules() -> dict[str, Column]:
    """Domain rules of a submission record (B20): the ids it cannot do without."""
    return {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in ("id", "user_id", "assignment_id")}


def submission_defaults(df: DataFrame, now: Column) -> DataFrame:
    """A missing upload time is ``now``; a missing id is made of the record
    itself, so a replay gives the same one."""
    made = M.id_or_new("id", "user_id", "assignment_id", "file_url", "uploaded_at")
    return df.withColumns({"id": made, "uploaded_at": F.coalesce("uploaded_at", now)})


def processed_event_rules() -> dict[str, Column]:
    """Domain rules of the processed-event record."""
    et = F.col("event_type")
    is_check = et == CHECK_EVENT
    return {
        "event_type": et.isin(UPLOAD_EVENT, CHECK_EVENT),
        "user_id": F.col("user_id").isNotNull(),
        "internal_score": ~is_check | in_range("internal_score"),
        "external_score": ~is_check | in_range("external_score"),
        "ai_generated_probability": ~is_check | in_range("ai_generated_probability"),
        "severity": ~is_check | F.col("severity").isin(*scoring.SEVERITIES),
    }
