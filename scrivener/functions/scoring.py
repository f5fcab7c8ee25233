"""Score-derived columns (B4-B8). All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's business rules.
HIGH_THRESHOLD = 0.7      # internal score >= 0.7 -> "high"
MEDIUM_THRESHOLD = 0.4    # internal score >= 0.4 -> "medium", else "low"
REVIEW_THRESHOLD = 0.5    # internal score >= 0.5 -> requires_review
AI_LIKELY_THRESHOLD = 0.7 # ai probability >= 0.7 -> ai_generated_likely
SCORING_TEXT_CAP = 4000   # characters of text sent to scoring

SEVERITIES = ("low", "medium", "high")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def severity(internal) -> Column:
    """Severity from the internal score; NULL score -> NULL severity."""
    s = _c(internal)
    return (F.when(s >= HIGH_THRESHOLD, F.lit("high"))
            .when(s >= MEDIUM_THRESHOLD, F.lit("medium"))
            .when(s.isNotNull(), F.lit("low")))


def requires_review(internal) -> Column:
    """B5."""
    return F.coalesce(_c(internal) >= REVIEW_THRESHOLD, F.lit(False))


def ai_generated_likely(ai_prob) -> Column:
    """B6."""
    return F.coalesce(_c(ai_prob) >= AI_LIKELY_THRESHOLD, F.lit(False))


def with_check_flags(df, internal="internal_score", ai="ai_generated_probability"):
    """B4-B6 as one projection."""
    return df.withColumns({
        "severity": severity(internal),
        "requires_review": requires_review(internal),
        "ai_generated_likely": ai_generated_likely(ai),
    })


def check_record(df, submission_id="submission_id", internal="internal_score",
                 external="external_score", ai="ai_generated_probability",
                 flagged: str | None = "flagged_sections"):
    """Assemble the check-result record from id, three scores and flags
    (``flagged=None``: no flagged sections, an empty list)."""
    flags = _c(flagged) if flagged is not None else F.array().cast("array<string>")
    return df.select(
        _c(submission_id).alias("submission_id"),
        _c(internal).alias("internal_score"),
        _c(external).alias("external_score"),
        _c(ai).alias("ai_generated_probability"),
        flags.alias("flagged_sections"),
        severity(internal).alias("severity"),
        requires_review(internal).alias("requires_review"),
        ai_generated_likely(ai).alias("ai_generated_likely"),
    )


def text_cap(text, n: int = SCORING_TEXT_CAP) -> Column:
    """The first ``n`` characters go to scoring."""
    return F.substring(_c(text), 1, n)
