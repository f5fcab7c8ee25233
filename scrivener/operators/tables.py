"""Tables and joins: existence checks (C1, C2), text backfill (C3), point
lookups (B18), role filter (B19), change-log apply (G2), uniqueness (G3),
per-user ordering (F1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.operators.base import last_before, rank_desc

# How ignored changes are reported.
INSERT_OF_LIVE = "insert of a live id"
UPDATE_OF_ABSENT = "update of an absent id"
DELETE_OF_ABSENT = "delete of an absent id"


def valid_rows(df: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Rows whose user exists (left semi join on the user id).

    No broadcast hint: the user table grows with the data. AQE turns the
    join into a broadcast at runtime when the users side is small, and
    splits a skewed user_id partition otherwise.
    """
    u = users.select(F.col("id").alias(user_col))
    return df.join(u, user_col, "left_semi")


def rejected_rows(df: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Rows whose user does not exist (left anti join)."""
    u = users.select(F.col("id").alias(user_col))
    return df.join(u, user_col, "left_anti")


def backfill_text(events: DataFrame, stored: DataFrame, key: str = "submission_id",
                  text: str = "text") -> DataFrame:
    """Empty event text is taken from the stored submission; rows still
    without text are marked ``rejected``."""
    s = stored.select(F.col("id").alias(key), F.col(text).alias("_stored_text"))
    joined = events.join(s, key, "left")
    filled = F.coalesce(F.nullif(F.col(text), F.lit("")), F.nullif(F.col("_stored_text"), F.lit("")))
    return (joined.withColumn(text, filled).drop("_stored_text")
            .withColumn("status", F.when(F.col(text).isNull(), F.lit("rejected")).otherwise(F.lit("ok"))))


def backfill_length(events: DataFrame, stored: DataFrame, key: str = "submission_id",
                    length: str = "text_length") -> DataFrame:
    """C3 where only the length is wanted: ``stored`` (id, length) fills events
    whose length is missing or 0; without one they are ``rejected``. No text
    travels to the event rows."""
    s = stored.select(F.col("id").alias(key), F.col(length).alias("_stored"))
    filled = F.coalesce(F.nullif(F.col(length), F.lit(0)), F.nullif(F.col("_stored"), F.lit(0)))
    return (events.join(s, key, "left").withColumn(length, filled).drop("_stored")
            .withColumn("status", F.when(F.col(length).isNull(), F.lit("rejected")).otherwise(F.lit("ok"))))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality filter reaches the parquet/JDBC scan."""
    return df.where(F.col(key) == F.lit(value))


def eligible(df: DataFrame, users: DataFrame, role: str = "student",
             user_col: str = "user_id") -> DataFrame:
    """Rows of users holding ``role``."""
    return valid_rows(df, users.where(F.col("role") == role), user_col)


def by_user_newest_first(subs: DataFrame, user_col: str = "user_id", ts: str = "uploaded_at",
                         tie: str = "id") -> DataFrame:
    """F1 (all-users form): position of each submission in its user's
    newest-first list, ties broken by id. Ranked in (user, day) slices so a
    user with a huge history is sorted in many tasks; the per-slice counts
    that shift the positions are at most one row per user and day."""
    return rank_desc(subs, [user_col], [ts, tie], F.date_trunc("day", F.col(ts)), out="position")


def newest_first(df: DataFrame, ts: str = "uploaded_at", tie: str = "id") -> DataFrame:
    """rows newest first (ties by id), for display. A global sort, so
    use it on a filtered or limited result, not on a whole table."""
    return df.orderBy(F.desc(ts), F.desc(tie))


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id", op: str = "op",
                  seq: str = "seq") -> DataFrame:
    """Apply an insert/update/delete change log to ``base``.

    Per key, in sequence order: the row lives from the base (when never
    deleted) or from the first insert after the last delete; the newest
    update after that start replaces it whole. Inserts of a live key and
    updates of an absent key are ignored. Built from per-key aggregates
    (partial-combinable) and key joins; no per-key sorting.
    """
    payload = [c for c in base.columns if c != key]
    row = F.struct(*[F.col(c) for c in payload])
    per_key = changes.groupBy(key).agg(
        F.max(F.when(F.col(op) == "delete", F.col(seq))).alias("_last_del"),
        F.max(F.when(F.col(op) == "update", F.struct(F.col(seq).alias("s"), row.alias("r")))).alias("_upd"),
    )
    inserts = changes.where(F.col(op) == "insert").join(
        per_key.select(key, "_last_del"), key, "left")
    first_ins = (inserts.where(F.col("_last_del").isNull() | (F.col(seq) > F.col("_last_del")))
                 .groupBy(key).agg(F.min(F.struct(F.col(seq).alias("s"), row.alias("r"))).alias("_ins")))
    b = base.select(key, row.alias("_base"))
    allk = (b.join(per_key, key, "full_outer").join(first_ins, key, "full_outer"))
    start_from_base = F.col("_base").isNotNull() & F.col("_last_del").isNull()
    start_row = F.when(start_from_base, F.col("_base")).otherwise(F.col("_ins.r"))
    updated = F.col("_upd").isNotNull() & (start_from_base | (F.col("_upd.s") > F.col("_ins.s")))
    result = F.when(updated, F.col("_upd.r")).otherwise(start_row)
    return (allk.where(start_from_base | F.col("_ins").isNotNull())
            .select(key, result.alias("_r")).select(key, "_r.*"))


def history_slice(df: DataFrame, seq: str, numbers: int = 100_000) -> Column:
    """A slice of ``seq`` that keeps its order, by its type: days of times, runs
    of ``numbers`` of numbers, leading characters (compared as ``seq`` is) of
    text."""
    kind = df.schema[seq].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc("day", F.col(seq))
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(seq) / numbers)
    return F.substring(F.col(seq), 1, 8)


def change_conflicts(base: DataFrame, changes: DataFrame, key: str = "id", op: str = "op",
                     seq: str = "seq", bucket=None) -> DataFrame:
    """G2 report: changes that are not applied. A key is live before a change
    when its last insert/delete before it was an insert (or, with none, when
    the base row exists). Inserts of a live key, and updates or deletes of
    an absent key, are reported; ``bucket`` slices each key's history and must
    not decrease as ``seq`` grows (default: :func:`history_slice`)."""
    b = base.select(key, F.lit(True).alias("_base"))
    c = changes.join(b, key, "left").withColumn(
        "_state_op", F.when(F.col(op).isin("insert", "delete"), F.col(op)))
    bucket = bucket if bucket is not None else history_slice(changes, seq)
    p = last_before(c, [key], [seq], "_state_op", bucket, out="_prev_op")
    live = F.when(F.col("_prev_op").isNull(), F.coalesce("_base", F.lit(False))).otherwise(
        F.col("_prev_op") == "insert")
    conflict = (F.when((F.col(op) == "insert") & live, F.lit(INSERT_OF_LIVE))
                .when((F.col(op) == "update") & ~live, F.lit(UPDATE_OF_ABSENT))
                .when((F.col(op) == "delete") & ~live, F.lit(DELETE_OF_ABSENT)))
    return p.select(key, seq, op, conflict.alias("conflict")).where(F.col("conflict").isNotNull())


def duplicate_keys(df: DataFrame, keys: list[str], constraint: str) -> DataFrame:
    """Keys that occur more than once, as (constraint, key, n); a key of
    several columns is shown as a JSON array."""
    # grouped by the columns themselves; text is only made of what is found
    shown = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(
        F.array(*[F.col(c).cast("string") for c in keys]), {"ignoreNullFields": "false"})
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(F.lit(constraint).alias("constraint"), shown.alias("key"), "n"))
