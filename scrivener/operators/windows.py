"""Windowed analytics over the processed-event stream.

The same functions take a batch or a streaming DataFrame. Aggregates are
plain Catalyst aggregates, so Spark runs them as partial (map-side) plus
final hash aggregation: the single "global" key of the reference does not
serialise the work, and state per window is (sum, count), not a score list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.base import previous_value, running_count, trunc_time

# Event types the aggregator understands, window default.
UPLOAD = "paper_uploaded"
CHECK = "plagiarism_checked"
DEFAULT_WINDOW = "5 minutes"
# Fixed values of the legacy on-demand window: rate = n / 60, ai = 0.8 x avg,
# spike when more than 10 uploads.
LEGACY_RATE_DIVISOR = 60.0
LEGACY_AI_FACTOR = 0.8
SPIKE_THRESHOLD = 10


def window_aggs(event_type: str = "event_type", internal: str = "internal_score",
                external: str = "external_score", ai: str = "ai_generated_probability",
                severity: str = "severity") -> list[Column]:
    """Named aggregates of an analytics window (U2: the accumulator as columns).

    Unknown event types are not filtered out beforehand: a window that only
    holds them still yields an all-zero row. Missing scores count as 0.0.
    """
    et = F.col(event_type)
    is_check = et == CHECK

    def avg_check(c):
        return F.coalesce(F.avg(F.when(is_check, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))

    return [
        F.count_if(et == UPLOAD).alias("submission_count"),
        avg_check(internal).alias("avg_internal_score"),
        avg_check(external).alias("avg_external_score"),
        avg_check(ai).alias("avg_ai_probability"),
        F.count_if(is_check & (F.col(severity) == "high")).alias("high_risk_count"),
        F.count_if(is_check).alias("total_checks"),
    ]


def window_partials() -> list[Column]:
    """The metrics of ``window_aggs`` as counts and sums of some events, which
    add up over any division of the events (U2 as mergeable accumulators)."""
    is_check = F.col("event_type") == CHECK

    def total(c):
        return F.coalesce(F.sum(F.when(is_check, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0))

    return [F.count_if(F.col("event_type") == UPLOAD).alias("n_uploads"), F.count_if(is_check).alias("n_checks"),
            F.count_if(is_check & (F.col("severity") == "high")).alias("n_high"),
            total("internal_score").alias("sum_internal"), total("external_score").alias("sum_external"),
            total("ai_generated_probability").alias("sum_ai")]


PARTIALS = ("n_uploads", "n_checks", "n_high", "sum_internal", "sum_external", "sum_ai")


def add_partials() -> list[Column]:
    return [F.sum(c).alias(c) for c in PARTIALS]


def finish_partials() -> list[Column]:
    """``METRIC_COLUMNS`` of added accumulators."""
    def avg(c):
        return F.when(F.col("n_checks") > 0, F.col(c) / F.col("n_checks")).otherwise(F.lit(0.0))

    return [F.col("n_uploads").alias("submission_count"), avg("sum_internal").alias("avg_internal_score"),
            avg("sum_external").alias("avg_external_score"), avg("sum_ai").alias("avg_ai_probability"),
            F.col("n_high").alias("high_risk_count"), F.col("n_checks").alias("total_checks")]


METRIC_COLUMNS = ("submission_count", "avg_internal_score", "avg_external_score",
                  "avg_ai_probability", "high_risk_count", "total_checks")


def _window_col(time_col: str, size: str, slide: str | None, kind: str, gap: str | None) -> Column:
    if kind == "session":
        return F.session_window(time_col, gap or "30 minutes")
    if slide:
        return F.window(time_col, size, slide)
    return F.window(time_col, size)


def window_analytics(events: DataFrame, time_col: str = "ts", size: str = DEFAULT_WINDOW,
                     slide: str | None = None, kind: str = "tumbling", gap: str | None = None,
                     keys: tuple[str, ...] = (), aggs: list[Column] | None = None) -> DataFrame:
    """Per-window metrics with true window bounds.

    ``kind`` is tumbling (default), sliding (give ``slide``) or session (give
    ``gap``; per ``keys``). Empty windows produce no row. ``aggs`` replaces the
    default metrics by other named aggregates (U2).
    """
    w = _window_col(time_col, size, slide, kind, gap)
    agg = events.groupBy(w.alias("window"), *keys).agg(*(aggs or window_aggs()))
    made = METRIC_COLUMNS if aggs is None else [c for c in agg.columns if c not in ("window", *keys)]
    return agg.select(
        *keys,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *made,
    )


def sessionize(events: DataFrame, keys: tuple[str, ...], time_col: str = "ts",
               gap_seconds: int = 1800, tie: str | None = None, out: str = "session") -> DataFrame:
    """Session number per key: a new session starts when the gap to the key's
    previous event is at least ``gap_seconds``.

    Built from the bucketed lag and running count helpers, so no key is
    sorted in a single task (``session_window`` would gather a key's rows
    into one task before merging)."""
    order = [time_col] + ([tie] if tie else [])
    day = F.date_trunc("day", F.col(time_col))
    p = previous_value(events, keys, order, time_col, day, out="_prev")
    secs = (F.unix_micros(F.col(time_col).cast("timestamp"))
            - F.unix_micros(F.col("_prev").cast("timestamp"))) / 1_000_000
    flagged = p.withColumn("_new", F.col("_prev").isNull() | (secs >= gap_seconds))
    return running_count(flagged, keys, order, "_new", day, out=out).drop("_prev", "_new")


def session_analytics(events: DataFrame, keys: tuple[str, ...], time_col: str = "ts",
                      gap_seconds: int = 1800, tie: str | None = None) -> DataFrame:
    """E10 (batch): D1 metrics per session; session end = last event + gap."""
    s = sessionize(events, keys, time_col, gap_seconds, tie)
    agg = s.groupBy(*keys, "session").agg(
        F.min(time_col).alias("window_start"), F.max(time_col).alias("_last"), *window_aggs())
    return agg.select(
        *keys, "window_start",
        (F.col("_last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("window_end"),
        *METRIC_COLUMNS)


def session_partials(events: DataFrame, keys: tuple[str, ...], time_col: str = "ts",
                     gap_seconds: int = 1800, tie: str | None = None) -> DataFrame:
    """Sessions of some of the events, as accumulators: keys, first, last, partials."""
    s = sessionize(events, keys, time_col, gap_seconds, tie)
    return (s.groupBy(*keys, "session").agg(F.min(time_col).alias("first"), F.max(time_col).alias("last"),
                                            *window_partials()).drop("session"))


def merge_sessions(partials: DataFrame, keys: tuple[str, ...], gap_seconds: int = 1800) -> DataFrame:
    """Sessions that come within the gap of one another joined (gaps and islands
    over the sessions of a key, in order of their first event). What a key has
    is bounded by its time span, not by its events."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(reach.cast("timestamp"))
    island = partials.withColumn("_new", (reach.isNull() | (apart >= gap_seconds * 1_000_000)).cast("int"))
    island = island.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (island.groupBy(*keys, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                                 *add_partials()).drop("_island"))


def window_count(events: DataFrame, time_col: str = "ts", size: str = DEFAULT_WINDOW) -> DataFrame:
    """Events per tumbling window with bounds as epoch milliseconds."""
    agg = events.groupBy(F.window(time_col, size).alias("window")).agg(
        F.count(F.lit(1)).alias("event_count"))
    return agg.select(
        F.unix_millis(F.col("window.start").cast("timestamp")).alias("window_start"),
        F.unix_millis(F.col("window.end").cast("timestamp")).alias("window_end"),
        "event_count",
    )


def legacy_window(events: DataFrame, time_col: str = "ts", bucket: str = "hour",
                  spike_threshold: int = SPIKE_THRESHOLD) -> DataFrame:
    """The on-demand legacy record, one per time bucket."""
    is_check = F.col("event_type") == CHECK
    agg = events.groupBy(trunc_time(events, bucket, time_col).alias("timestamp")).agg(
        F.count_if(F.col("event_type") == UPLOAD).alias("n"),
        F.coalesce(F.avg(F.when(is_check, F.coalesce("internal_score", F.lit(0.0)))),
                   F.lit(0.0)).alias("avg_plagiarism"))
    return agg.select(
        "timestamp",
        (F.col("n") / LEGACY_RATE_DIVISOR).alias("submission_rate"),
        "avg_plagiarism",
        (F.col("avg_plagiarism") * LEGACY_AI_FACTOR).alias("avg_ai_probability"),
        (F.col("n") > spike_threshold).alias("spike_detected"),
    )


def latest_window(windows: DataFrame) -> DataFrame:
    """the newest window (empty input -> no row, the 404 case)."""
    return windows.orderBy(F.desc("window_start")).limit(1)


def window_history(windows: DataFrame, last: int | None = None) -> DataFrame:
    """all windows in time order; ``last`` shows only the newest n."""
    if last is None:
        return windows.orderBy("window_start")
    return windows.orderBy(F.desc("window_start")).limit(last).orderBy("window_start")


def newest_windows(windows: DataFrame, n: int = 10) -> DataFrame:
    """the n newest windows, newest first (faculty view)."""
    return windows.orderBy(F.desc("window_start")).limit(n)


def union_streams(*sources: DataFrame) -> DataFrame:
    """N-way union by column name; missing columns become NULL."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


# Window records as they arrive on the window topic: the Python job's shape
# (ISO bounds, metrics) or the Java job's (epoch-millis bounds, event_count).
WINDOW_RECORD_JSON = ("window_start STRING, window_end STRING, submission_count BIGINT, "
                      "avg_internal_score DOUBLE, avg_external_score DOUBLE, avg_ai_probability DOUBLE, "
                      "high_risk_count BIGINT, total_checks BIGINT, event_count BIGINT, generated_at BIGINT")


def _bound(c: Column) -> Column:
    """Epoch milliseconds or an ISO string -> TIMESTAMP_NTZ (UTC wall time)."""
    millis = F.timestamp_millis(c.cast("bigint")).cast("timestamp_ntz")
    return F.when(c.rlike(r"^[0-9]+$"), millis).otherwise(c.cast("timestamp_ntz"))


def consume_window_records(records: DataFrame, col: str = "value") -> DataFrame:
    """Decode window records; missing counts are 0 and missing averages
    0.0, so a record of the other job's shape reads as zeros (as the
    consumer of the original did) instead of failing."""
    p = F.from_json(F.col(col).cast("string"), WINDOW_RECORD_JSON)
    r = records.select(p.alias("r")).select("r.*")
    zero_l, zero_d = F.lit(0).cast("bigint"), F.lit(0.0)
    return r.select(
        _bound(F.col("window_start")).alias("window_start"),
        _bound(F.col("window_end")).alias("window_end"),
        F.coalesce("submission_count", zero_l).alias("submission_count"),
        F.coalesce("avg_internal_score", zero_d).alias("avg_internal_score"),
        F.coalesce("avg_external_score", zero_d).alias("avg_external_score"),
        F.coalesce("avg_ai_probability", zero_d).alias("avg_ai_probability"),
        F.coalesce("high_risk_count", zero_l).alias("high_risk_count"),
        F.coalesce("total_checks", zero_l).alias("total_checks"),
    )
