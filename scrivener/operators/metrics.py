"""Metric rollups and alert rules (H1-H15, C11) over sample tables
``(ts, series labels..., value)`` or raw request events.

The dashboard and rule queries become batch (or streaming) Spark jobs.
Per-series lags use bucketed windows (``previous_value``) so a series holding
a third of all samples is still spread over many tasks; everything else is a
partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.base import previous_value

# Fixed values from the rule files: latency histogram bounds (seconds),
# quantile, error status pattern and error-rate threshold, rate window.
LATENCY_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0)   # plus +Inf
QUANTILE = 0.95
SKETCH_K = 800              # of the quantile sketches, see quantile_sketches
ERROR_STATUS = r"^5..$"
ERROR_RATE_THRESHOLD = 0.05
RATE_WINDOW_SECONDS = 300
MEMORY_RATIO_THRESHOLD = 0.9
VOLUME_RATIO_THRESHOLD = 0.85
GIB = 1024 ** 3


def counter_increase(samples: DataFrame, series: list[str], ts: str = "ts",
                     value: str = "value", tie: str | None = None) -> DataFrame:
    """H1: reset-aware increase per sample: v - previous v, or v after a reset."""
    order = [ts] + ([tie] if tie else [])
    p = previous_value(samples, series, order, value, F.date_trunc("day", F.col(ts)))
    delta = F.col(value) - F.col("prev")
    return p.withColumn("increase", F.when(delta < 0, F.col(value)).otherwise(delta))


def rate(samples: DataFrame, series: list[str], window: str = "5 minutes", ts: str = "ts",
         value: str = "value", tie: str | None = None, seconds: int = RATE_WINDOW_SECONDS,
         slide: str | None = None) -> DataFrame:
    """H1: per-series rate = summed increase in the window / window seconds
    (no extrapolation). ``slide`` gives the sliding form (rules evaluate
    every 30 s); it must divide the window."""
    inc = counter_increase(samples, series, ts, value, tie)
    if slide:
        # panes of one slide first: they are copied to their windows, not the samples
        inc = inc.groupBy(*series, F.window(ts, slide).getField("start").alias(ts)).agg(
            F.sum("increase").alias("increase"))
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return inc.groupBy(*series, w.alias("w")).agg(
        (F.coalesce(F.sum("increase"), F.lit(0.0)) / seconds).alias("rate")).select(
        *series, F.col("w.start").alias("window_start"), "rate")


def rate_over_range(samples: DataFrame, series: list[str], range_seconds: int = RATE_WINDOW_SECONDS,
                    step_seconds: int = 30, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """H1 as dashboards evaluate it: (series, eval_time, rate), the per-second
    increase over the samples in (eval_time - range, eval_time] at every step,
    extrapolated to the ends of the range.

    The increase from the first to the last sample of a range (resets taken as
    starts from 0) is stretched to the range's ends where these are less than 1.1
    mean sample distances away, else by half a distance; never to before the
    counter's zero. Ranges with fewer than two sample times give no row; the range
    must be a multiple of the step.

    Samples are first cut to panes of one step (count, first, last, increase); the
    panes, not the samples, are copied to the ranges they are in, and both
    aggregates are combined map-side."""
    if range_seconds % step_seconds:
        raise ValueError(f"a range of {range_seconds} s is no multiple of a step of {step_seconds} s")
    step, span = step_seconds * 1_000_000, range_seconds * 1_000_000
    inc = counter_increase(samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull()), series, ts, value, tie)
    inc = inc.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_inc", F.coalesce("increase", F.lit(0.0)))
    at = F.struct("_us", *([tie] if tie else []), F.col(value).alias("v"), F.col("_inc").alias("inc"))
    panes = inc.groupBy(*series, (F.col("_us") + F.pmod(-F.col("_us"), F.lit(step))).alias("_end")).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.sum("_inc").alias("inc"))
    ends = F.explode(F.sequence("_end", F.col("_end") + (span - step), F.lit(step).cast("bigint")))
    w = panes.withColumn("_end", ends).groupBy(*series, "_end").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("inc").alias("inc"))
    # what the first sample rose by happened before it
    w = w.withColumns({"up": F.col("inc") - F.col("first.inc"),
                       "held": (F.col("last._us") - F.col("first._us")) / 1e6}).where(F.col("held") > 0)
    apart = F.col("held") / (F.col("n") - 1)
    before = (F.col("first._us") - (F.col("_end") - span)) / 1e6
    after = (F.col("_end") - F.col("last._us")) / 1e6
    before = F.when(before >= apart * 1.1, apart / 2).otherwise(before)
    to_zero = F.when((F.col("up") > 0) & (F.col("first.v") >= 0), F.col("held") * (F.col("first.v") / F.col("up")))
    before = F.least(before, to_zero)                       # least skips a null
    after = F.when(after >= apart * 1.1, apart / 2).otherwise(after)
    end = F.timestamp_micros("_end").cast(samples.schema[ts].dataType)
    return w.select(*series, end.alias("eval_time"),
                    (F.col("up") * ((F.col("held") + before + after) / F.col("held")) / range_seconds).alias("rate"))


def error_rate(requests: DataFrame, by: list[str], window: str = "5 minutes",
               status: str = "status", ts: str = "ts", seconds: int = RATE_WINDOW_SECONDS,
               threshold: float = ERROR_RATE_THRESHOLD) -> DataFrame:
    """H2: 5xx responses per second in each window and the alert flag."""
    is_err = F.col(status).cast("string").rlike(ERROR_STATUS)
    agg = requests.groupBy(*by, F.window(ts, window).alias("w")).agg(
        (F.count_if(is_err) / seconds).alias("error_rate"))
    return agg.select(*by, F.col("w.start").alias("window_start"), "error_rate",
                      (F.col("error_rate") > threshold).alias("breach"))


def histogram_quantile(requests: DataFrame, by: list[str], value: str = "latency_s",
                       window: str = "1 hour", ts: str = "ts", q: float = QUANTILE,
                       bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """H3: quantile from cumulative histogram buckets with linear
    interpolation inside the bucket (lower edge 0 for the first bucket);
    a rank in the +Inf bucket returns the largest finite bound.

    Bucket counts are one partial aggregate (count_if per bound)."""
    cums = [F.count_if(F.col(value) <= b).alias(f"_c{i}") for i, b in enumerate(bounds)]
    agg = requests.groupBy(*by, F.window(ts, window).alias("w")).agg(
        *cums, F.count(F.lit(1)).alias("_total"))
    rank = F.lit(q) * F.col("_total")
    expr = None
    prev_b, prev_c = F.lit(0.0), F.lit(0)
    for i, b in enumerate(bounds):
        c = F.col(f"_c{i}")
        interp = prev_b + (F.lit(b) - prev_b) * (rank - prev_c) / (c - prev_c)
        expr = F.when(c >= rank, interp) if expr is None else expr.when(c >= rank, interp)
        prev_b, prev_c = F.lit(b), c
    expr = expr.otherwise(F.lit(bounds[-1]))
    return agg.select(*by, F.col("w.start").alias("window_start"), expr.alias("quantile"))


def bucket_quantile(rates: DataFrame, by: list[str], le: str = "le", rate_col: str = "rate",
                    q: float = QUANTILE) -> DataFrame:
    """H3 over bucket series: ``rates`` has, per ``by`` (labels and evaluation
    time) and upper bound ``le`` (text, "+Inf" the last), the rate of the
    cumulative bucket; rates of several series with the same labels add up.
    Linear interpolation in the bucket that holds the rank; in the +Inf bucket
    the largest finite bound; NULL where there is no +Inf bucket or no sample."""
    summed = rates.groupBy(*by, F.when(F.lower(le).isin("+inf", "inf"), F.lit(float("inf")))
                           .otherwise(F.col(le).cast("double")).alias("_le")).agg(F.sum(rate_col).alias("_r"))
    # one short array per group: a histogram has a handful of buckets
    arr = summed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_le", "_r"))).alias("_b"))
    total = F.element_at("_b", -1)
    i = F.array_position(F.transform("_b", lambda x: x["_r"] >= F.lit(q) * total["_r"]), True).cast("int") - 1
    out = arr.withColumn("_i", i)
    here, below = F.get("_b", F.col("_i")), F.get("_b", F.col("_i") - 1)
    lo_b, lo_r = F.coalesce(below["_le"], F.lit(0.0)), F.coalesce(below["_r"], F.lit(0.0))
    value = (F.when((total["_le"] != float("inf")) | (total["_r"] <= 0), F.lit(None).cast("double"))
             .when(here["_le"] == float("inf"), below["_le"])
             .otherwise(lo_b + (here["_le"] - lo_b) * (F.lit(q) * total["_r"] - lo_r) / (here["_r"] - lo_r)))
    return out.select(*by, value.alias("quantile"))


def quantile_exact(requests: DataFrame, by: list[str], value: str = "latency_s",
                   window: str = "1 hour", ts: str = "ts", q: float = QUANTILE) -> DataFrame:
    """H3 (raw form): the smallest value that a share ``q`` of the group's values
    do not exceed, from counts per distinct value (combined map-side) and their
    running sum, which spills instead of being held as one buffer."""
    counts = requests.groupBy(*by, F.window(ts, window).getField("start").alias("window_start"),
                              F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by, "window_start")
    running = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_c", F.sum("_n").over(running)).withColumn("n", F.sum("_n").over(group))
    return ranked.where(F.col("_c") >= F.lit(q) * F.col("n")).groupBy(*by, "window_start").agg(
        F.min("_v").alias("quantile"), F.max("n").alias("n"))


def quantile_sketches(requests: DataFrame, by: list[str], value: str = "latency_s", pane: str = "5 minutes",
                      ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """H3, mergeable: (by, window_start, sketch), a KLL sketch of the values of each
    pane. A sketch holds a few times ``k`` values whatever its pane holds; they are
    combined map-side, can be stored, and merge over any range. Null values and
    times are left out."""
    return requests.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(
        *by, F.window(ts, pane).getField("start").alias("window_start")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def sketch_quantile(sketches: DataFrame, by: list[str], window: str = "1 hour", q: float = QUANTILE) -> DataFrame:
    """Quantile of each ``window`` from the sketches of its panes:
    (by, window_start, quantile, n). About a share 1.5 / k of the values may lie
    between it and the exact one (``quantile_exact``)."""
    merged = sketches.groupBy(*by, F.window("window_start", window).getField("start").alias("window_start")).agg(
        F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, "window_start",
                         F.kll_sketch_get_quantile_double("_s", F.lit(q).cast("double")).alias("quantile"),
                         F.kll_sketch_get_n_double("_s").alias("n"))


def to_gib(samples: DataFrame, value: str = "value", label: str = "pod",
           pattern: str | None = None) -> DataFrame:
    """Bytes -> GiB for series whose label matches ``pattern``."""
    s = samples.where(F.col(label).rlike(pattern)) if pattern else samples
    return s.withColumn(value, F.col(value) / GIB)


def latest_per_series(samples: DataFrame, series: list[str], ts: str = "ts",
                      value: str = "value") -> DataFrame:
    """Newest sample of every series (max of (ts, value), a partial aggregate)."""
    return samples.groupBy(*series).agg(
        F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))).alias("_l")).select(
        *series, F.col("_l.ts").alias("ts"), F.col("_l.value").alias("value"))


def series_counts(samples: DataFrame, series: list[str], by: list[str], high: float,
                  ts: str = "ts", value: str = "value") -> DataFrame:
    """H5: per group: number of series, series whose newest value is above
    ``high`` and series reporting at the newest timestamp of all data."""
    latest = latest_per_series(samples, series, ts, value)
    newest = samples.agg(F.max(ts)).scalar()        # scalar subquery, run once
    j = latest.withColumn("_max", newest)
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col("value") > high).alias("n_high"),
        F.count_if(F.col("ts") == F.col("_max")).alias("n_current"))


def sum_by(df: DataFrame, labels: list[str], value: str, out: str | None = None) -> DataFrame:
    """H6: ``sum by (labels)``."""
    return df.groupBy(*labels).agg(F.sum(value).alias(out or value))


def sustained(flags: DataFrame, series: list[str], ts: str, breach: str, step_seconds: int,
              for_seconds: int) -> DataFrame:
    """H7: rows where ``breach`` has held at every evaluation step for at least
    ``for_seconds`` (gaps-and-islands: a missing or non-breach step ends an
    island). ``flags`` has one row per series and evaluation time; it is an
    aggregate, so one series' rows are few."""
    step = (F.unix_seconds(F.col(ts).cast("timestamp")) / step_seconds).cast("bigint")
    b = flags.where(F.col(breach)).withColumn("_step", step)
    w = Window.partitionBy(*series).orderBy("_step")
    isl = b.withColumn("_grp", F.col("_step") - F.row_number().over(w))
    start = Window.partitionBy(*series, "_grp")
    out = isl.withColumn("since", F.min(ts).over(start))
    held = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp"))
    return out.where(held >= for_seconds).drop("_step", "_grp")


def held(flags: DataFrame, series: list[str], step: str, breach: str, steps: int, out: str) -> DataFrame:
    """H7/H8 ``for``: ``out`` is true where ``breach`` holds at this evaluation
    step and at the ``steps`` before it. Every breach is counted towards the
    steps it supports, so no series is sorted in one task."""
    votes = (flags.where(F.col(breach)).select(*series, F.explode(F.sequence(
        F.col(step), F.col(step) + steps)).alias(step)).groupBy(*series, step).agg(F.count(F.lit(1)).alias("_votes")))
    return (flags.join(votes, [*series, step], "left")
            .withColumn(out, F.coalesce(F.col(breach) & (F.col("_votes") > steps), F.lit(False))).drop("_votes"))


# Fixed values of the restart rules: changes over 15 minutes above 2 for 5
# minutes; restarts a second over 1 hour above 5 for 10 minutes.
CHANGES_MINUTES, CHANGES_ABOVE, CHANGES_FOR = 15, 2, 5
RESTART_MINUTES, RESTART_ABOVE, RESTART_FOR = 60, 5, 10
EVALUATION_MINUTES = 5


def restart_rules(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value",
                  tie: str | None = None) -> DataFrame:
    """Per series and evaluation time (every 5 minutes), ``changes`` of the
    value within the last 15 minutes, ``restart_rate`` (reset-aware increase a
    second over the last hour) and the two alerts with their ``for`` times.

    Samples are aggregated to 5-minute panes first; panes are then added to the
    evaluations they belong to. A change counts if both its samples are in the
    range, so panes keep changes by how many panes back the earlier sample is."""
    order = [ts] + ([tie] if tie else [])
    pane = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (60 * EVALUATION_MINUTES))
    both = samples.withColumn("_s", F.struct(F.col(value).alias("v"), pane.alias("p")))
    p = previous_value(both, series, order, "_s", F.date_trunc("day", F.col(ts)))
    now, before = F.col("_s.v"), F.col("prev.v")
    back = F.col("_s.p") - F.col("prev.p")
    n = CHANGES_MINUTES // EVALUATION_MINUTES
    panes = p.groupBy(*series, F.col("_s.p").alias("_p")).agg(
        F.array(*[F.count_if((now != before) & (back <= n - 1 - i)) for i in range(n)]).alias("_c"),
        F.sum(F.when(now < before, now).otherwise(now - before)).alias("_inc"))
    ranges = RESTART_MINUTES // EVALUATION_MINUTES
    steps = (panes.select("*", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_o"))
             .groupBy(*series, (F.col("_p") + F.col("_o") + 1).alias("_step")).agg(
                 F.sum(F.coalesce(F.get("_c", F.col("_o")), F.lit(0))).alias("changes"),
                 (F.coalesce(F.sum("_inc"), F.lit(0.0)) / (60 * RESTART_MINUTES)).alias("restart_rate")))
    flags = steps.withColumns({"_many": F.col("changes") > CHANGES_ABOVE,
                               "_fast": F.col("restart_rate") > RESTART_ABOVE})
    flags = held(flags, series, "_step", "_many", CHANGES_FOR // EVALUATION_MINUTES, "changes_alert")
    flags = held(flags, series, "_step", "_fast", RESTART_FOR // EVALUATION_MINUTES, "restart_alert")
    at = F.timestamp_seconds(F.col("_step") * 60 * EVALUATION_MINUTES).cast("timestamp_ntz")
    return flags.select(*series, at.alias("ts"), "changes", "restart_rate", "changes_alert", "restart_alert")


def group_alerts(alerts: DataFrame, group_by: list[str], text: str = "description",
                 sep: str = "; ") -> DataFrame:
    """Alerts firing together, grouped by labels, texts concatenated in
    sorted order. Groups are per evaluation time, so bounded by the number
    of alerting series."""
    return alerts.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.array_join(F.array_sort(F.collect_list(text)), sep).alias("descriptions"))


def route(routes: list[tuple[dict[str, str], str]], default: str) -> Column:
    """Receiver of the first route whose label matchers all equal."""
    expr = None
    for match, receiver in routes:
        cond = None
        for k, v in match.items():
            c = F.col(k) == v
            cond = c if cond is None else cond & c
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, F.lit(receiver)) if expr is None else expr.when(cond, F.lit(receiver))
    return expr.otherwise(F.lit(default))


def inhibit(alerts: DataFrame, rules: list[dict], at: str = "ts") -> DataFrame:
    """Drop target alerts for which a source alert with equal labels
    (null-safe; missing labels count as equal) fires at the same time.

    A rule is ``{"source": {label: value}, "target_re": {label: regex},
    "equal": [labels]}``. Each rule's sources are reduced to their distinct
    label tuples and left-joined once to mark inhibited rows; the alerts are
    read once plus once per rule's source set.
    """
    def all_of(conds):
        out = None
        for c in conds:
            out = c if out is None else out & c
        return out

    out = alerts
    marks = []
    for i, r in enumerate(rules):
        labels = r["equal"] + [at]
        src_cond = all_of([F.col(k) == v for k, v in r["source"].items()])
        src = (alerts.where(src_cond).select(*[F.col(c).alias(f"_s{i}_{c}") for c in labels])
               .distinct().withColumn(f"_hit{i}", F.lit(True)))
        cond = all_of([F.col(c).eqNullSafe(F.col(f"_s{i}_{c}")) for c in labels])
        out = out.join(src, cond, "left").drop(*[f"_s{i}_{c}" for c in labels])
        tgt = all_of([F.coalesce(F.col(k).rlike(f"^(?:{v})$"), F.lit(False))
                      for k, v in r["target_re"].items()])
        marks.append(tgt & F.col(f"_hit{i}").isNotNull())
    inhibited = None
    for m in marks:                      # marks are never NULL
        inhibited = m if inhibited is None else inhibited | m
    kept = out.where(~inhibited) if marks else out
    return kept.drop(*[f"_hit{i}" for i in range(len(rules))])


def ratio(num: DataFrame, den: DataFrame, on: list[str], num_col: str, den_col: str,
          threshold: float | None = None) -> DataFrame:
    """C11/H8: one metric over another, matched on labels and time."""
    j = num.select(*on, num_col).join(den.select(*on, den_col), on)
    r = j.withColumn("ratio", F.col(num_col) / F.col(den_col))
    if threshold is not None:
        r = r.withColumn("breach", F.col("ratio") > threshold)
    return r


def reject_old(df: DataFrame, ts: str = "ts", max_age: str = "168 hours") -> DataFrame:
    """Flag samples older than ``max_age`` before the newest sample."""
    newest = df.agg(F.max(ts)).scalar()             # scalar subquery, run once
    return df.withColumn("accepted", F.col(ts) >= newest - F.expr(f"INTERVAL {max_age}"))
