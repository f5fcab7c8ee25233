"""Registered metric/alert queries: H1-H15, C11."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.operators import metrics as H
from scrivener.operators.base import trunc_time
from scrivener.plans import views as V
from scrivener.plans.registry import query
from scrivener.plans.sql_views import with_views

# Fixed values from the alert routing config: routes in order (first match
# wins, default receiver "default") and the two inhibition rules.
ROUTES = [({"severity": "critical"}, "critical"), ({"severity": "warning"}, "warning"),
          ({"component": "prometheus"}, "platform"), ({"component": "loki"}, "platform")]
INHIBIT_RULES = [
    {"source": {"severity": "critical"}, "target_re": {"severity": "warning"},
     "equal": ["alertname", "dev", "instance"]},
    {"source": {"alertname": "InfoInhibitor"}, "target_re": {"severity": "info|warning|critical"},
     "equal": ["namespace"]},
]
# Label selectors used on the test views.
LOG_JOBS = r"^svc[0-2]-service$"
POD_PATTERN = r"^svc[0-2]-service-"


@query("metric_rate", with_views("""
SELECT job, time_bucket(INTERVAL 5 MINUTES, ts) AS window_start,
       round(coalesce(sum(inc), 0.0) / 300, 6) AS rate
FROM (SELECT job, ts, CASE WHEN value - lag(value) OVER w < 0 THEN value
                           ELSE value - lag(value) OVER w END AS inc
      FROM counter_samples WINDOW w AS (PARTITION BY job ORDER BY ts, event_id))
GROUP BY 1, 2""", "counter_samples"))
def metric_rate(spark, d):
    """H1: reset-aware 5-minute rate of the request counter per job."""
    return H.rate(V.counter_samples(spark, d), ["job"], tie="event_id")


@query("metric_rate_range", with_views("""
SELECT job, eval_time, up * ((held + least(CASE WHEN a0 >= apart * 1.1 THEN apart / 2 ELSE a0 END,
                                           CASE WHEN up > 0 AND v0 >= 0 THEN held * (v0 / up) END)
                              + CASE WHEN a1 >= apart * 1.1 THEN apart / 2 ELSE a1 END) / held) / 300 AS rate
FROM (SELECT job, make_timestamp(e) AS eval_time, coalesce(sum(inc) FILTER (WHERE k > 1), 0.0) AS up,
             (max(us) - min(us)) / 1e6 AS held, (max(us) - min(us)) / 1e6 / (count(*) - 1) AS apart,
             (min(us) - (e - 300000000)) / 1e6 AS a0, (e - max(us)) / 1e6 AS a1,
             any_value(value) FILTER (WHERE k = 1) AS v0
      FROM (SELECT s.*, g.e, row_number() OVER (PARTITION BY s.job, g.e ORDER BY s.us, s.event_id) AS k
            FROM (SELECT job, event_id, value, epoch_us(ts) AS us,
                         CASE WHEN value - lag(value) OVER w < 0 THEN value ELSE value - lag(value) OVER w END AS inc
                  FROM counter_samples WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)) s
            JOIN (SELECT DISTINCT job, ((epoch_us(ts) + 29999999) // 30000000 + unnest(range(10))) * 30000000 AS e
                  FROM counter_samples) g
              ON s.job = g.job AND s.us > g.e - 300000000 AND s.us <= g.e)
      GROUP BY job, e HAVING max(us) > min(us))""", "counter_samples"))
def metric_rate_range(spark, d):
    """H1 as dashboards ask: 5-minute rate every 30 s, extrapolated to the range."""
    return H.rate_over_range(V.counter_samples(spark, d), ["job"], tie="event_id")


@query("error_rate", with_views("""
SELECT job, time_bucket(INTERVAL 5 MINUTES, ts) AS window_start,
       round(count(*) FILTER (WHERE regexp_matches(CAST(status AS VARCHAR), '^5..$')) / 300, 6) AS error_rate,
       count(*) FILTER (WHERE regexp_matches(CAST(status AS VARCHAR), '^5..$')) / 300 > 0.05 AS breach
FROM requests GROUP BY 1, 2""", "requests"))
def error_rate(spark, d):
    """H2: 5xx rate per job in 5-minute windows with the 0.05/s alert flag."""
    return H.error_rate(V.requests(spark, d), ["job"])


def _p95_sql(window="1 HOUR"):
    bounds = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
    cums = ",\n       ".join(f"count(*) FILTER (WHERE latency_s <= {b}) AS c{i}" for i, b in enumerate(bounds))
    parts, pb, pc = [], "0.0", "0"
    for i, b in enumerate(bounds):
        parts.append(f"WHEN c{i} >= 0.95 * total THEN {pb} + ({b} - {pb}) * (0.95 * total - {pc}) / (c{i} - {pc})")
        pb, pc = str(b), f"c{i}"
    case = "CASE " + " ".join(parts) + " ELSE 5.0 END"
    return with_views(f"""
SELECT job, window_start, round({case}, 6) AS quantile
FROM (SELECT job, time_bucket(INTERVAL {window}, ts) AS window_start,
       {cums}, count(*) AS total
      FROM requests GROUP BY 1, 2)""", "requests")


@query("latency_p95", _p95_sql())
def latency_p95(spark, d):
    """H3: hourly p95 latency per job from cumulative histogram buckets."""
    return H.histogram_quantile(V.requests(spark, d), ["job"])


@query("latency_p95_raw", with_views("""
SELECT job, window_start, min(latency_s) AS quantile, max(n) AS n FROM (
  SELECT job, window_start, latency_s, sum(c) OVER (PARTITION BY job, window_start ORDER BY latency_s) AS running,
         CAST(sum(c) OVER (PARTITION BY job, window_start) AS BIGINT) AS n
  FROM (SELECT job, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, latency_s, count(*) AS c
        FROM requests GROUP BY 1, 2, 3))
WHERE running >= 0.95 * n GROUP BY 1, 2""", "requests"))
def latency_p95_raw(spark, d):
    """H3 (raw form): hourly p95 latency per job from the raw values, exact."""
    return H.quantile_exact(V.requests(spark, d), ["job"])


@query("latency_p95_sketch", with_views("""
SELECT job, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, true AS within
FROM requests WHERE latency_s IS NOT NULL GROUP BY 1, 2""", "requests"))
def latency_p95_sketch(spark, d):
    """H3, mergeable: hourly p95 per job from stored 5-minute sketches; the rank of
    each estimate among the raw values is within two in a hundred of 0.95."""
    r = V.requests(spark, d)
    est = H.sketch_quantile(H.quantile_sketches(r, ["job"]), ["job"])
    hour = F.window("ts", "1 hour").getField("start").alias("window_start")
    at = r.select("job", hour, "latency_s").join(est, ["job", "window_start"]).groupBy("job", "window_start", "n").agg(
        F.count_if(F.col("latency_s") < F.col("quantile")).alias("below"),
        F.count_if(F.col("latency_s") <= F.col("quantile")).alias("upto"))
    n = F.col("n")
    return at.select("job", "window_start", "n", ((F.col("below") <= (H.QUANTILE + 0.02) * n)
                                                  & (F.col("upto") >= (H.QUANTILE - 0.02) * n)).alias("within"))


@query("latency_p95_buckets", _p95_sql("5 MINUTES"))
def latency_p95_buckets(spark, d):
    """H3 over bucket series: per pod and ``le`` the rate of the cumulative
    bucket over 5 minutes, summed by job, p95 interpolated."""
    bounds = [*map(str, H.LATENCY_BUCKETS), "+Inf"]
    r = V.requests(spark, d).select("job", "pod", "ts", F.explode(F.transform(
        F.array(*map(F.lit, bounds)), lambda b: F.struct(
            b.alias("le"), ((b == "+Inf") | (F.col("latency_s") <= b.try_cast("double"))).cast("int").alias("hit")))).alias("x"))
    rates = r.groupBy("job", "pod", F.window("ts", "5 minutes").getField("start").alias("window_start"),
                      F.col("x.le").alias("le")).agg((F.sum("x.hit") / H.RATE_WINDOW_SECONDS).alias("rate"))
    return H.bucket_quantile(rates, ["job", "window_start"])


@query("memory_gib", with_views(f"""
SELECT job, pod, ts, round(value / 1073741824, 6) AS gib FROM pod_memory
WHERE regexp_matches(pod, '{POD_PATTERN}')""", "pod_memory"))
def memory_gib(spark, d):
    """Memory of the selected pods in GiB."""
    g = H.to_gib(V.pod_memory(spark, d), pattern=POD_PATTERN)
    return g.select("job", "pod", "ts", F.col("value").alias("gib"))


@query("series_counts", with_views("""
SELECT job, count(*) AS n_series, count(*) FILTER (WHERE value > 419430400) AS n_high,
       count(*) FILTER (WHERE ts = (SELECT max(ts) FROM pod_memory)) AS n_current
FROM (SELECT *, row_number() OVER (PARTITION BY job, pod ORDER BY ts DESC) AS rn FROM pod_memory)
WHERE rn = 1 GROUP BY job""", "pod_memory"))
def series_counts(spark, d):
    """H5: pods per job, pods whose newest sample is high, pods reporting now."""
    return H.series_counts(V.pod_memory(spark, d), ["job", "pod"], ["job"], high=400 * V.MIB)


@query("sum_by_label", with_views("""
SELECT job, window_start, round(sum(r), 6) AS rate FROM (
  SELECT job, pod, time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, count(*) / 300 AS r
  FROM requests GROUP BY 1, 2, 3) GROUP BY 1, 2""", "requests"))
def sum_by_label(spark, d):
    """H6: per-pod request rates summed by job."""
    per_pod = V.requests(spark, d).groupBy("job", "pod", F.window("ts", "5 minutes").alias("w")).agg(
        (F.count(F.lit(1)) / 300).alias("r")).select("job", "pod", F.col("w.start").alias("window_start"), "r")
    return H.sum_by(per_pod, ["job", "window_start"], "r", out="rate")


@query("alert_for", with_views("""
SELECT job, ts, round(v, 6) AS v, since FROM (
  SELECT *, min(ts) OVER (PARTITION BY job, grp) AS since FROM (
    SELECT *, step - row_number() OVER (PARTITION BY job ORDER BY step) AS grp FROM (
      SELECT *, CAST(epoch(ts) / 3600 AS BIGINT) AS step FROM (
        SELECT job, date_trunc('hour', ts) AS ts, avg(value) AS v FROM requests GROUP BY 1, 2)
      WHERE v > 50)))
WHERE epoch(ts) - epoch(since) >= 7200""", "requests"))
def alert_for(spark, d):
    """H7/H9: hourly average above 50 sustained for 2 hours fires."""
    r = V.requests(spark, d)
    flags = r.groupBy("job", trunc_time(r, "hour", "ts").alias("ts")).agg(
        F.avg("value").alias("v")).withColumn("breach", F.col("v") > 50)
    s = H.sustained(flags, ["job"], "ts", "breach", 3600, 7200)
    return s.select("job", "ts", "v", "since")


@query("value_changes", with_views("""
SELECT c.job, c.ts, c.changes, round(c.restart_rate, 6) AS restart_rate,
       c.changes > 2 AND coalesce(p1.changes > 2, false) AS changes_alert,
       c.restart_rate > 5 AND coalesce(p1.restart_rate > 5, false) AND coalesce(p2.restart_rate > 5, false) AS restart_alert
FROM evals c LEFT JOIN evals p1 ON p1.job = c.job AND p1.ts = c.ts - INTERVAL 5 MINUTES
     LEFT JOIN evals p2 ON p2.job = c.job AND p2.ts = c.ts - INTERVAL 10 MINUTES""", "counter_samples", extra=["""
evals AS (
  WITH s AS (SELECT job, ts, value, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM counter_samples
             WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)),
  e AS (SELECT DISTINCT job, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES * (o.k + 1) AS upto
        FROM s, range(12) o(k))
  SELECT e.job, e.upto AS ts,
         count(*) FILTER (WHERE s.ts >= upto - INTERVAL 15 MINUTES AND s.pt >= upto - INTERVAL 15 MINUTES
                          AND s.value <> s.pv) AS changes,
         coalesce(sum(CASE WHEN s.value < s.pv THEN s.value ELSE s.value - s.pv END), 0) / 3600 AS restart_rate
  FROM e JOIN s ON s.job = e.job AND s.ts >= e.upto - INTERVAL 1 HOUR AND s.ts < e.upto GROUP BY 1, 2)"""]))
def value_changes(spark, d):
    """Changes over 15 minutes (alert above 2 for 5 minutes) and the
    restart rate over an hour (alert above 5 a second for 10 minutes)."""
    return H.restart_rules(V.counter_samples(spark, d), ["job"], tie="event_id")


@query("ratio_alerts", with_views("""
SELECT c.job, c.ts, round(c.r, 6) AS ratio, c.r > 0.9 AND coalesce(p.r > 0.9, false) AS memory_alert,
       c.r > 0.85 AND coalesce(p.r > 0.85, false) AS volume_alert
FROM (SELECT job, ts, usage / "limit" AS r FROM job_memory) c
LEFT JOIN (SELECT job, ts, usage / "limit" AS r FROM job_memory) p
  ON p.job = c.job AND p.ts = c.ts - INTERVAL 1 HOUR""", "job_memory"))
def ratio_alerts(spark, d):
    """H8: usage over limit above 0.9 (memory) and 0.85 (volume), each held for
    the rule's time, which on hourly samples is one step more."""
    m = V.job_memory(spark, d)
    r = m.select("job", "ts", (F.col("usage") / F.col("limit")).alias("ratio"))
    r = r.withColumns({"_step": F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600),
                       "_m": F.col("ratio") > H.MEMORY_RATIO_THRESHOLD,
                       "_v": F.col("ratio") > H.VOLUME_RATIO_THRESHOLD})
    r = H.held(r, ["job"], "_step", "_m", 1, "memory_alert")
    return H.held(r, ["job"], "_step", "_v", 1, "volume_alert").select(
        "job", "ts", "ratio", "memory_alert", "volume_alert")


@query("alert_groups", with_views("""
SELECT ts, alertname, cluster, service, count(*) AS n_alerts,
       string_agg(description, '; ' ORDER BY description) AS descriptions
FROM alerts GROUP BY ts, alertname, cluster, service""", "alerts"))
def alert_groups(spark, d):
    """Alerts grouped by (alertname, cluster, service) per evaluation."""
    return H.group_alerts(V.alerts(spark, d), ["ts", "alertname", "cluster", "service"])


@query("alert_routes", with_views("""
SELECT ts, alertname, severity, pod, component,
       CASE WHEN severity = 'critical' THEN 'critical' WHEN severity = 'warning' THEN 'warning'
            WHEN component = 'prometheus' THEN 'platform' WHEN component = 'loki' THEN 'platform'
            ELSE 'default' END AS receiver
FROM alerts""", "alerts"))
def alert_routes(spark, d):
    """Receiver of each alert, first matching route wins."""
    a = V.alerts(spark, d)
    return a.select("ts", "alertname", "severity", "pod", "component",
                    H.route(ROUTES, "default").alias("receiver"))


@query("alert_inhibit", with_views("""
SELECT ts, alertname, severity, instance, pod FROM alerts a
WHERE NOT (a.severity = 'warning' AND EXISTS (
        SELECT 1 FROM alerts c WHERE c.severity = 'critical' AND c.ts = a.ts
          AND c.alertname IS NOT DISTINCT FROM a.alertname AND c.dev IS NOT DISTINCT FROM a.dev
          AND c.instance IS NOT DISTINCT FROM a.instance))
  AND NOT (a.severity IN ('info', 'warning', 'critical') AND EXISTS (
        SELECT 1 FROM alerts c WHERE c.alertname = 'InfoInhibitor' AND c.ts = a.ts
          AND c.namespace IS NOT DISTINCT FROM a.namespace))""", "alerts"))
def alert_inhibit(spark, d):
    """Warnings inhibited by a critical alert with equal labels."""
    out = H.inhibit(V.alerts(spark, d), INHIBIT_RULES)
    return out.select("ts", "alertname", "severity", "instance", "pod")


@query("select_logs", with_views(f"""
SELECT event_id, ts, job, pod, status FROM requests WHERE regexp_matches(job, '{LOG_JOBS}')""",
                                  "requests"))
def select_logs(spark, d):
    """Log lines of the jobs matching a regex selector."""
    r = V.requests(spark, d)
    return r.where(F.col("job").rlike(LOG_JOBS)).select("event_id", "ts", "job", "pod", "status")


@query("reject_old", with_views("""
SELECT event_id, ts, ts >= (SELECT max(ts) FROM requests) - INTERVAL 168 HOURS AS accepted
FROM requests""", "requests"))
def reject_old(spark, d):
    """Samples older than 168 h before the newest are rejected."""
    return H.reject_old(V.requests(spark, d).select("event_id", "ts"))


@query("metric_ratio", with_views("""
SELECT job, ts, usage, "limit", round(usage / "limit", 6) AS ratio, usage / "limit" > 0.9 AS breach
FROM job_memory""", "job_memory"))
def metric_ratio(spark, d):
    """C11/H8: memory usage over limit per job and hour, alert above 0.9."""
    m = V.job_memory(spark, d)
    return H.ratio(m.select("job", "ts", "usage"), m.select("job", "ts", "limit"),
                   ["job", "ts"], "usage", "limit", threshold=H.MEMORY_RATIO_THRESHOLD)


@query("state_alerts", with_views("""
SELECT pod, ts, since FROM (
  SELECT *, min(ts) OVER (PARTITION BY pod, grp) AS since FROM (
    SELECT *, step - row_number() OVER (PARTITION BY pod ORDER BY step) AS grp FROM (
      SELECT *, CAST(epoch(ts) / 3600 AS BIGINT) AS step FROM (
        SELECT pod, date_trunc('hour', ts) AS ts,
               CASE WHEN count(*) FILTER (WHERE status = 200) > 0 THEN 1 ELSE 0 END AS up
        FROM requests GROUP BY 1, 2)
      WHERE up = 0)))
WHERE epoch(ts) - epoch(since) >= 3600""", "requests"))
def state_alerts(spark, d):
    """H9: boolean-state rule ``up == 0`` held for an hour, per pod (a pod
    is up in an hour when it answered any request without error)."""
    r = V.requests(spark, d)
    up = r.groupBy("pod", trunc_time(r, "hour", "ts").alias("ts")).agg(
        F.when(F.count_if(F.col("status") == 200) > 0, F.lit(1)).otherwise(F.lit(0)).alias("up"))
    s = H.sustained(up.withColumn("breach", F.col("up") == 0), ["pod"], "ts", "breach", 3600, 3600)
    return s.select("pod", "ts", "since")


@query("metric_rate_sliding", with_views("""
SELECT job, window_start, round(coalesce(sum(inc), 0.0) / 300, 6) AS rate
FROM (SELECT job, time_bucket(INTERVAL 30 SECONDS, ts) - INTERVAL 30 SECONDS * o.k AS window_start, inc
      FROM (SELECT job, ts, CASE WHEN value - lag(value) OVER w < 0 THEN value
                                 ELSE value - lag(value) OVER w END AS inc
            FROM counter_samples WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)) s,
           range(10) o(k))
GROUP BY 1, 2""", "counter_samples"))
def metric_rate_sliding(spark, d):
    """H1 (rule form): 5-minute rate re-evaluated every 30 seconds."""
    return H.rate(V.counter_samples(spark, d), ["job"], tie="event_id", slide="30 seconds")
