"""The §7.2 views in DuckDB SQL, used to build the oracle queries.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs. Keep
every definition in step with ``scrivener.plans.views``.
"""

from __future__ import annotations

VIEWS = {
    "users": """
users AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
         CASE WHEN c_nationkey < 5 THEN 'faculty' ELSE 'student' END AS role
  FROM customer WHERE c_nationkey < 20)""",
    "base_users": """
base_users AS (
  SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
         CASE WHEN c_nationkey < 5 THEN 'faculty' ELSE 'student' END AS role
  FROM customer WHERE c_nationkey < 10)""",
    "submissions": """
submissions AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS assignment_id,
         o_orderdate AS uploaded_at
  FROM orders)""",
    "submissions_text": """
submissions_text AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS assignment_id,
         o_orderdate AS uploaded_at, d.text AS text
  FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey)""",
    "checks": """
checks AS (
  SELECT l_orderkey AS submission_id, l_discount * 10 AS internal_score,
         l_tax * 12.5 AS external_score, l_quantity / 50 AS ai_generated_probability,
         l_shipdate AS checked_at, l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax
  FROM lineitem)""",
    "event_stream": """
event_stream AS (
  SELECT event_id, ts, user_id,
         CASE event_type WHEN 'signup' THEN 'paper_uploaded'
                         WHEN 'purchase' THEN 'plagiarism_checked' ELSE event_type END AS event_type,
         CASE WHEN event_type = 'purchase' THEN least(value / 100, 1.0) END AS internal_score,
         CASE WHEN event_type = 'purchase'
              THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) / 100 END AS external_score,
         CASE WHEN event_type = 'purchase' THEN (event_id % 100) / 100 END AS ai_generated_probability,
         CASE WHEN event_type <> 'purchase' THEN NULL
              WHEN least(value / 100, 1.0) >= 0.7 THEN 'high'
              WHEN least(value / 100, 1.0) >= 0.4 THEN 'medium' ELSE 'low' END AS severity
  FROM events)""",
    "pages": """
pages AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations)""",
    "requests": """
requests AS (
  SELECT event_id, ts, 'svc' || CAST(user_id % 5 AS VARCHAR) || '-service' AS job,
         'svc' || CAST(user_id % 5 AS VARCHAR) || '-service-' || CAST(user_id % 3 AS VARCHAR) AS pod,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value / 100 AS latency_s, value
  FROM events)""",
    "user_changes": """
user_changes AS (
  SELECT o_custkey AS id,
         CASE WHEN o_orderkey % 10 = 0 THEN 'delete' WHEN o_orderkey % 10 <= 3 THEN 'insert'
              ELSE 'update' END AS op,
         strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS seq,
         'User ' || CAST(o_orderkey AS VARCHAR) AS name,
         'u' || CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey AS VARCHAR) || '@example.com' AS email,
         CASE WHEN starts_with(o_orderpriority, '1') THEN 'faculty' ELSE 'student' END AS role
  FROM orders)""",
}

# Views that are built on other views.
DEPENDS = {}


def with_views(sql: str, *names: str, extra: list[str] | None = None) -> str:
    """Prefix ``sql`` with the named view CTEs and any extra CTE strings."""
    ctes = []
    seen = set()

    def add(n):
        for dep in DEPENDS.get(n, ()):
            add(dep)
        if n not in seen:
            seen.add(n)
            ctes.append(VIEWS[n].strip())

    for n in names:
        add(n)
    ctes.extend(e.strip() for e in (extra or []))
    if not ctes:
        return sql.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + sql.strip()

VIEWS.update({
    "counter_samples": """
counter_samples AS (
  SELECT job, ts, event_id, 'http_requests_total' AS metric,
         CAST(row_number() OVER (PARTITION BY job ORDER BY ts, event_id) % 100 AS DOUBLE) AS value
  FROM requests)""",
    "pod_memory": """
pod_memory AS (
  SELECT job, pod, date_trunc('hour', ts) AS ts, max(value) * 1048576 AS value,
         'memory_working_set_bytes' AS metric
  FROM requests GROUP BY job, pod, date_trunc('hour', ts))""",
    "job_memory": """
job_memory AS (
  SELECT 'svc' || CAST(user_id % 5 AS VARCHAR) || '-service' AS job, date_trunc('hour', ts) AS ts,
         max(value) * 1048576 AS usage, CAST((300 + 50 * max(user_id % 5)) * 1048576 AS DOUBLE) AS "limit"
  FROM events GROUP BY 1, 2)""",
    "alerts": """
alerts AS (
  SELECT ts, 'HighValue' AS alertname,
         CASE WHEN v > 70 THEN 'critical' WHEN v > 50 THEN 'warning' ELSE 'info' END AS severity,
         'primary' AS cluster, job AS service, job AS instance, pod, NULL::VARCHAR AS dev,
         NULL::VARCHAR AS namespace,
         CASE job WHEN 'svc0-service' THEN 'prometheus' WHEN 'svc1-service' THEN 'loki' END AS component,
         pod || ' avg ' || printf('%.2f', v) AS description
  FROM (SELECT job, pod, date_trunc('hour', ts) AS ts, avg(value) AS v FROM requests
        GROUP BY job, pod, date_trunc('hour', ts))
  WHERE v > 30)""",
})
DEPENDS.update({"counter_samples": ("requests",), "pod_memory": ("requests",),
                "alerts": ("requests",)})
