"""Registered similarity queries: C8, C9, C10."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.operators import similarity as SIM
from scrivener.plans.registry import query
from scrivener.sources.tables import read_table


def _toks_cte(name: str, table: str, id_col: str) -> str:
    """Lower-cased words per row of ``table`` (DuckDB)."""
    return f"""{name}_toks AS (
  SELECT {id_col} AS doc_id,
         list_filter(string_split_regex(lower(trim(coalesce(text, ''))), '\\s+'), lambda w: w <> '') AS w
  FROM {table})"""


def _grams_cte(name: str, table: str, id_col: str) -> str:
    """Distinct word 5-grams per row of ``table`` (DuckDB)."""
    return f"""
{_toks_cte(name, table, id_col)},
{name} AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i
        FROM {name}_toks WHERE len(w) >= 5))"""


GRAMS = _grams_cte("grams", "documents", "doc_id")
BENCH_GRAMS = _grams_cte("bgrams", "benchmark", "item_id")

INTERNAL_SQL = f"""
WITH {GRAMS.strip()},
df AS (SELECT s, count(*) AS c FROM grams GROUP BY s),
per AS (SELECT g.doc_id, count(*) AS n, count(*) FILTER (WHERE df.c > 1) AS shared
        FROM grams g JOIN df USING (s) GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(per.n, 0) AS n_shingles,
       round(CASE WHEN coalesce(per.n, 0) = 0 THEN 0.0 ELSE per.shared / per.n END, 6) AS internal_score
FROM documents d LEFT JOIN per USING (doc_id)"""

EXTERNAL_SQL = f"""
WITH {GRAMS.strip()}, {BENCH_GRAMS.strip()},
ext AS (SELECT DISTINCT s FROM bgrams),
per AS (SELECT g.doc_id, count(*) AS n, count(ext.s) AS m FROM grams g LEFT JOIN ext USING (s)
        GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(per.n, 0) AS n_shingles, coalesce(per.m, 0) AS n_external,
       round(CASE WHEN coalesce(per.n, 0) = 0 THEN 0.0 ELSE per.m / per.n END, 6) AS external_score
FROM documents d LEFT JOIN per USING (doc_id)"""

FLAGGED_SQL = f"""
WITH {GRAMS.strip()},
shared AS (SELECT s FROM grams GROUP BY s HAVING count(*) > 1)
SELECT doc_id, count(*) AS n_shared,
       array_to_string(list(s ORDER BY s), chr(10)) AS flagged_sections
FROM grams JOIN shared USING (s) GROUP BY doc_id"""


@query("internal_similarity", INTERNAL_SQL)
def internal_similarity(spark, d):
    """Share of each document's 5-word passages found in another document."""
    return SIM.internal_similarity(read_table(spark, d, "documents"))


@query("external_similarity", EXTERNAL_SQL)
def external_similarity(spark, d):
    """Share of each document's 5-word passages found in the outside corpus."""
    return SIM.external_similarity(read_table(spark, d, "documents"),
                                   read_table(spark, d, "benchmark"))


@query("flagged_sections", FLAGGED_SQL)
def flagged_sections(spark, d):
    """The shared passages of each document that shares any."""
    f = SIM.flagged_sections(read_table(spark, d, "documents"))
    return f.select("doc_id", "n_shared",
                    F.array_join("flagged_sections", "\n").alias("flagged_sections"))


PASSAGES_SQL = f"""
WITH {_toks_cte("grams", "documents", "doc_id")},
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM grams_toks WHERE len(w) >= 5)),
o AS (SELECT s, min(doc_id) AS lo, max(doc_id) AS hi FROM g GROUP BY s HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT g.doc_id, g.i, CASE WHEN g.doc_id <> lo THEN lo ELSE hi END AS source_id FROM g JOIN o USING (s)),
f AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) < 5 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
v AS (SELECT doc_id, run, source_id, min(i) AS lo, max(i) AS hi, count(*) AS votes FROM r GROUP BY ALL),
p AS (SELECT doc_id, run, min(lo) OVER w - 1 AS start_word, max(hi) OVER w + 4 AS end_word, source_id,
             row_number() OVER (PARTITION BY doc_id, run ORDER BY votes DESC, source_id) AS rn
      FROM v WINDOW w AS (PARTITION BY doc_id, run))
SELECT doc_id, start_word, end_word, source_id, array_to_string(w[start_word + 1:end_word], ' ') AS passage
FROM p JOIN grams_toks USING (doc_id) WHERE rn = 1"""


@query("shared_passages", PASSAGES_SQL)
def shared_passages(spark, d):
    """The passages that each document shares with others, with their place
    and a source document."""
    return SIM.shared_passages(read_table(spark, d, "documents"))


DOCUMENT_CHECKS_SQL = f"""
WITH {GRAMS.strip()}, {BENCH_GRAMS.strip()},
df AS (SELECT s, count(*) AS c FROM grams GROUP BY s),
ext AS (SELECT DISTINCT s FROM bgrams),
per AS (SELECT g.doc_id, count(*) AS n, count(*) FILTER (WHERE df.c > 1) AS shared, count(ext.s) AS m
        FROM grams g JOIN df USING (s) LEFT JOIN ext USING (s) GROUP BY g.doc_id),
flags AS (SELECT doc_id, array_to_string(list(s ORDER BY s), chr(10)) AS f
          FROM grams JOIN df USING (s) WHERE df.c > 1 GROUP BY doc_id),
scores AS (
  SELECT d.doc_id,
         CASE WHEN coalesce(per.n, 0) = 0 THEN 0.0 ELSE per.shared / per.n END AS internal,
         CASE WHEN coalesce(per.n, 0) = 0 THEN 0.0 ELSE per.m / per.n END AS external
  FROM documents d LEFT JOIN per USING (doc_id))
SELECT s.doc_id AS submission_id, round(s.internal, 6) AS internal_score,
       round(s.external, 6) AS external_score, CAST(0.0 AS DOUBLE) AS ai_generated_probability,
       coalesce(f.f, '') AS flagged_sections,
       CASE WHEN s.internal >= 0.7 THEN 'high' WHEN s.internal >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
       s.internal >= 0.5 AS requires_review, false AS ai_generated_likely
FROM scores s LEFT JOIN flags f USING (doc_id)"""


@query("document_checks", DOCUMENT_CHECKS_SQL)
def document_checks(spark, d):
    """B7 + C8-C10: the full check record of every document (scores,
    flagged sections, severity, review and AI flags)."""
    rec = SIM.score_documents(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return rec.withColumn("flagged_sections", F.array_join("flagged_sections", "\n"))
