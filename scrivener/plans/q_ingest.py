"""Registered ingest queries: A8, A9, B14-B16, B22."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivener.functions.text import MAX_UPLOAD_BYTES, TEXT_EXTENSIONS, decode_text, file_ext, within_size_limit
from scrivener.operators import ingest as IN
from scrivener.plans import views as V
from scrivener.plans.registry import query
from scrivener.sources.tables import read_table

_PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_EXT_SQL = f"lower(regexp_extract(regexp_extract({_PATH_SQL}, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1))"
_TEXT_EXTS = str(TEXT_EXTENSIONS)


@query("file_ext", f"SELECT page_id, {_PATH_SQL} AS path, {_EXT_SQL} AS ext FROM pages")
def file_ext_q(spark, d):
    """Lower-cased extension of the path of each page URL."""
    p = read_table(spark, d, "pages").select("page_id", IN.url_path(F.col("url")).alias("path"))
    return p.select("page_id", "path", file_ext("path").alias("ext"))


@query("decode_uploads", f"""
SELECT page_id, {_EXT_SQL} AS ext,
       CASE WHEN {_EXT_SQL} IN {_TEXT_EXTS} THEN length(html) END AS text_length
FROM pages""")
def decode_uploads(spark, d):
    """Pages as uploaded files: whitelisted extensions decode as UTF-8."""
    p = read_table(spark, d, "pages")
    ext = file_ext(IN.url_path(F.col("url")))
    body = F.encode("html", "UTF-8")
    return p.select("page_id", ext.alias("ext"),
                    F.length(decode_text(body, ext)).cast("bigint").alias("text_length"))


@query("size_limit", f"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, strlen(text) <= {MAX_UPLOAD_BYTES} AS accepted
FROM documents""")
def size_limit(spark, d):
    """Documents within the 10 MB upload limit are accepted."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
                       within_size_limit("text").alias("accepted"))


@query("page_sample", """
SELECT conv_id AS doc_id, count(*) AS page_count,
       CAST(coalesce(sum(length(text)) FILTER (WHERE turn < 3), 0) AS BIGINT) AS sample_text_length
FROM conversations GROUP BY conv_id""")
def page_sample(spark, d):
    """Page count and text length of the first three pages per document."""
    return IN.page_sample(V.pages(spark, d))


@query("object_events", f"""
SELECT CASE WHEN {_PATH_SQL} <> '' THEN regexp_extract(url, '://([^/?#]*)', 1) END AS bucket,
       CASE WHEN {_PATH_SQL} <> '' THEN substr({_PATH_SQL}, 2) END AS key,
       coalesce(CASE WHEN {_PATH_SQL} <> '' THEN ends_with(substr({_PATH_SQL}, 2), '.pdf') END, false) AS triggers,
       CASE WHEN {_PATH_SQL} = '' THEN 'no records in event' END AS error
FROM pages""")
def object_events(spark, d):
    """Object-created events (one per stored page, host = bucket,
    path = key) unnested to bucket/key; events without records are errors."""
    p = read_table(spark, d, "pages")
    path = IN.url_path(F.col("url"))
    rec = F.struct(F.struct(
        F.struct(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("name")).alias("bucket"),
        F.struct(F.substring(path, 2, 1 << 30).alias("key")).alias("object")).alias("s3"))
    ev = p.select(F.to_json(F.struct(
        F.when(path != "", F.array(rec)).otherwise(F.array().cast("array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"))
         .alias("Records"))).alias("value"))
    return IN.object_events(ev)


# Uploads made of pages: extension and damage by page number, a limit some exceed.
UPLOAD_EXTS = (".txt", ".PY", ".pdf", ".html")
UPLOAD_LIMIT = 2_000


@query("ingest_files", f"""
SELECT sha256(path) AS id, path AS file_url, lower(ext) AS ext, n_bytes,
       CASE WHEN n_bytes <= {UPLOAD_LIMIT} AND lower(ext) IN {_TEXT_EXTS} AND page_id % 5 <> 0 THEN html END AS text,
       CASE WHEN n_bytes <= {UPLOAD_LIMIT} THEN 'accepted' ELSE 'rejected: file too large' END AS status
FROM (SELECT *, 'uploads/' || page_id || ext AS path FROM (
        SELECT page_id, html, {list(UPLOAD_EXTS)}[page_id % 4 + 1] AS ext,
               CAST(strlen(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bytes FROM pages))""")
def ingest_files(spark, d):
    """Every page as an uploaded file; each fifth ends in a byte
    that is no UTF-8, and files over the limit are rejected by their length."""
    p = read_table(spark, d, "pages")
    ext = F.element_at(F.array(*map(F.lit, UPLOAD_EXTS)), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.encode("html", "UTF-8")
    content = F.when(F.col("page_id") % 5 == 0, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body)
    files = p.select(F.concat(F.lit("uploads/"), F.col("page_id").cast("string"), ext).alias("path"),
                     F.lit(None).cast("timestamp").alias("modificationTime"),
                     F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return IN.files_to_submissions(files, limit=UPLOAD_LIMIT).select(
        "id", "file_url", "ext", F.col("n_bytes"), "text", "status")
