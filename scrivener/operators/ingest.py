"""Ingest: uploaded files (A8, B14-B16), object-created events (A9) and
sampled page text of a document (B22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener import schemas
from scrivener.functions import messages as M
from scrivener.functions.text import MAX_UPLOAD_BYTES, decode_text, file_ext

# The binaryFile source's row shape (a stream must be given it up front).
BINARY_FILE_SCHEMA = ("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")

# Only object keys with this suffix trigger extraction; the
# first pages sampled for the text length.
OBJECT_SUFFIX = ".pdf"
SAMPLE_PAGES = 3


def _within(files: DataFrame, limit: int) -> DataFrame:
    """``files`` with the content of those up to ``limit`` bytes only. The size
    filter reaches the file listing, so a larger file is never opened."""
    small = files.where(F.col("length") <= limit)
    large = files.where(F.col("length") > limit).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def read_files(spark: SparkSession, path: str, glob: str | None = None,
               recursive: bool = False, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Binary files as rows (path, modificationTime, length, content); the
    content of files over ``limit`` bytes is NULL. Files are split across tasks
    by the file source like any other scan."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return _within(r.load(path), limit)


def stream_files(spark: SparkSession, path: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """A8 (streaming): new files in an upload folder as they arrive; feed
    the result to :func:`files_to_submissions` exactly like the batch read."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _within(r.load(path), limit)


def files_to_submissions(files: DataFrame, user_id=None, assignment_id=None,
                         limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """One submission row per file.

    Whitelisted extensions decode as UTF-8 (NULL on invalid bytes), other
    files keep NULL text; files over ``limit`` bytes are marked rejected
    instead of stored. The id is a hash of the path, so re-runs agree.
    """
    ext = file_ext("path")
    ok = F.col("length") <= limit
    return files.select(
        M.hash_id("path").alias("id"),
        (user_id if user_id is not None else F.lit(None).cast("string")).alias("user_id"),
        (assignment_id if assignment_id is not None else F.lit(None).cast("string")).alias("assignment_id"),
        F.col("modificationTime").alias("uploaded_at"),
        F.col("path").alias("file_url"),
        ext.alias("ext"),
        F.col("length").alias("n_bytes"),
        F.when(ok, decode_text("content", ext)).alias("text"),
        F.when(ok, F.lit("accepted")).otherwise(F.lit("rejected: file too large")).alias("status"),
    )


def object_events(events: DataFrame, col: str = "value") -> DataFrame:
    """bucket/key of the first record of an object-created event.

    Events without records give an error row; only ``.pdf`` keys are
    marked to trigger extraction (the bucket's suffix filter)."""
    p = F.from_json(F.col(col).cast("string"), schemas.OBJECT_CREATED)
    first = F.try_element_at(p.getField("Records"), F.lit(1))
    bucket = first.getField("s3").getField("bucket").getField("name")
    key = first.getField("s3").getField("object").getField("key")
    return events.select(
        bucket.alias("bucket"), key.alias("key"),
        F.coalesce(key.endswith(OBJECT_SUFFIX), F.lit(False)).alias("triggers"),
        F.when(key.isNull(), F.lit("no records in event")).alias("error"),
    )


def page_sample(pages: DataFrame, doc: str = "doc_id", page_no: str = "page_no",
                text: str = "text", n: int = SAMPLE_PAGES) -> DataFrame:
    """Page count and the text length of the first ``n`` pages (0-based
    page numbers), per document; one partial aggregate."""
    return pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.coalesce(F.sum(F.when(F.col(page_no) < n, F.length(text))), F.lit(0))
         .cast("bigint").alias("sample_text_length"),
    )


def url_path(url) -> F.Column:
    """Path part of a URL (no scheme, host, query or fragment)."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
