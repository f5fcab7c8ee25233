"""Document overlap scoring (C8-C10) as Spark jobs.

Shingles are distinct lower-cased word 5-grams of the whole text. Scores:

* internal (C8): share of a document's shingles that also occur in at least
  one *other* document of the corpus (containment in the rest of the corpus).
* external (C9): share of its shingles that occur in the outside corpus.
* flagged sections (C10): all shared shingles of a document, in order, as the
  suspicious passages; ``shared_passages`` merges them into runs of words with
  their place and a source document.

Internal overlap needs no document pairs. The rows (document, shingle key) are
dealt by the key once; a window over each key tells the lowest and highest
document that has it, so whether it is shared. Nothing is combined before that
exchange (nearly all shingles are rare, so combining would only spill), no row is
joined back to its key, and a shingle's text never leaves its document: rows carry
where the shingle stands in its text, and what is shared is cut from the text at
the end. The exchange has some partitions for each one of the scan, so that what a
task sorts stays small as the input grows. Shingle keys are two independent hashes
(96 bits), which makes collisions negligible even at 10^12 shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import scoring
from scrivener.functions.text import word_shingles, words
from scrivener.operators.base import shuffle_join

SHINGLE_WORDS = 5
KEY = ["h1", "h2"]
DEAL = 16                # reducers for each partition of the scan (128 MB of files, some 33 million shingles)
PLACE = 1 << 32          # a place: the hash of the text, and where in its list a shingle stands


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = SHINGLE_WORDS) -> DataFrame:
    """(id, shingles ARRAY<STRING>) with distinct shingles per document; the
    whole text is tokenised inside its row, no shuffle."""
    grams = word_shingles(F.coalesce(F.col(text_col), F.lit("")), n)
    return docs.select(F.col(id_col).alias("doc_id"), F.array_distinct(grams).alias("shingles"))


def explode_shingles(sets: DataFrame, keep_text: bool = False, keep_empty: bool = False) -> DataFrame:
    """One row per (doc, shingle) with the 96-bit shingle key.

    ``explode_outer`` instead of ``explode``: for ``explode`` the optimizer
    infers a ``size(array) > 0`` filter and pushes it below the projection,
    which evaluates the tokeniser twice. With ``keep_empty`` a document
    without shingles keeps one row with NULL keys.
    """
    e = sets.select("doc_id", F.explode_outer("shingles").alias("shingle"))
    if not keep_empty:
        e = e.where(F.col("shingle").isNotNull())
    has = F.col("shingle").isNotNull()
    cols = ["doc_id", F.when(has, F.xxhash64("shingle")).alias("h1"),
            F.when(has, F.hash("shingle")).alias("h2")]
    if keep_text:
        cols.append("shingle")
    return e.select(*cols)


def reducers(docs: DataFrame) -> int:
    """Partitions for an exchange of the shingles of ``docs``. Grows with the files."""
    return DEAL * docs.rdd.getNumPartitions()


def dealt(rows: DataFrame, n: int, *cols: str) -> DataFrame:
    """``rows`` dealt by ``cols`` over ``n`` partitions, or the session's number if
    that is more."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *cols) if n > least else rows.repartition(*cols)


def placed_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = SHINGLE_WORDS, place: bool = False) -> DataFrame:
    """(doc_id, n, h1, h2): per row of ``docs`` one row with its number of distinct
    shingles and one per distinct shingle (n null), from one pass over the texts.
    With ``place`` shingles also have ``place``, see :func:`flagged_of`. The rows
    with the numbers have no key; in h1 is a hash of the document, to deal them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sets = docs.select(F.col(id_col).alias("doc_id"), F.hash(text).alias("tk"),
                       F.array_distinct(word_shingles(text, n)).alias("shingles"))
    two = sets.select("doc_id", "tk", F.size("shingles").cast("long").alias("n"),
                      F.array(F.lit(None).cast("string")).alias("total"), "shingles")
    rows = two.unpivot(["doc_id", "tk", "n"], ["total", "shingles"], "kind", "s").select(
        "doc_id", "tk", "n", F.posexplode("s").alias("at", "shingle"))
    has = F.col("shingle").isNotNull()
    cols = ["doc_id", F.when(~has, F.col("n")).alias("n"),
            F.when(has, F.xxhash64("shingle")).otherwise(F.xxhash64("doc_id")).alias("h1"),
            F.when(has, F.hash("shingle")).alias("h2")]
    if place:
        cols.append(F.when(has, F.col("tk") * F.lit(PLACE) + F.col("at")).alias("place"))
    return rows.select(*cols)


def with_owners(rows: DataFrame) -> DataFrame:
    """Rows dealt by shingle key, with the lowest and highest document that has
    the shingle (``lo``, ``hi``) and ``alone``: true for one row of each shingle
    that a single document has."""
    key = Window.partitionBy(*KEY).orderBy(F.col("doc_id").asc_nulls_last())
    whole = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = rows.withColumns({"lo": F.min("doc_id").over(whole), "hi": F.max("doc_id").over(whole),
                            "_r": F.row_number().over(key)})
    return own.withColumn("alone", F.coalesce((F.col("lo") == F.col("hi")) & (F.col("_r") == 1), F.lit(False))).drop("_r")


def internal_similarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, internal_score). Texts under 5 words score 0.

    One scan, two shuffles: by shingle key, and the counts by document."""
    rows = with_owners(dealt(placed_shingles(docs, id_col, text_col), reducers(docs), *KEY))
    total, shared = F.col("n").isNotNull(), F.col("n").isNull() & ~F.col("alone")
    per_doc = rows.where(total | shared).groupBy("doc_id").agg(
        F.sum("n").alias("n_shingles"), F.count_if(shared).alias("n_shared"))
    n = F.col("n_shingles")
    return per_doc.select("doc_id", "n_shingles",
                          F.when(n > 0, F.col("n_shared") / n).otherwise(F.lit(0.0)).alias("internal_score"))


def reference_shingles(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct shingle keys of an outside corpus. Joined without a hint: the
    planner broadcasts it only while the corpus files are below
    ``spark.sql.autoBroadcastJoinThreshold`` (a text has fewer shingles than
    words, so the keys stay within a small multiple of that), and shuffles,
    with skewed keys split, beyond."""
    return explode_shingles(shingle_sets(corpus, id_col, text_col)).select(*KEY).distinct()


def external_similarity(docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text", corpus_id: str = "item_id",
                        corpus_text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_external, external_score).

    A left join marks hits, so one pass over the document shingles gives both
    counts."""
    rows = explode_shingles(shingle_sets(docs, id_col, text_col), keep_empty=True)
    ref = reference_shingles(corpus, corpus_id, corpus_text).withColumn("_hit", F.lit(1))
    per_doc = rows.join(ref, KEY, "left").groupBy("doc_id").agg(
        F.count("h1").alias("n_shingles"), F.count("_hit").alias("n_external"))
    n = F.col("n_shingles")
    m = F.col("n_external")
    return per_doc.select("doc_id", "n_shingles", "n_external",
                          F.when(n > 0, m / n).otherwise(F.lit(0.0)).alias("external_score"))


def _with_texts(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``rows`` and the texts of ``docs`` (``text``: hash and text), dealt by document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.struct(F.hash(text).alias("tk"), text.alias("t")).alias("text"))
    return dealt(rows.unionByName(texts, allowMissingColumns=True), n, "doc_id")


def flagged_of(texts: str, places: str, n: int = SHINGLE_WORDS) -> Column:
    """The shingles at ``places``, in order: a place holds the hash of its text
    (an id may stand for several) and the position in the text's distinct shingles."""
    lists = F.transform(texts, lambda t: F.struct(t["tk"].alias("tk"), F.array_distinct(word_shingles(t["t"], n)).alias("s")))
    cut = F.transform(lists, lambda t: F.transform(
        F.filter(places, lambda p: F.shiftright(p, 32) == t["tk"]),
        lambda p: F.get(t["s"], p.bitwiseAND(F.lit(PLACE - 1)).cast("int"))))
    return F.when(F.size(places) > 0, F.sort_array(F.flatten(cut))).otherwise(F.array().cast("array<string>"))


def flagged_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shared, flagged_sections) for documents sharing text.

    The places of shared shingles are dealt by document together with the texts,
    each text once. A document's list is at most its own words."""
    n = reducers(docs)
    rows = with_owners(dealt(placed_shingles(docs, id_col, text_col, place=True).where("n IS NULL"), n, *KEY))
    hits = rows.where(F.col("lo") != F.col("hi")).select("doc_id", "place")
    per_doc = _with_texts(hits, docs, id_col, text_col, n).groupBy("doc_id").agg(
        F.collect_list("place").alias("places"), F.collect_set("text").alias("texts"))
    return per_doc.where(F.size("places") > 0).select(
        "doc_id", F.size("places").cast("bigint").alias("n_shared"), flagged_of("texts", "places").alias("flagged_sections"))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = SHINGLE_WORDS) -> DataFrame:
    """C10 with positions: (doc_id, start_word, end_word, source_id, passage).

    A passage is a longest run of words covered by overlapping shingles that some
    other document has too (gaps and islands over the word positions), so a full
    copy is one passage. Words count from 0, the end is exclusive. Each shingle
    points to the lowest document that has it (from that document itself: to the
    highest); ``source_id`` is where most of the passage's shingles point, the
    lowest of several such.

    Only (document, position, two hashes) are shuffled per shingle; the passage is
    cut from the document's own text at the end. What is sorted or listed together
    is one document's positions. Texts under ``n`` words have no passage; a null
    text is empty; rows with a null id are left out."""
    own = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = own.select("doc_id", F.posexplode(word_shingles(F.col("_text"), n)).alias("at", "shingle")).select(
        "doc_id", "at", F.xxhash64("shingle").alias("h1"), F.hash("shingle").alias("h2"))
    parts = reducers(docs)
    key = Window.partitionBy(*KEY)
    owned = dealt(rows, parts, *KEY).withColumns({"lo": F.min("doc_id").over(key), "hi": F.max("doc_id").over(key)})
    hit = dealt(owned.where(F.col("lo") != F.col("hi")).select(
        "doc_id", "at", F.when(F.col("doc_id") != F.col("lo"), F.col("lo")).otherwise(F.col("hi")).alias("source_id")),
        parts, "doc_id")
    in_order = Window.partitionBy("doc_id").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(in_order) >= n, F.lit(True)).cast("int")
    runs = hit.withColumn("_new", apart).withColumn(
        "_run", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    votes = runs.groupBy("doc_id", "_run", "source_id").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("votes"))
    passages = votes.groupBy("doc_id", "_run").agg(
        F.min("lo").cast("long").alias("start_word"), (F.max("hi") + n).cast("long").alias("end_word"),
        F.min(F.struct(-F.col("votes"), F.col("source_id")))["source_id"].alias("source_id"))
    per_doc = passages.groupBy("doc_id").agg(
        F.collect_list(F.struct("start_word", "end_word", "source_id")).alias("_p"))
    return (own.join(shuffle_join(per_doc), "doc_id")
            .select("doc_id", words("_text").alias("_w"), F.explode("_p").alias("_p"))
            .select("doc_id", "_p.start_word", "_p.end_word", "_p.source_id",
                    F.array_join(F.slice("_w", (F.col("_p.start_word") + 1).cast("int"),
                                         (F.col("_p.end_word") - F.col("_p.start_word")).cast("int")), " ").alias("passage")))


def score_documents(docs: DataFrame, corpus: DataFrame, ai_col: str | None = None,
                    corpus_id: str = "item_id", corpus_text: str = "text") -> DataFrame:
    """B7 over documents in one plan: internal and external overlap, flagged
    sections and the derived severity / review / AI flags.

    One row set feeds everything, dealt by shingle once: a left join marks
    outside-corpus hits and a window tells the owners; what counts for a document
    (totals, shared shingles, hits) is dealt by document, with the texts that the
    flagged sections are cut from.
    """
    parts = reducers(docs)
    rows = dealt(placed_shingles(docs, place=True), parts, *KEY)
    ref = reference_shingles(corpus, corpus_id, corpus_text).withColumn("_hit", F.lit(1))
    marked = with_owners(rows.join(ref, KEY, "left"))
    total, shared = F.col("n").isNotNull(), F.col("n").isNull() & ~F.col("alone")
    few = marked.where(total | shared | F.col("_hit").isNotNull()).select(
        "doc_id", "n", F.when(F.col("lo") != F.col("hi"), F.col("place")).alias("place"),
        F.when(shared, F.lit(1)).alias("_shared"), "_hit")
    per_doc = _with_texts(few, docs, "doc_id", "text", parts).groupBy("doc_id").agg(
        F.sum("n").alias("n"), F.count("_shared").alias("n_shared"), F.count("_hit").alias("m"),
        F.collect_list(F.when(F.col("doc_id").isNotNull(), F.col("place"))).alias("places"),
        F.collect_set("text").alias("texts"))
    n = F.col("n")
    j = per_doc.withColumns({
        "internal_score": F.when(n > 0, F.col("n_shared") / n).otherwise(F.lit(0.0)),
        "external_score": F.when(n > 0, F.col("m") / n).otherwise(F.lit(0.0)),
        "flagged_sections": flagged_of("texts", "places"),
    })
    if ai_col:
        j = j.join(docs.select(F.col("doc_id"), F.col(ai_col).alias("ai_generated_probability")),
                   "doc_id", "left")
    else:
        j = j.withColumn("ai_generated_probability", F.lit(0.0))
    return scoring.check_record(j, submission_id="doc_id")
