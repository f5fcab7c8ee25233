"""A stored shingle index (C8): documents are tokenised once, when they come.

One table holds, per shingle key, the lowest and highest document that has it,
and per document its number of distinct shingles. Both are minima and maxima, so
batches of documents add up in any order (``merge_table``). A batch appends the
rows of its own documents; rows of one shingle become one at the next compaction.
Scores of all documents, or of new documents against the stored ones, then need
the index only, not the texts. The index keeps every shingle: winnowed
fingerprints would be fewer, but change the scores.

The index is some three times the size of the texts' files (96 bits of hash per
shingle are not to be compressed), so nothing holds it a second time. A batch is
written by the tasks that read its texts, straight into the buckets, without an
exchange. Compaction and ``scores`` take some buckets after the other (``ROUNDS``)
and drop the shuffle files of each. What is the same from row to row, the document
in a delta and the top of the sorted hashes in a base, takes hardly any bits
(Parquet's delta encoding); the highest document is stored where it is not the lowest.

A document id stands for one text: repeated rows count once, a changed text needs
a new id. Rows with a null id are left out; a null text is empty; texts under
five words have no shingles and score 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.operators.base import shuffle_join
from scrivener.operators.similarity import KEY, SHINGLE_WORDS, placed_shingles
from scrivener.streaming import jobs as J
from scrivener.streaming import merge_table as MT

BUCKETS = 64
ROUNDS = 16                 # at most; one for ROUND_BYTES of the index
ROUND_BYTES = 16 << 20
# Hashes and ids have no repeated values worth a dictionary. A task keeps a file of
# each bucket open (no sort) and a MB of rows for each.
FILES = {"parquet.writer.version": "v2", "parquet.block.size": str(1 << 20),
         **{f"parquet.enable.dictionary#{c}": "false" for c in (*KEY, "lo")}}


def index_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(h1, h2, doc_id, lo, hi, n): a row per document and shingle with its key,
    and a row per document (key null) with its count. One pass over the texts.
    ``hi`` is null where it is ``lo``."""
    rows = placed_shingles(docs.where(F.col(id_col).isNotNull()), id_col, text_col, n)
    total, d = F.col("n").isNotNull(), F.col("doc_id")
    return rows.select(F.when(~total, F.col("h1")).alias("h1"), "h2", F.when(total, d).alias("doc_id"), d.alias("lo"),
                       F.when(F.lit(False), d).alias("hi"), "n")


def _merged(rows: DataFrame) -> DataFrame:
    lo, hi = F.min("lo"), F.max(F.coalesce("hi", "lo"))
    return rows.groupBy(*KEY, "doc_id").agg(lo.alias("lo"), F.nullif(hi, lo).alias("hi"), F.max("n").alias("n"))


def _scores(rows: DataFrame) -> DataFrame:
    """Scores from rows (doc, n, unique): totals and counts of unique shingles."""
    per_doc = _per_doc(rows)
    n = F.col("n")
    return per_doc.select("doc_id", n.alias("n_shingles"),
                          F.when(n > 0, (n - F.col("unique")) / n).otherwise(F.lit(0.0)).alias("internal_score"))


def _per_doc(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("unique").alias("unique"))


def _countable(merged: DataFrame) -> DataFrame:
    """The rows that count for a document: its total, and the shingles it alone has."""
    return merged.where(F.col("doc_id").isNotNull() | F.col("hi").isNull()).select(
        F.coalesce("doc_id", "lo").alias("doc_id"), "n", F.col("doc_id").isNull().cast("bigint").alias("unique"))


class _Table(MT.MergeTable):
    """A ``MergeTable`` that is never there twice, see above. With ``alone`` (no
    reader works on an older version) it deletes what it no longer names."""

    def __init__(self, *args, alone: bool = False, **kwargs):
        super().__init__(*args, **kwargs)
        self.alone = alone

    def rounds(self) -> int:
        """Over how many rounds the buckets are dealt: more, as the index grows."""
        sc, size = self.spark.sparkContext, 0
        for path in self.version().paths():
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            size += at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        return min(ROUNDS, 1 + size // ROUND_BYTES)

    def _merge_batch(self, rows: DataFrame) -> DataFrame:
        return rows                     # no exchange of a whole batch: compaction merges

    def _write(self, rows: DataFrame, name: str) -> tuple[str, list[str]]:
        folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
        rows = rows.withColumn(MT.PART, F.coalesce(self.part.cast("string"), F.lit("none")))
        base = name.startswith("base/")
        if base:
            rows = rows.sortWithinPartitions(MT.PART, *KEY)
        # a delta's rows stay in the order of the documents
        how = J.RELEASED if base else {"spark.sql.maxConcurrentOutputFileWriters": str(4 * BUCKETS)}
        with J.settings(rows.sparkSession, how):
            rows.write.options(**FILES).partitionBy(MT.PART).parquet(folder)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        names = [s.getPath().getName() for s in found]
        return folder, sorted(x.split("=", 1)[1] for x in names if x.startswith(f"{MT.PART}="))

    def compact(self, rounds: int | None = None) -> None:
        super().compact(rounds or self.rounds())

    def _compact(self, parts: list[str]) -> None:
        super()._compact(parts)
        if self.alone:
            self.vacuum()


class ShingleIndex:
    """The index at ``root``, a folder in shared storage. ``alone``: nobody else
    reads it while documents are added, so merged files may go at once."""

    def __init__(self, spark: SparkSession, root: str, every: int = MT.EVERY, buckets: int = BUCKETS,
                 alone: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = _Table(spark, root, MT.bucket([*KEY, "doc_id"], buckets), _merged, every, alone=alone)

    def add(self, docs: DataFrame, batch_id: int) -> None:
        """Adds a batch of documents; a batch that was added before changes nothing."""
        self.table.apply(index_rows(docs), batch_id)

    def scores(self) -> DataFrame:
        """C8 of all stored documents: (doc_id, n_shingles, internal_score). The
        shingles are counted now, bucket by bucket: a shingle is in one bucket
        only, and what a round leaves is a row per document."""
        parts = sorted({p.rsplit(f"{MT.PART}=", 1)[1] for p in self.table.version().paths()})
        rounds = self.table.rounds()
        if rounds == 1:
            return _scores(_countable(self.table.read()))
        folder, schema = f"{self.root}/scores/{uuid.uuid4().hex}", None
        with J.settings(self.spark, J.RELEASED):
            for k in range(min(rounds, len(parts))):
                counts = _per_doc(_countable(self.table.read(parts[k::rounds])))
                counts.write.parquet(f"{folder}/round={k}")
                schema = counts.schema
        fields = T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])
        return _scores(self.spark.read.schema(fields).parquet(folder))

    def score(self, docs: DataFrame) -> DataFrame:
        """C8 of documents against the stored ones and each other, nothing added.
        Documents that are stored already are not compared with themselves."""
        own = _merged(index_rows(docs))
        alone = own.where(F.col("h1").isNotNull() & F.col("hi").isNull()).select(*KEY, F.col("lo").alias("_d"))
        stored = self.table.rows().where(F.col("h1").isNotNull()).select(*KEY, "lo", F.coalesce("hi", "lo").alias("hi"))
        # a shingle that only one of the documents has, but a stored document too
        met = (stored.join(shuffle_join(alone), KEY)
               .where((F.col("lo") != F.col("_d")) | (F.col("hi") != F.col("_d")))
               .select(*KEY, "_d").distinct())
        less = met.select(F.col("_d").alias("doc_id"), F.lit(None).cast("bigint").alias("n"),
                          F.lit(-1).cast("bigint").alias("unique"))
        return _scores(_countable(own).unionByName(less))
