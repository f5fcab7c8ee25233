"""a table may be a folder of files (as large ones are)."""

import os

import pytest

import __spark_entry__ as E
from scrivener.plans import q_streaming as Q

TEXTS = ["a b c d e f", "a b c d e", "f g h i j k", "x y", None, "f g h i j"]


@pytest.fixture
def folder(spark, tmp_dir):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows.repartition(3).write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    rows.limit(1).write.parquet(os.path.join(tmp_dir, "documents2.parquet"))
    return tmp_dir


def test_a_folder_streams_like_a_file(spark, folder):
    q = (Q.table_stream(spark, folder, "documents", max_files=1).writeStream.format("memory").queryName("folder_rows")
         .option("checkpointLocation", os.path.join(folder, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    assert sorted(r.doc_id for r in spark.table("folder_rows").collect()) == list(range(len(TEXTS)))


def test_index_of_a_folder_scores_like_the_batch_query(spark, folder):
    got, want = (E.queries()[k](spark, folder).collect() for k in ("internal_similarity_indexed", "internal_similarity"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(TEXTS)
