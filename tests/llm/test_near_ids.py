"""Check findings of op2 and op7 (disk): a join of texts to labels deals out the texts of labelled documents only."""

import pytest
from pyspark.sql import functions as F

from scrivener.llm import toxicity
from scrivener.llm.common import near_ids


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_all_wanted_rows_and_few_others_are_kept(spark, kind):
    docs = spark.range(-10_000, 10_000).select(F.col("id").cast(kind).alias("doc_id"), F.lit("x").alias("text"))
    docs = docs.union(docs.limit(50)).union(docs.limit(1).select(F.lit(None).cast(kind), "text"))
    ids = spark.range(-10_000, 10_000, 7).select(F.col("id").cast(kind).alias("i"))
    got = near_ids(docs, "doc_id", ids)
    assert got.columns == docs.columns
    wanted = docs.join(ids, F.col("doc_id") == F.col("i"), "left_semi")
    assert wanted.exceptAll(got).isEmpty() and got.exceptAll(docs).isEmpty()
    assert wanted.count() <= got.count() < wanted.count() * 1.02
    # a filter too small for its ids keeps more, never less
    assert wanted.exceptAll(near_ids(docs, "doc_id", ids, bits=1 << 10)).isEmpty()


def test_ids_of_other_types_are_left_to_the_join(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"))
    assert near_ids(docs, "doc_id", spark.range(5).select(F.col("id").cast("int"))).count() == 100


def test_only_labelled_texts_are_dealt_out(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text"))
    labels = spark.range(0, 20_000, 100).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    train = toxicity.training(docs, labels)
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap" in plan.lower() and "strategy=merge" in plan
    assert train.count() == labels.where(toxicity.fold(F.col("doc_id"), 5) != 0).count()
