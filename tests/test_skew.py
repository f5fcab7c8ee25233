"""Skew: one key holding a third of all rows (derived from the given tables).

Results must stay exact, and the hot key must not end up as one task where
Spark can split it (AQE skew join) or where the operator slices it.
"""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivener.operators import base as B
from scrivener.operators import similarity as SIM
from scrivener.operators import tables as TB
from scrivener.plans import views as V
from tests.conftest import SF_SMALL

SF = "/root/testdata/sf0.01"


def skewed_submissions(spark):
    """A third of all submissions moved to user 0."""
    s = V.submissions(spark, SF)
    return s.withColumn("user_id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_rank_exact_under_skew(spark):
    s = skewed_submissions(spark)
    got = TB.by_user_newest_first(s).select("id", "position")
    ref = s.select("id", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), F.desc("id"))).alias("position"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_latest_per_key_exact_under_skew(spark):
    c = V.checks(spark, SF).withColumn(
        "submission_id", F.when(F.col("l_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("submission_id")))
    got = B.latest_per_key(c, ["submission_id"], list(V.CHECK_ORDER), payload=list(c.columns))
    w = Window.partitionBy("submission_id").orderBy(*[F.desc(x) for x in V.CHECK_ORDER])
    ref = c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    cols = ["submission_id", "checked_at", "l_linenumber", "l_partkey", "internal_score"]
    assert got.select(cols).exceptAll(ref.select(cols)).count() == 0
    assert got.count() == ref.count()


def test_hot_user_join_is_split_at_runtime(spark):
    """With the users side not broadcast, AQE splits the hot user's partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # Many map tasks, as on a large input: AQE splits a skewed partition
        # along map-output blocks, so a single-split input cannot be split.
        s = skewed_submissions(spark).repartition(8)
        u = V.users(spark, SF)                  # user 0 (the hot one) is a registered user
        # Carry the row payload through the join (as a real query would), so
        # the hot partition is large in bytes, not only in rows.
        joined = s.join(u.select(F.col("id").alias("user_id"), "name"), "user_id")
        j = joined.agg(F.count(F.lit(1)).alias("n"),
                       F.max(F.xxhash64("id", "uploaded_at", "assignment_id", "name")).alias("h"))
        n = j.collect()[0]["n"]
        plan = j._jdf.queryExecution().executedPlan().toString()   # final adaptive plan
        assert n == s.join(u.select(F.col("id").alias("user_id")), "user_id", "left_semi").count()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _brute_internal(docs: pd.DataFrame) -> dict:
    sets = {}
    for r in docs.itertuples():
        w = [x for x in str(r.text or "").strip(" ").lower().split() if x]
        sets[r.doc_id] = {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}
    holders = {}
    for d, ss in sets.items():
        for s in ss:
            holders[s] = holders.get(s, 0) + 1
    return {d: (sum(holders[s] > 1 for s in ss) / len(ss) if ss else 0.0) for d, ss in sets.items()}


def test_hot_shingle_internal_scores_exact(spark):
    """A passage shared by a third of all documents: scores stay exact."""
    hot = " and this same closing passage is copied into many papers"
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(hot))).otherwise(F.col("text")))
    got = {r.doc_id: r.internal_score for r in SIM.internal_similarity(docs).collect()}
    ref = _brute_internal(docs.select("doc_id", "text").toPandas())
    assert got.keys() == ref.keys()
    assert all(abs(got[k] - ref[k]) < 1e-12 for k in ref)
