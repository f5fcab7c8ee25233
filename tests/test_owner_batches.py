"""F8: notify_check_stream takes many small files in few batches, its join keeps one store per partition."""

import datetime as dt
import glob
import os

from scrivener.plans import q_notify as QN
from scrivener.plans import q_streaming as Q
from scrivener.streaming import jobs as J


def tables(spark, root):
    t = dt.datetime(2024, 1, 1)
    rows = {
        "customer": ([(u, f"c{u}", 1, 5.0, "BUILDING") for u in range(6)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(k, k % 9, "O", 1.0, t, "1-URGENT") for k in range(60)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                   "o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(k if k % 10 else None, i, i, i, float(i), 1.0, k % 11 / 100, 0.02, "N", "O", t)
                      for k in range(70) for i in (1, 2)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                     "l_linestatus string, l_shipdate timestamp_ntz"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).repartition(6).write.parquet(os.path.join(root, f"{name}.parquet"))


def test_small_files_share_a_batch(spark, tmp_dir, monkeypatch):
    tables(spark, tmp_dir)
    run, queries = os.path.join(tmp_dir, "run"), []
    monkeypatch.setattr(Q, "_run_dir", lambda *a: run)
    monkeypatch.setattr(Q, "_await", lambda q: (queries.append(q), q.awaitTermination()))
    before = {k: spark.conf.get(k, None) for k in J.JOIN_STATE}
    got = Q.notify_check_stream(spark, tmp_dir)
    assert {k: spark.conf.get(k, None) for k in J.JOIN_STATE} == before
    want = QN.notify_check(spark, tmp_dir)
    assert got.count() == want.count() > 50
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # one batch with rows, one that moves the watermark; before: a batch per file
    assert len(glob.glob(os.path.join(run, "found", "batch_id=[0-9]*"))) <= 2
    state = queries[0].recentProgress[0]["stateOperators"][0]
    assert state["numStateStoreInstances"] == state["numShufflePartitions"]


def test_settings_come_back_after_a_failure(spark):
    key = "spark.sql.streaming.join.stateFormatVersion"
    old = spark.conf.get(key, None)
    try:
        with J.settings(spark, {key: "3"}):
            assert spark.conf.get(key) == "3"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(key, None) == old
