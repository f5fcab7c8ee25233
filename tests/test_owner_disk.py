"""notify_check_stream keeps little on disk: narrow rows, packed state, one batch's shuffles, no old checkpoint."""

import os

from scrivener.plans import q_notify as QN
from scrivener.plans import q_streaming as Q
from scrivener.streaming import jobs as J
from scrivener.streaming import owners as OW
from tests.test_owner_batches import tables


def test_only_what_is_needed_is_kept(spark, tmp_dir, monkeypatch):
    tables(spark, tmp_dir)
    run, freed, state = os.path.join(tmp_dir, "run"), [], {}
    wait = Q._await

    def await_(q):
        state.update(name=q.name, there=os.path.isdir(J.checkpoint_for(spark, q.name)))
        wait(q)

    monkeypatch.setattr(Q, "_run_dir", lambda *a: run)
    monkeypatch.setattr(Q, "_await", await_)
    release = J.release_shuffles
    monkeypatch.setattr(J, "release_shuffles", lambda df: freed.append(release(df)))
    monkeypatch.setattr(Q, "BATCH_BYTES", 1)                     # a file in each batch
    got, want = Q.notify_check_stream(spark, tmp_dir), QN.notify_check(spark, tmp_dir)
    assert got.count() == want.count() > 50
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert state["there"] and not os.path.exists(J.checkpoint_for(spark, state["name"]))
    # each batch's shuffles (one of either stream) are gone from the disk
    batches = [x for x in os.listdir(os.path.join(run, "found")) if "settled" not in x]
    assert len(freed) == len(batches) > 2 and all(len(ids) == 2 for ids in freed)
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    left = {files.apply(k).getName() for k in range(files.size())}
    assert not [x for x in left for ids in freed for i in ids if x.startswith(f"shuffle_{i}_")]
    kept = set(spark.read.parquet(os.path.join(run, "found")).columns)
    assert kept - {"_key"} == {*Q.NOTIFIED, OW.OWNER, OW.FOUND, "batch_id"}


def test_the_state_is_packed(spark):
    rocks = "spark.sql.streaming.stateStore.rocksdb."
    assert J.JOIN_STATE[f"{rocks}compression"] == "zstd"
    assert int(J.JOIN_STATE["spark.sql.streaming.minBatchesToRetain"]) < 100
