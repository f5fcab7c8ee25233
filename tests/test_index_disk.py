"""F1: the shingle index is on disk once, its batches are not shuffled, its scores are counted in rounds."""

import os
import random

import pytest

from scrivener.operators import similarity as SIM
from scrivener.streaming import shingle_index as SI

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = " ".join(f"c{k}" for k in range(12))
    out = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(15)) + (f" {common}" if k % 2 else "")) for k in range(40)]
    return [*out, (100, None), (101, "a b"), (102, out[4][1])]


def scores(df):
    return {r.doc_id: (r.n_shingles, round(r.internal_score, 9)) for r in df.collect()}


def stored_parts(root):
    return {d for d, _, names in os.walk(root) if "_part=" in d and any(x.endswith(".parquet") for x in names)}


def test_a_batch_is_written_without_an_exchange(spark, tmp_dir, rows, monkeypatch):
    index, plans = SI.ShingleIndex(spark, tmp_dir, buckets=4), []
    write = index.table._write
    monkeypatch.setattr(index.table, "_write", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    index.add(spark.createDataFrame(rows, DOCS), 0)
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_rounds_and_deleting_as_it_merges(spark, tmp_dir, rows, monkeypatch):
    monkeypatch.setattr(SI, "ROUND_BYTES", 1)                # as many rounds as there are buckets
    index = SI.ShingleIndex(spark, tmp_dir, every=3, buckets=4, alone=True)
    merged = []
    compact = index.table._compact
    monkeypatch.setattr(index.table, "_compact", lambda parts: (merged.append(parts), compact(parts)))
    for b in range(4):
        index.add(spark.createDataFrame(rows[b::4], DOCS), b)
    assert len(merged) == 4 and sorted(sum(merged, [])) == ["0", "1", "2", "3"]
    want = scores(SIM.internal_similarity(spark.createDataFrame(rows, DOCS)))
    assert scores(index.scores()) == want
    assert len(os.listdir(os.path.join(tmp_dir, "scores"))) == 1
    # what is there is the newest version and, of one round at most, the one before
    now = {p.removeprefix("file:") for p in index.table.version().paths()}
    assert now <= stored_parts(tmp_dir) and len(stored_parts(tmp_dir) - now) <= 3


def test_a_single_owner_is_stored_once(spark, tmp_dir, rows):
    index = SI.ShingleIndex(spark, tmp_dir, buckets=4)
    index.add(spark.createDataFrame(rows[:5], DOCS), 0)
    index.add(spark.createDataFrame(rows[5:], DOCS), 1)
    index.table.compact()
    held = index.table.rows().where("h1 IS NOT NULL")
    assert held.where("hi = lo").isEmpty() and not held.where("hi > lo").isEmpty()
    assert held.count() == held.select(*SIM.KEY).distinct().count()
