"""The table behind the streaming sinks: whole versions, bounded reads, any order."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import windows as W
from scrivener.streaming import jobs as J
from scrivener.streaming import merge_table as MT
from scrivener.streaming import recompute as RC

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp, user_id long, event_type string, internal_score double, " \
        "external_score double, ai_generated_probability double, severity string"


def events(n=600, seed=0, hot=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = 1 if hot and rng.random() < 0.4 else rng.choice([None, *range(2, 9)])
        at = T0 + dt.timedelta(seconds=rng.choice([rng.randrange(86400), 900 * rng.randrange(96)]))
        score = rng.choice([None, rng.randrange(100) / 100])
        out.append((i, at, user, rng.choice([W.UPLOAD, W.CHECK, W.CHECK, "other"]), score, score, score,
                    rng.choice(["high", "low", None])))
    return out


def sums(spark, root, every=3):
    return MT.MergeTable(spark, root, MT.bucket(["k"], 4), lambda r: r.groupBy("k").agg(F.sum("v").alias("v")), every)


def as_dict(df):
    return {r.k: r.v for r in df.collect()}


def test_many_batches_with_compaction(spark, tmp_dir):
    rng, want, table = random.Random(1), {}, sums(spark, tmp_dir)
    for batch in range(8):
        rows = [(rng.choice([None, *range(20)]), rng.randrange(9)) for _ in range(30)]
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        table.apply(spark.createDataFrame(rows, "k long, v long"), batch)
        assert as_dict(table.read()) == want
        assert len(table.version().deltas) < 3
    assert table.version().batch == 7


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    table = sums(spark, tmp_dir)
    rows = spark.createDataFrame([(1, 5)], "k long, v long")
    held = table.apply(rows, 0)
    assert table.apply(rows, 0) == held and len(held) == 1
    assert as_dict(table.read()) == {1: 5}


def test_a_reader_sees_whole_versions_only(spark, tmp_dir, monkeypatch):
    table = sums(spark, tmp_dir)
    table.apply(spark.createDataFrame([(1, 5), (2, 6)], "k long, v long"), 0)
    seen = []
    publish = table._publish
    # just before a version is published its files are all there, and not yet read
    monkeypatch.setattr(table, "_publish", lambda v: (seen.append(as_dict(sums(spark, tmp_dir).read())), publish(v)))
    table.apply(spark.createDataFrame([(1, 1), (3, 1)], "k long, v long"), 1)
    table.apply(spark.createDataFrame([(2, 1)], "k long, v long"), 2)       # and a compaction
    one = {1: 6, 2: 6, 3: 1}
    assert seen == [{1: 5, 2: 6}, one, {**one, 2: 7}]
    older = table.read()
    table.apply(spark.createDataFrame([(9, 9)], "k long, v long"), 3)
    assert 9 not in as_dict(older) and as_dict(table.read())[9] == 9


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_dir, monkeypatch):
    table = sums(spark, tmp_dir)
    table.apply(spark.createDataFrame([(1, 5)], "k long, v long"), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda v: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.apply(spark.createDataFrame([(1, 7)], "k long, v long"), 1)
    assert as_dict(table.read()) == {1: 5}
    table.apply(spark.createDataFrame([(1, 7)], "k long, v long"), 1)
    assert as_dict(table.read()) == {1: 12}


def test_vacuum_keeps_what_is_named(spark, tmp_dir):
    table = sums(spark, tmp_dir)
    for batch in range(7):
        table.apply(spark.createDataFrame([(batch % 3, 1)], "k long, v long"), batch)
    before = as_dict(table.read())
    assert table.vacuum() > 0 and table.vacuum() == 0
    assert as_dict(table.read()) == before


def test_empty_batches_and_no_batch(spark, tmp_dir):
    table = sums(spark, tmp_dir)
    with pytest.raises(ValueError):
        table.read()
    assert table.apply(spark.createDataFrame([], "k long, v long"), 0) == []
    assert as_dict(table.read()) == {} and table.version().batch == 0


def test_reads_and_compaction_touch_only_their_partitions(spark, tmp_dir):
    table = RC.windows_table(spark, tmp_dir)
    rows = events(200)
    for day in range(9):
        ev = spark.createDataFrame([(i, T0 + dt.timedelta(days=day, seconds=s % 3600), *rest)
                                    for i, (s, (_, _, *rest)) in enumerate(zip(range(0, 9000, 45), rows))], EVENT)
        table.apply(RC.window_rows(ev), day)
    v = table.version()
    assert len(v.base) == 8 and len(v.deltas) == 1               # eight deltas were compacted
    files = table.rows(["2024-01-04"]).inputFiles()
    assert files and all("_part=2024-01-04" in f for f in files)
    first = dict(v.base)
    for batch in range(9, 17):                                   # only the fourth day gets more
        ev = spark.createDataFrame([(1, T0 + dt.timedelta(days=3), 1, W.CHECK, 0.5, 0.5, 0.5, "high")], EVENT)
        table.apply(RC.window_rows(ev), batch)
    now = table.version().base
    assert [p for p in first if now[p] != first[p]] == ["2024-01-04"]


def test_a_batch_reads_no_stored_file(spark, tmp_dir):
    """Adding a batch of accumulators plans no scan of the table."""
    table, plans = RC.windows_table(spark, tmp_dir), []
    write = table._write

    def spy(rows, name):
        plans.append((name, rows.inputFiles()))
        return write(rows, name)

    table._write = spy
    for batch in range(3):
        table.apply(RC.window_rows(spark.createDataFrame(events(50, batch), EVENT)), batch)
    assert [files for _, files in plans] == [[], [], []]


@pytest.mark.parametrize("seed", [0, 1])
def test_sessions_from_shuffled_batches(spark, tmp_dir, seed):
    keys = ("user_id",)
    rows = events(400, seed)
    want = W.session_analytics(spark.createDataFrame([r for r in rows if r[2] is not None], EVENT), keys, tie="event_id")
    random.Random(seed).shuffle(rows)
    table = RC.sessions_table(spark, tmp_dir, keys)
    table.every = 2
    for batch in range(4):
        part = [r for r in rows[batch::4] if r[2] is not None]
        table.apply(W.session_partials(spark.createDataFrame(part, EVENT), keys, tie="event_id"), batch)
    got = RC.read_sessions(spark, tmp_dir, keys)

    def plain(df):
        return sorted((r.user_id, r.window_start, r.window_end, r.submission_count, r.total_checks, r.high_risk_count,
                       round(r.avg_internal_score, 9)) for r in df.collect())

    assert plain(got) == plain(want)


def test_a_session_joins_its_neighbours(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    zero = (0, 0, 0, 0.0, 0.0, 0.0)
    schema = "user_id long, first timestamp, last timestamp, n_uploads long, n_checks long, n_high long, " \
             "sum_internal double, sum_external double, sum_ai double"
    parts = [(1, at(0), at(10), *zero), (1, at(39), at(50), *zero), (1, at(80), at(81), *zero),
             (2, at(0), at(100), *zero), (2, at(5), at(6), *zero), (2, at(110), at(111), *zero)]
    got = sorted((r.user_id, r["first"], r["last"])
                 for r in W.merge_sessions(spark.createDataFrame(parts, schema), ("user_id",)).collect())
    assert got == [(1, at(0), at(50)), (1, at(80), at(81)), (2, at(0), at(111))]


def test_upserts_with_compaction_equal_the_newest_rows(spark, tmp_dir):
    rng, rows = random.Random(5), []
    sink = J.upsert_batch(tmp_dir, ["k"], ["t"])
    for batch in range(9):
        mine = [(rng.randrange(12), rng.randrange(100), f"{batch}-{i}") for i in range(20)]
        rows += [(batch, *r) for r in mine]
        sink(spark.createDataFrame(mine, "k long, t long, v string"), batch)
    want = {}
    for b, k, t, v in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        want[k] = (t, v)
    assert {r.k: (r.t, r.v) for r in J.read_upserted(spark, tmp_dir, ["k"], ["t", "v"]).collect()}.keys() == want.keys()
    got = {r.k: r.t for r in J.read_upserted(spark, tmp_dir, ["k"], ["t"]).collect()}
    assert got == {k: t for k, (t, _) in want.items()}
    # the files read do not grow with the batches
    table = MT.MergeTable(spark, tmp_dir, MT.bucket(["k"]), lambda r: r)
    assert len(table.version().deltas) < MT.EVERY
    assert os.path.isdir(os.path.join(tmp_dir, "manifest"))
