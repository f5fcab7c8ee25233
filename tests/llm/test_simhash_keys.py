"""Keys of the SimHash buckets: exact for each number of blocks, and finer as
the table grows, so buckets of unrelated fingerprints stay within an index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import components, simhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(rng, base, bits):
    for i in rng.sample(range(64), bits):
        base ^= 1 << i
    return base


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_near_fingerprints_share_a_bucket(n):
    keys, rng = simhash.block_keys(4, n), random.Random(n)
    assert all(len(k) == n - 4 for k in keys)

    def buckets(fp):
        return {(i, *(fp >> s & (1 << w) - 1 for s, w in k)) for i, k in enumerate(keys)}

    for _ in range(300):
        a = rng.getrandbits(64)
        assert buckets(a) & buckets(near(rng, a, 4))


def test_bucket_numbers_are_one_to_one(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1]
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for n in (5, 8):
        keys = simhash.block_keys(4, n)
        got = rows.select("fp", *[simhash.bucket_of(F.col("fp"), i, k).alias(f"b{i}") for i, k in enumerate(keys)])
        seen = {}
        for r in got.collect():
            for i, k in enumerate(keys):
                fp = r["fp"] & (1 << 64) - 1
                assert seen.setdefault(r[f"b{i}"], x := (i, *(fp >> s & (1 << w) - 1 for s, w in k))) == x


@pytest.mark.parametrize("n", [6, 7, 8])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, n):
    monkeypatch.setattr(simhash, "block_count", lambda *a: n)
    rng = random.Random(n)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [near(rng, rng.choice(fps), rng.randint(1, 5)) for _ in range(240)]
    fps = np.unique(np.array(fps, dtype=np.uint64))
    root = np.arange(len(fps))
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(rows, 4)).collect()}
    for want in set(root):
        members = [int(x) for x in fps.view(np.int64)[root == want]]
        assert len(members) == 1 or {got[m] for m in members} == {min(members)}
        assert len(members) > 1 or members[0] not in got


def test_buckets_of_unrelated_fingerprints_do_not_grow():
    chunk, sizes = simhash.CHUNK, [10 ** k for k in range(4, 12)]
    for rows in sizes:
        n = simhash.block_count(rows, 4)
        width = min(sum(w for _, w in k) for k in simhash.block_keys(4, n))
        assert rows >> width <= chunk
    assert [simhash.block_count(r, 4) for r in sizes] == [5, 5, 5, 5, 6, 6, 7, 7]
    # chunk pairs of one key at a sixteenth of the size: as rows grow, pairs grow with them, not with the square
    chunk, rng, per_row = 16, np.random.default_rng(0), []
    for rows in (1 << 13, 1 << 17, 1 << 20):
        fp = rng.integers(0, 1 << 63, rows, dtype=np.uint64)
        (s, w), *rest = simhash.block_keys(4, simhash.block_count(rows, 4, chunk))[0]
        key = fp >> np.uint64(s) & np.uint64((1 << w) - 1)
        for s, w in rest:
            key = (key << np.uint64(w)) | (fp >> np.uint64(s) & np.uint64((1 << w) - 1))
        chunks = -(-np.unique(key, return_counts=True)[1] // chunk)
        per_row.append((chunks * (chunks - 1) // 2).sum() / rows)
    assert max(per_row) < 1 / chunk


def test_rows_of_one_id_are_told_apart(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (1, text, "x"), (1, "quite another text with other words in it", "x"), (1, None, "x"),
            (2, text, "y"), (None, "nothing like the others at all here", "z"), (3, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _body string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, text), (1, rows[2][1]), (1, None), (None, rows[5][1])], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
