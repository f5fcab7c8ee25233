"""The prefix trie against one built in memory."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import prefix_trie as pt
from scrivener.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows, rebuild=True):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((-1 if t is None else t, role or "", len(text or ""), text or ""))
    plain = {c: [(r, x) for _, r, _, x in sorted(ts)] for c, ts in turns.items()}
    if not rebuild:
        return plain
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward(seed=0, n=260):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 == 3 and c % 100:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bb", "a" * 30])))
    rows += [(7, None, "user", "null turn"), (8, 0, "user", "tied"), (8, 0, "a", "tied"), (8, 0, "a", "tied"),
             (None, 1, "user", "nobody's"), (100_001, 0, "user", "no base"), (-150, 0, "user", "below zero")]
    rows += [(500 + i, t, "user", f"same {t}") for i in range(120) for t in range(3)]
    rows += [(900, t, "user", f"long {t}") for t in range(700)] + [(1900, t, "user", f"long {t}") for t in range(690)]
    return rows


def as_rows(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                    r.ends_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("cells", [1 << 26, 16])
def test_trie_matches_brute_force(spark, monkeypatch, cells):
    """Also with a sketch so small that it screens nothing."""
    if cells == 16:
        monkeypatch.setattr(pt, "MAX_CELLS", cells)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("depth", "x1", "shared", "n", "no", "src", "h", "base", "k"):
        df = df.withColumn(c, F.lit(c))
    assert as_rows(pt.ends_digest(pt.trie(pt.rebuilt(df)))) == brute(sequences(rows))


def test_plain_conversations_and_their_texts(spark):
    rows = awkward(3, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    t = pt.trie(pt.as_written(df))
    seqs = sequences(rows, rebuild=False)
    assert as_rows(pt.ends_digest(t)) == brute(seqs)
    for r in pt.last_turns(t.nodes, df).collect():
        assert (r.role, r.text) == (seqs[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_ids_of_a_node_are_hashed_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(pt, "ENDS", 7)
    rows = [(c, 0, "user", "hi") for c in range(-20, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(pt.ends_digest(pt.trie(pt.as_written(df)))) == brute(sequences(rows, rebuild=False))


def test_nothing(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert pt.ends_digest(pt.trie(pt.rebuilt(spark.createDataFrame(rows, SCHEMA)))).collect() == []


def test_the_sketch_never_counts_too_low():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, (2, 3000), dtype=np.uint64)
    twice = np.concatenate([x, x[:, :500]], axis=1)
    for cells in (64, 1 << 15):
        once, more = np.zeros((2, pt.ROWS, cells // 8), np.uint8)
        for part in np.array_split(np.arange(twice.shape[1]), 4):
            for r, cell in enumerate(pt.cells_of(twice[0, part], twice[1, part], cells)):
                pt.count_in(once[r], more[r], cell)
        said = pt.shared_in(more, x[0], x[1], cells)
        assert said[:500].all()
        if cells > 1 << 14:
            assert said[500:].mean() < 0.01


def test_the_sketch_of_tasks_is_the_sketch_of_all(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1 << 62, 1 << 62, (2000, 2)).tolist()
    df = spark.createDataFrame([*x, *x[:300]], "x1 long, x2 long").repartition(6)
    more, cells = pt.sketch(df, 2300)
    a = np.array(x).view(np.uint64)
    said = pt.shared_in(more, a[:, 0].copy(), a[:, 1].copy(), cells)
    assert said[:300].all() and said[300:].mean() < 0.02


def test_query_matches_its_sql(spark):
    name, sf_dir = "op12_prefix_trie", f"{SF_SMALL}/../sf0.01"
    assert compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
