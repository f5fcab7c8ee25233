"""C10 with positions: shared passages against a plain loop."""

import collections
import random

import pytest

from scrivener.operators import similarity as SIM


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def brute(rows):
    texts = {i: (t or "").lower().split() for i, t in rows if i is not None}
    held = collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 4):
            held[tuple(w[k:k + 5])].add(i)
    out = []
    for i, w in texts.items():
        shared = [k for k in range(len(w) - 4) if len(held[tuple(w[k:k + 5])]) > 1]
        runs = []
        for k in shared:
            if runs and k - runs[-1][-1] < 5:
                runs[-1].append(k)
            else:
                runs.append([k])
        for run in runs:
            votes = collections.Counter()
            for k in run:
                d = held[tuple(w[k:k + 5])]
                votes[min(d) if min(d) != i else max(d)] += 1
            source = min(votes, key=lambda x: (-votes[x], x))
            out.append((i, run[0], run[-1] + 5, source, " ".join(w[run[0]:run[-1] + 5])))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common, rare = words(rng, 60), words(rng, 12)
    out = [(1, " ".join(words(rng, 80))), (4, None), (5, ""), (6, "one two"), (None, " ".join(common))]
    out += [(10, " ".join(common)), (11, " ".join(common).upper()), (12, "  \n".join(words(rng, 9) + common + words(rng, 4)))]
    out += [(20, " ".join(words(rng, 7) + common[:20] + words(rng, 3) + common[20:45] + rare)),
            (21, " ".join(rare + words(rng, 30) + rare + common[3:9]))]
    out += [(30, "same " * 40), (31, "same " * 9), (32, "same same same same"), (33, "x " + "same " * 5 + "y")]
    return out + [(100 + k, " ".join(words(rng, 30) + common[10:17] + words(rng, 30))) for k in range(60)]


def collected(df):
    return sorted((r.doc_id, r.start_word, r.end_word, r.source_id, r.passage) for r in df.collect())


def test_passages_match_a_plain_loop(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(SIM.shared_passages(df)) == brute(rows)


def test_a_full_copy_is_one_passage(spark, rows):
    got = [r for r in brute(rows) if r[0] in (10, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r for r in collected(SIM.shared_passages(df)) if r[0] in (10, 11)] == got
    assert [(a, b, c) for a, b, c, _, _ in got] == [(10, 0, 60), (11, 0, 60)]


def test_no_documents_and_no_shared_words(spark):
    schema = "doc_id long, text string"
    assert SIM.shared_passages(spark.createDataFrame([], schema)).count() == 0
    assert SIM.shared_passages(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], schema)).count() == 0


def test_texts_are_not_shuffled_per_shingle(spark, rows):
    """Exchanges by shingle carry ids, positions and hashes only."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = SIM.shared_passages(df)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning(h1" in line:
            assert "text" not in line and "shingle" not in line
