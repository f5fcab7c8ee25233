"""The stored shingle index against the batch score."""

import random

import pytest

from scrivener.operators import similarity as SIM
from scrivener.streaming.shingle_index import ShingleIndex

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    common = words(40)
    out = [(1, common), (2, common.upper()), (3, None), (4, ""), (5, "a b c"), (6, "same " * 30), (7, "same " * 6)]
    out += [(10 + k, f"{words(20)} {common if k % 3 == 0 else ''} {words(9)}") for k in range(60)]
    return out


def scores(df):
    return {r.doc_id: (r.n_shingles, round(r.internal_score, 9)) for r in df.collect()}


def filled(spark, root, rows, batches, every, seed):
    rng = random.Random(seed)
    rows = rng.sample(rows, len(rows))
    index = ShingleIndex(spark, root, every=every, buckets=4)
    for b in range(batches):
        index.add(spark.createDataFrame(rows[b::batches], DOCS), b)
    return index, rows


@pytest.mark.parametrize("batches,every", [(1, 8), (5, 2)])
def test_scores_equal_the_batch_score(spark, tmp_dir, rows, batches, every):
    index, order = filled(spark, tmp_dir, rows, batches, every, batches)
    want = scores(SIM.internal_similarity(spark.createDataFrame(rows, DOCS)))
    assert scores(index.scores()) == want
    index.add(spark.createDataFrame(order[::batches], DOCS), 0)      # a replayed batch
    index.add(spark.createDataFrame(order[:9] * 2, DOCS), batches)   # repeated rows
    assert scores(index.scores()) == want
    assert len(index.table.version().paths()) <= 4 * (1 + every)


def test_new_documents_are_scored_without_the_stored_texts(spark, tmp_dir, rows):
    new, old = rows[:25], rows[25:]
    index, _ = filled(spark, tmp_dir, old, 3, 2, 1)
    want = scores(SIM.internal_similarity(spark.createDataFrame(rows, DOCS)))
    got = index.score(spark.createDataFrame(new, DOCS))
    assert scores(got) == {i: want[i] for i, _ in new}
    assert scores(index.score(spark.createDataFrame(old, DOCS))) == scores(
        SIM.internal_similarity(spark.createDataFrame(old, DOCS)))
    assert index.score(spark.createDataFrame([], DOCS)).count() == 0


def test_null_ids_are_left_out(spark, tmp_dir, rows):
    index = ShingleIndex(spark, tmp_dir, buckets=4)
    index.add(spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1])], DOCS), 0)
    assert scores(index.scores()) == {1: (36, 0.0)}
