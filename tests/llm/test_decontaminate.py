"""Decontamination: recall by item length, bounded tables, blocks, repeated items,
and all pairs against brute force."""

import pickle
import random

import pytest

from scrivener.llm import decontaminate as D

WORDS = [f"w{i}" for i in range(4000)]


def edited(rng, seq, edits):
    w = list(seq)
    for _ in range(edits):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[k] = "zz"
        elif kind == 1:
            w.insert(k, "qq")
        else:
            del w[k]
    return w


@pytest.mark.parametrize("n", [5, 10, 50, 200])
def test_recall_of_items_with_all_allowed_edits(n):
    rng = random.Random(n)
    items = [[rng.choice(WORDS) for _ in range(n)] for _ in range(40)]
    found = D.Items([(str(i), " ".join(w)) for i, w in enumerate(items)])
    texts = [" ".join(rng.choices(WORDS, k=30) + edited(rng, items[t % 40], D.edits_allowed(n)) + rng.choices(WORDS, k=30))
             for t in range(200)]
    got = {(d, key) for d, key, _, _ in found.search(texts)}
    assert sum((t, str(t % 40)) in got for t in range(200)) >= 0.95 * 200
    assert all(key == str(d % 40) for d, key in got)


def test_tables_stay_near_the_size_of_the_items():
    rng = random.Random(1)
    rows = [(str(i), " ".join(rng.choice(WORDS) for _ in range(rng.choice([100, 150, 200])))) for i in range(600)]
    chars = sum(len(t) for _, t in rows)
    assert len(pickle.dumps(D.Items(rows))) < 12 * chars


def test_every_match_of_brute_force_is_found(spark):
    """Texts over few words, so that near matches arise that nobody planted."""
    rng = random.Random(9)
    few = WORDS[:6]
    items = [(i, " ".join(rng.choices(few, k=rng.choice([5, 6, 10])))) for i in range(25)]
    docs = [(d, " ".join(rng.choices(few, k=rng.randrange(0, 60)))) for d in range(300)]
    want = {}
    for d, t in docs:
        seq = D.tokens(t)
        for i, u in items:
            w = D.tokens(u)
            row = [0] * (len(seq) + 1)
            for a, c in enumerate(w):
                new = [a + 1]
                for b, x in enumerate(seq):
                    new.append(min(row[b] + (c != x), row[b + 1] + 1, new[b] + 1))
                row = new
            if min(row) <= D.edits_allowed(len(w)):
                want[d, i] = min(row)
    out = D.matches(spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in out}
    assert len(out) == len(got) and set(got) <= set(want) and len(want) > 100
    assert len(got) >= 0.95 * len(want)
    assert all(got[k] >= want[k] for k in got)


def test_blocks_and_repeated_items(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=20)) for _ in range(8)]
    items = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[0]) for i in range(30)] + [
        (None, texts[1]), (7, texts[7]), (50, texts[2].upper())]
    docs = [(d, f"{' '.join(rng.choices(WORDS, k=9))} {texts[d % 8]}") for d in range(16)] + [(99, "clean words")]
    docs, items = (spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string"))
    whole = sorted(map(str, D.matches(docs, items).collect()))
    assert len(whole) == 2 * (8 + 30 + 1 + 1 + 1)
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert len(D.item_blocks(D.item_texts(items, "text"))) > 2
    assert sorted(map(str, D.matches(docs, items).collect())) == whole
    assert [r.doc_id for r in D.drop_contaminated(docs, items).collect()] == [99]
