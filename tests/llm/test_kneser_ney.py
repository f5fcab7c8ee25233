"""The classifier's model and scores against a plain version, and what they leave on disk."""

import collections
import math
import os
import random

import numpy as np
import pytest

from scrivener.llm import kneser_ney as K
from scrivener.session import checkpoint_dir

SF = "/root/testdata/sf0.01"


def sentences(n, seed):
    rng = random.Random(seed)
    return [" ".join("abcdefghijklmnop"[min(int(rng.expovariate(0.25)), 15)] for _ in range(rng.randint(0, 30)))
            for _ in range(n)]


def brute(texts):
    """log10 of a token after two others, for a model of these texts, by definition."""
    words = collections.Counter(w for t in texts for w in t.split())
    ids = {w for w, n in words.items() if n > 1}
    once = len(words) - len(ids)

    def coded(t):
        return ["<s>", "<s>", *[w if w in ids else "?" for w in t.split()], "</s>"]

    tri = collections.Counter(g for t in texts for s in [coded(t)] for g in zip(s, s[1:], s[2:]))
    bi = collections.Counter()
    for (_, v, w), n in tri.items():
        bi[v, w] += n if v == "<s>" else 1
    uni = collections.Counter(w for _, w in bi)

    def table(counts):
        c = collections.Counter(counts.values())
        d = K.discounts([c[i] for i in (1, 2, 3, 4)])
        total, held = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            g = g if isinstance(g, tuple) else (g,)
            total[g[:-1]] += n
            held[g[:-1]] += d[min(n, 3) - 1]
        return counts, d, total, held

    tables = [table(uni), table(bi), table(tri)]

    def p(g):
        counts, d, total, held = tables[len(g) - 1]
        low = p(g[1:]) if len(g) > 1 else 1 / (len(ids) + 2)
        if not total[g[:-1]]:
            return low
        n = counts[g if len(g) > 1 else g[0]]
        return (n - (d[min(n, 3) - 1] if n else 0)) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * low

    def score(t):
        s = coded(t)
        return sum(math.log10(p(g)) - (g[2] == "?") * math.log10(once + 1) for g in zip(s, s[1:], s[2:]))
    return score


@pytest.mark.parametrize("step", [K.STEP_WORDS, 40])
def test_scores_match_brute_force(spark, monkeypatch, step):
    """Whatever the parts, rounds and chunks, frequent middle words split or not."""
    monkeypatch.setattr(K, "STEP_WORDS", step)
    monkeypatch.setattr(K, "HELD_GRAMS", step)
    texts = sentences(200, 1) + [f"a b odd{i} c" for i in range(9)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    mine = {r.doc_id for r in K.trusted_ids(labels).collect()}
    want = brute([t for i, t in enumerate(texts) if i in mine])
    monkeypatch.setattr(K, "SHARD_ROWS", 150)
    model = K.fit(docs, labels)
    for rows in (10**6, 100):
        got = {r.doc_id: r for r in K.score(docs, model, shard_rows=rows).collect()}
        assert got.keys() == set(range(len(texts)))
        for i, t in enumerate(texts):
            assert got[i].n_tokens == len(t.split()) + 1
            assert got[i].log10_prob == pytest.approx(want(t), abs=1e-3)


def test_frequent_middle_words_are_split():
    seen = np.array([5, 0, 0, 1000, 10, 10])
    parts = K.Parts(seen, 12, 3)
    assert parts.n == 4 and parts.share[3] == 4 and parts.share[4] == 1 and parts.share[K.BEGIN] == 1
    assert sum(parts.middle(t).astype(int) for t in range(3)).tolist() == [1] * 6
    key = (np.int64(3) << K.BITS | np.arange(6)) << K.BITS | 4
    assert set(parts.of(key)) <= set(range(4)) and len(set(parts.of(key))) > 1


def test_little_is_left_on_disk(spark):
    """What the classifier stores, and the shuffle files it leaves, stay near the size of the documents."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    path = checkpoint_dir(spark).removeprefix("file:")

    def held():
        tables = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return tables + sum(blocks.apply(i).length() for i in range(blocks.size())
                            if blocks.apply(i).getName().startswith("shuffle_"))

    before = held()
    K.classify(docs, labels)
    assert held() - before < 1.5 * os.path.getsize(f"{SF}/documents.parquet")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key, "false") != "true"
