"""Noisy-channel decoding: more disguises with clean controls, the Viterbi
search against all readings, the character counts against a plain count."""

import collections
import itertools
import math
import random

import pytest

from scrivener.llm import toxicity

WORDS = {"idiot": 50, "clown": 50, "stupid": 60, "worthless": 40, "god": 9, "the": 300, "house": 90,
         "indeed": 60, "down": 70, "good": 80, "too": 90, "steel": 30, "see": 60, "little": 70}


def grams(words):
    out = collections.Counter()
    for w, n in words.items():
        p = f"  {w} "
        for i in range(len(p) - 2):
            out[p[i:i + 3]] += n
    return dict(out)


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer(grams(WORDS), {"idiot": 3.0, "clown": 3.0, "stupid": 3.0, "god": 3.0}, 1.0, -1.0)


@pytest.mark.parametrize("text", [
    "idiiot", "sstupid", "stuupid", "clowwn", "Idiiot,", "(sstupid)", "idiiot!!", "iiddiioott", "i  d  i  o  t",
    "i\td\ti\to\tt", "i\nd\ni\no\nt", "the  s t  u \t p i d  house", "cl0wwn", "1d10t"])
def test_disguises(scorer, text):
    assert scorer.score(text) > 0.8


@pytest.mark.parametrize("text", [
    "good", "too good", "see the little steel house", "indeed", "a  b  c", "1 2 3 4", "x\ty\tz", None, ""])
def test_clean_words_stay(scorer, text):
    assert scorer.score(text) == scorer.score("the house")


def test_viterbi_against_all_readings():
    model, rng = toxicity.CharModel(grams(WORDS)), random.Random(3)

    def logp(path):
        out = "".join(x for x, _ in path)
        s, ctx = sum(c for _, c in path), "  "
        for ch in out + " ":
            s, ctx = s + model.logp(ctx, ch), ctx[1] + ch
        return s

    for _ in range(150):
        token = "".join(rng.choice("idotclswn10!$.3e ") for _ in range(rng.randint(1, 7)))
        ways = toxicity.lattice(token)
        best = max(map(logp, itertools.product(*ways)))
        got = toxicity.restore(token, model)
        mine = [p for p in itertools.product(*ways) if "".join(x for x, _ in p) == got]
        assert math.isclose(max(map(logp, mine)), best, abs_tol=1e-9), token


def test_character_counts(spark):
    words = {"idiot": 5, "the": 3, "é😀a": 2, "x" * 100: 1, "ab": 4, "": 1}
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = collections.Counter(grams(words))
    assert toxicity.char_grams(rows) == dict(want)
    got = toxicity.char_grams(rows, 7)
    kept = sorted(want, key=lambda g: (-want[g], g.encode()))[:7]
    assert {g: n for g, n in got.items() if len(g) == 3} == {g: want[g] for g in kept}
    one = collections.Counter()
    for g, n in want.items():
        if g not in kept:
            one[g[2]] += n
    assert {g: n for g, n in got.items() if len(g) == 1} == dict(one)
    whole, cut = toxicity.CharModel(want), toxicity.CharModel(got)
    assert whole.uni == cut.uni and whole.total == cut.total
    assert toxicity.char_grams(rows.limit(0)) == {}


def test_memory_is_bounded(scorer, monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_CHARS", 400)
    monkeypatch.setattr(toxicity, "MEMO", 50)
    s = toxicity.Scorer(grams(WORDS), {"idiot": 3.0}, 1.0, -1.0)
    text = " ".join(f"w{i}rd" for i in range(200)) + " 1d10t " + "1o" * 500
    assert s.score(text) == toxicity.Scorer(grams(WORDS), {"idiot": 3.0}, 1.0, -1.0).score(text) > 0.8
    assert s.held <= 400 and sum(map(len, s.cache)) <= 400 and len(s.model.memo) <= 50
