"""Consistent weighted sampling against its definition and the exact similarity."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scrivener.llm import fingerprints as fp
from scrivener.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "And", "a"]) if rng.random() < 0.3 else f"w{rng.randint(0, 400)}"
                    for _ in range(n))


ROWS = [(5, prose(1, 60)), (1, prose(2, 300)), (3, None), (2, ""), (9, prose(3, 1)), (4, "é😀 " * 7), (7, prose(1, 60)),
        (8, prose(5, 9000)), (None, prose(6, 40)), (11, "x" * 5000), (12, "x" * 5000 + " y"), (-4, " \t\n"),
        *[(100 + i, prose(100 + i, 30 + i)) for i in range(40)]]


def words(text):
    return collections.Counter(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()))


def jaccard(a, b):
    a, b = words(a), words(b)
    return sum((a & b).values()) / sum((a | b).values())


def mix(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def plain_signature(text, samples):
    """The definition, one term and draw at a time."""
    out = []
    for i in range(1, samples + 1):
        best = None
        for w, n in words(text).items():
            one = mix(xxhash.xxh64_intdigest(w) ^ mix(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            two = mix(one + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            u = [(((x >> 21 * k) & (1 << 21) - 1) + 0.5) / (1 << 21) for x in (one, two) for k in range(3)]
            r, c, b = -math.log(u[0] * u[1]), -math.log(u[3] * u[4]), u[2]
            t = math.floor(math.log(n) / r + b)
            y = math.exp(r * (t - b))
            a = c / (y * math.exp(r))
            tag = mix(two ^ (t * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) >> 32
            if best is None or a < best[0]:
                best = (a, tag & 0xFFFF)
        out.append(best[1])
    return out


def test_signatures_follow_the_definition():
    sampler = fp.Sampler(32)
    for text in (prose(1, 60), prose(2, 200), "one", "a a a a b", "ÀÉ " * 3):
        assert sampler.sign(text).tolist() == plain_signature(text, 32)


def test_a_small_memory_changes_nothing():
    small, large = fp.Sampler(64, room=16), fp.Sampler(64)
    for seed in range(5):
        assert (small.sign(prose(seed, 500)) == large.sign(prose(seed, 500))).all()


def test_collision_rate_is_the_generalised_jaccard_similarity():
    sampler = fp.Sampler(4096)
    for seed in range(4):
        base = prose(seed, 80).split()
        for share in (0, 0.2, 0.5, 0.8, 1):
            other = " ".join(base[:int(80 * share)] + prose(50 + seed, 80 - int(80 * share)).split())
            want = jaccard(" ".join(base), other)
            got = (sampler.sign(" ".join(base)) == sampler.sign(other)).mean()
            assert abs(got - want) < 5 * math.sqrt(want * (1 - want) / 4096) + 1e-3


def expected(rows):
    """All columns but the fingerprints, by hand; rows of one id may come in either order."""
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    out = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        changed = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), changed, t, nxt))
    return out


@pytest.mark.parametrize("files", [1, 7])
def test_edited_texts_and_likeness(spark, files):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(files)
    for c in ("range", "copy", "k", "id", "t", "fingerprint", "n_chars", "_fingerprint"):
        docs = docs.withColumn(c, F.lit(c))
    got = {r.doc_id: r for r in fp.edited(docs).collect()}
    assert len(got) == len(ROWS)
    sampler = fp.Sampler()
    for i, n, sha, changed, text, nxt in expected(ROWS):
        r = got[i]
        a, e, x = sampler.sign(text), sampler.sign(changed), sampler.sign(nxt)
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.fingerprint, r.edited_fingerprint) == (fp.hexed(a), fp.hexed(e))
        assert (r.near_edited, r.near_next) == ((a == e).mean(), (a == x).mean())
    assert got[5].fingerprint == got[7].fingerprint
    assert got[2].fingerprint == got[3].fingerprint == got[-4].fingerprint == "0" * 4 * fp.SAMPLES


def test_repeated_ids_single_rows_and_nothing(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (2, "x"), (None, None), (None, "q r")]
    got = fp.edited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (1, 7), (1, 7), (2, 1), (2, 7)]
    one = fp.edited(spark.createDataFrame([(4, "ab cd")], SCHEMA)).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"ab ab").hexdigest(), 1.0)]
    assert fp.edited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fingerprint_column_and_likeness(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("_fingerprint", F.lit(1))
    made = fp.fingerprint(docs)
    assert made.columns == ["doc_id", "text", "_fingerprint", "__fingerprint"]
    pair = [r["__fingerprint"] for r in made.where("doc_id in (5, 8)").orderBy("doc_id").collect()]
    like = spark.range(1).select(fp.likeness(F.lit(pair[0]), F.lit(pair[1])), fp.likeness(F.lit(pair[0]), F.lit(pair[0])))
    a, b = [np.frombuffer(bytes.fromhex(p), ">u2") for p in pair]
    assert tuple(like.first()) == ((a == b).mean(), 1.0)


def test_query_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op11_fingerprints"](spark, SF_SMALL).collect()}
    want = expected(rows)
    assert len(got) == len(want)
    off = []
    for i, n, sha, changed, text, nxt in want:
        assert (got[i].n_chars, got[i].edited_sha256) == (n, sha)
        if words(text):
            off += [got[i].near_edited - jaccard(text, changed), got[i].near_next - jaccard(text, nxt)]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_terms_are_drawn_once_for_many_texts(monkeypatch):
    """Texts signed together look up each word once: its draws, which cost most, are
    made once for all of them, and frequent words outlast the other half of the table."""
    made = []
    plain = fp.draws

    def counted(terms, *args):
        made.extend(terms.tolist())
        return plain(terms, *args)

    monkeypatch.setattr(fp, "draws", counted)
    texts = [" ".join(f"{k}w{i}" for i in range(60)) + " the of and" for k in range(50)]
    sampler = fp.Sampler(16, room=400)
    signs = sampler.sign_all(texts)
    assert len(made) == len(set(made)) == 50 * 60 + 3
    made.clear()
    alone = fp.Sampler(16, room=400)
    assert (np.array([alone.sign(t) for t in texts]) == signs).all()
    assert len(made) == len(set(made)) == 50 * 60 + 3


@pytest.mark.parametrize("group", [1, 100, 1 << 20])
def test_groups_of_texts_change_nothing(monkeypatch, group):
    monkeypatch.setattr(fp, "GROUP", group)
    texts = ["", " \t\n", " a b\x0b", "a\x1cb é\x85\xa0x", "a", "A a", prose(1, 200), "x" * 500, "x" * 500 + " y"]
    signs = fp.Sampler(32, room=64).sign_all(texts)
    for t, s in zip(texts, signs):
        assert s.tolist() == (plain_signature(t, 32) if t.strip(" \t\n") else [0] * 32)
