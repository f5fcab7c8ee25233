"""Columns named like the operators' own, values that look alike, and spans that
meet: cases that once lost rows or stopped a job."""

import collections

import pytest
from pyspark.sql import functions as F

from scrivener.llm import (fingerprints, kneser_ney, lm_scoring, mixing, pii, quality_rules, sharding, simhash,
                           toxicity)
from tests.llm.test_operators import ROWS, SCHEMA, prose

NAMES = ("_id", "_doc", "toxic", "quality", "shard", "slot", "_shard", "row", "known", "logs", "words", "ids", "held_out",
         "round", "score", "predicted", "label", "word", "n", "w", "spans", "kind")


@pytest.fixture(scope="module")
def named(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("tags", F.array(F.lit("a"), F.lit(None).cast("string")))
    for c in NAMES:
        docs = docs.withColumn(c, F.lit(c))
    return docs


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, i % 2, 1 - i % 2) for i in range(30)], "doc_id long, quality int, toxic int")


def test_operators_with_clashing_columns(named, labels):
    n = len(ROWS)
    assert toxicity.score(named, toxicity.fit(named, labels)).count() == n
    assert kneser_ney.classify(named, labels).count() == n
    assert lm_scoring.score(named).count() == n
    assert pii.find(named).count() == n
    assert quality_rules.report(named).count() == n
    assert simhash.groups(named).count() == n
    assert fingerprints.edited(named).count() == n


def test_sharding_keeps_columns_of_its_own_names(named):
    out = sharding.shard(named, shards=4)
    assert out.columns == [*named.columns, "__shard", "_slot"]
    rows = out.collect()
    assert {r["shard"] for r in rows} == {"shard"}
    held = collections.Counter(r["__shard"] for r in rows)
    assert sum(held.values()) == len(ROWS) and max(held.values()) - min(held.values()) <= 1


def test_rows_that_print_alike_are_all_mixed(spark):
    """Arrays, structs and times that differ only below what a cast to text shows."""
    text = " ".join(prose(k, 3) for k in range(5))
    rows = [(["a, b"], (None, "x")), (["a", "b"], ("x", None)), (["a", None], (None, None)), (["a"], ("null", "x")),
            (None, None), ([], ("", ""))]
    df = spark.createDataFrame([(1, text, "s", tags, pair) for tags, pair in rows],
                               "doc_id long, text string, source string, tags array<string>, pair struct<a:string,b:string>")
    out = collections.Counter((str(r.tags), str(r.pair)) for r in mixing.mix(df).collect())
    assert sum(out.values()) >= len(rows) and set(out) == {(str(r.tags), str(r.pair)) for r in df.collect()}
    a, b = mixing.row_hashes(df)
    assert df.select(a.alias("a"), b.alias("b")).distinct().count() == len(rows)


def test_a_target_that_is_missed_is_said(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    df = spark.createDataFrame([(i, prose(i, 5 + i), "ab"[i % 2]) for i in range(20)],
                               "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="target"):
        mixing.mix(df).count()


def test_secrets_that_hold_a_base_span(spark):
    texts = ["password=bob@corp.com", "api_key=4111111111111111", "password=b7db7aa4a5fc", "mail bob@corp.com",
             "card 4111 1111 1111 1111"] * 30
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {texts[r.doc_id]: r.spans for r in rows}
    assert "secret:0:21" in found[texts[0]] and "email:" in found[texts[0]]
    assert "secret:0:24" in found[texts[1]] and "card:8:24" in found[texts[1]]
    assert found[texts[3]] == "email:5:17" and found[texts[4]] == "card:5:24"


def test_one_tokeniser(spark):
    docs = spark.createDataFrame([(1, "a\u00a0b c"), (2, "\u0130x C")], "doc_id long, text string")
    got = collections.Counter()
    for r in docs.select("text").mapInArrow(kneser_ney._words, "w string, n long").collect():
        got[r.w] += r.n
    assert got == collections.Counter(w for t in ("a\u00a0b c", "\u0130x C") for w in kneser_ney.tokens(t))
