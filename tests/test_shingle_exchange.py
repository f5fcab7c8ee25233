"""C8-C10 deal each shingle once (F1, F5, F6, F7), with keys, ids and places only."""

import re

import pytest

from scrivener.operators import similarity as SIM

SCHEMA = "doc_id long, text string"
# ids that come twice, with the same text and with another, null ids and texts
ROWS = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x a b c d e"), (2, "b c d e f q r s t"), (3, None), (4, "u v w"),
        (None, "a b c d e z"), (None, "k l m n o"), (5, "k l m n o p"), (6, "p q r s t")]
CORPUS = [(1, "m n o p q r s t"), (2, "l m n o p")]


def shingles(text):
    w = (text or "").lower().split()
    return list(dict.fromkeys(" ".join(w[k:k + 5]) for k in range(len(w) - 4)))


def brute():
    """Per id: shingles, shared ones, external ones, flagged sections."""
    held, out = {}, {}
    for i, t in ROWS:
        for s in shingles(t):
            held.setdefault(s, set()).update(() if i is None else (i,))
    ext = {s for _, t in CORPUS for s in shingles(t)}
    for i in {i for i, _ in ROWS}:
        mine = [s for k, t in ROWS if k == i for s in shingles(t)]
        alone = {s for s in mine if held[s] == {i}}
        out[i] = (len(mine), len(mine) - len(alone), sum(s in ext for s in mine), sorted(s for s in mine if len(held[s]) > 1))
    return out


def queries(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    corpus = spark.createDataFrame(CORPUS, "item_id long, text string")
    return {"internal": SIM.internal_similarity(docs), "flagged": SIM.flagged_sections(docs),
            "passages": SIM.shared_passages(docs), "checks": SIM.score_documents(docs, corpus)}


def test_repeated_and_null_ids(spark):
    want, q = brute(), queries(spark)
    assert {r.doc_id: (r.n_shingles, r.internal_score) for r in q["internal"].collect()} == {
        i: (n, s / n if n else 0.0) for i, (n, s, _, _) in want.items()}
    assert {r.doc_id: (r.n_shared, r.flagged_sections) for r in q["flagged"].collect()} == {
        i: (len(f), f) for i, (_, _, _, f) in want.items() if f}
    assert {r.submission_id: (r.internal_score, r.external_score, r.flagged_sections) for r in q["checks"].collect()} == {
        i: (s / n if n else 0.0, m / n if n else 0.0, f if i is not None else []) for i, (n, s, m, f) in want.items()}


@pytest.mark.parametrize("name", ["internal", "flagged", "passages", "checks"])
def test_one_exchange_by_shingle(spark, name):
    plan = queries(spark)[name]._jdf.queryExecution().executedPlan().toString()
    deals = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(h1#", x)]
    own = [x for x in deals if "REPARTITION_BY" in x]
    assert len(own) == 1 and not any("shingle" in x or "text" in x for x in deals)
    # none of the others carries rows of the documents: they are the outside corpus
    assert len(deals) == len(own) + (name == "checks")


def test_reducers_grow_with_the_scan(spark):
    docs = spark.range(10).selectExpr("id AS doc_id", "'a b c d e f' AS text")
    few, many = (SIM.reducers(docs.repartition(k)) for k in (1, 6))
    assert many == 6 * few
    rows = SIM.placed_shingles(docs).select("doc_id", *SIM.KEY)
    assert SIM.dealt(rows, many, *SIM.KEY).rdd.getNumPartitions() == many
