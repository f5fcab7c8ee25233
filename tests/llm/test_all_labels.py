"""the models of op2 and op7 learn from all labelled documents."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scrivener.llm import kneser_ney, toxicity


def test_all_trusted_documents_are_used(spark):
    labels = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    assert kneser_ney.trusted_ids(labels).count() == labels.where(fold != 0).count() > 7_000


def test_counts_passed_on_in_parts_add_up(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(40)) for _ in range(30)] + [None]
    ids = {w: i + kneser_ney.FIRST_WORD for i, w in enumerate("abcde")}
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def counts():
        parts = list(kneser_ney._grams(ids)(iter([batch])))
        c = Counter()
        for p in parts:
            for r in p.to_pylist():
                c[r["u"], r["v"], r["w"]] += r["n"]
        return len(parts), c

    whole = counts()
    monkeypatch.setattr(kneser_ney, "HELD_GRAMS", 50)
    parts = counts()
    assert whole[0] == 1 < parts[0] and whole[1] == parts[1]


def test_all_labelled_documents_train_toxicity(spark):
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    assert toxicity.training(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n))


def test_logistic_fit_matches_a_plain_one(spark):
    rng = random.Random(2)
    x = [rng.choice((0.0, 0.5, 1.5, 2.5)) for _ in range(400)]
    y = [int(rng.random() < 1 / (1 + math.exp(2 - 2 * v))) for v in x]
    bad, n = sum(y), len(y)
    rows = spark.createDataFrame([(a, b, k) for (a, b), k in Counter(zip(x, y)).items()], "x double, y long, k long")
    slope, bias = toxicity.logistic(rows.repartition(3), n, bad)
    # plain gradient steps on the rows, one by one
    f, t, w = np.stack([x, np.ones(n)], 1), np.where(np.array(y) > 0, (bad + 1) / (bad + 2), 1 / (n - bad + 2)), np.zeros(2)
    for _ in range(20_000):
        w += 0.005 * (f.T @ (t - 1 / (1 + np.exp(-f @ w))) - 1e-2 * w)
    assert abs(slope - w[0]) < 1e-4 and abs(bias - w[1]) < 1e-4
