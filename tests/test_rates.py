"""Rates over ranges against a plain loop, quantile sketches against ranks."""

import bisect
import datetime as dt
import random

import pytest

from scrivener.operators import metrics as H

T0 = dt.datetime(2024, 1, 1)


def brute(samples, length, step):
    out = {}
    by = {}
    for series, sec, v in samples:
        by.setdefault(series, []).append((sec, v))
    for series, points in by.items():
        points.sort()
        last = int(points[-1][0]) + length
        for e in range(-step, last + step, step):
            at = [(t, v) for t, v in points if e - length < t <= e]
            if len(at) < 2 or at[0][0] == at[-1][0]:
                continue
            up = sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(at, at[1:]))
            held = at[-1][0] - at[0][0]
            apart = held / (len(at) - 1)
            left, right = at[0][0] - (e - length), e - at[-1][0]
            left = apart / 2 if left >= apart * 1.1 else left
            if up > 0 and at[0][1] >= 0:
                left = min(left, held * at[0][1] / up)
            right = apart / 2 if right >= apart * 1.1 else right
            out[series, e] = up * (held + left + right) / held / length
    return out


def frame(spark, samples):
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=sec), float(v)) for s, sec, v in samples],
                                 "job string, ts timestamp_ntz, value double")


def test_rate_over_range_matches_a_plain_loop(spark):
    rng = random.Random(4)
    samples = []
    for job in ("a", "b"):
        v, t = 0, 0.0
        for _ in range(300):
            t += rng.choice([1, 7, 15, 30, 61, 400]) + rng.choice([0, 0.25])
            v = rng.randrange(3) if rng.random() < 0.06 else v + rng.randrange(5)
            samples.append((job, t, v))
    samples += [("edge", 30, 5), ("edge", 60, 7), ("edge", 330, 9), ("alone", 12, 1),
                ("late", 86_399, 5), ("late", 86_401, 8), ("flat", 10, 4), ("flat", 20, 4)]
    got = {(r.job, (r.eval_time - T0).total_seconds()): r.rate
           for r in H.rate_over_range(frame(spark, samples).repartition(3), ["job"]).collect()}
    want = brute(samples, 300, 30)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_rate_over_range_of_nothing_and_of_nulls(spark):
    schema = "job string, ts timestamp_ntz, value double"
    assert H.rate_over_range(spark.createDataFrame([], schema), ["job"]).count() == 0
    rows = [("a", None, 1.0), ("a", T0, None), ("a", T0, 1.0), (None, T0, 1.0)]
    assert H.rate_over_range(spark.createDataFrame(rows, schema), ["job"]).count() == 0
    with pytest.raises(ValueError):
        H.rate_over_range(spark.createDataFrame([], schema), ["job"], 300, 70)


def test_merged_sketches_are_near_the_exact_quantile(spark):
    rng = random.Random(2)
    values = {"hot": [rng.lognormvariate(0, 2) for _ in range(20_000)], "few": [1.0, 2.0, 3.0], "same": [4.0] * 500}
    rows = [(j, T0 + dt.timedelta(seconds=rng.randrange(3600)), v) for j, vs in values.items() for v in vs]
    df = spark.createDataFrame([*rows, ("few", T0, None), ("few", None, 9.0)],
                               "job string, ts timestamp_ntz, latency_s double").repartition(5)
    panes = H.quantile_sketches(df, ["job"])
    for q in (0.5, 0.95):
        got = {r.job: r for r in H.sketch_quantile(panes, ["job"], q=q).collect()}
        assert {j: got[j].n for j in values} == {j: len(v) for j, v in values.items()}
        ranks = sorted(values["hot"])
        assert abs(bisect.bisect(ranks, got["hot"].quantile) / len(ranks) - q) < 0.01
        assert got["same"].quantile == 4.0 and got["few"].quantile == {0.5: 2.0, 0.95: 3.0}[q]
    # merged over another range: two hours instead of one
    two = H.sketch_quantile(panes, ["job"], window="2 hours").where("job = 'hot'").collect()
    assert [r.n for r in two] == [20_000]
