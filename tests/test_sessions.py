"""Span-capped sessions against a plain fold, with one load that holds nearly all events."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.sessions import span_sessions

GAP, SPAN = 1000, 5000


def plain(samples):
    out = []
    for t, v in sorted(samples.items()):
        if out and out[-1][3] > 0 and t - out[-1][1] < GAP and t - out[-1][0] < SPAN:
            s = out[-1]
            out[-1] = (s[0], t, s[2] + 1, s[3] + v)
        else:
            out.append((t, t, 1, v))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 5000.0), (2, 7000.0), (3, 600_000.0)])
def test_sessions_equal_a_fold(spark, seed, block):
    rng, loads = random.Random(seed), {}
    for load in range(40):
        t, samples = rng.randint(0, 9000), {}
        for _ in range(4000 if load == 0 else rng.randint(1, 60)):
            samples[t] = rng.choice([0.0, 0.5, 0.25, 1.0])
            t += rng.choice([1, 3, 40, 200, 400, 900, 999, 1000, 1001, 4999, 5000] if load % 3 else [1, 50, 90, 400, 999])
        loads[load] = samples
    # Rows of one instant come apart.
    rows = [(k, t, v / 2) for k, s in loads.items() for t, v in s.items() for _ in range(2)]
    rng.shuffle(rows)
    got = {}
    for r in span_sessions(spark.createDataFrame(rows, "k INT, t BIGINT, v DOUBLE"), ["k"], GAP, SPAN, block).collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.instants, r.total))
    assert {k: sorted(s) for k, s in got.items()} == {k: plain(s) for k, s in loads.items()}


def test_a_million_events_of_one_load(spark):
    from pyspark.sql import functions as F

    t = (F.col("id") * 7 + F.pmod(F.xxhash64("id"), F.lit(7)) + F.floor(F.col("id") / 1000) * 1500).cast("bigint")
    events = spark.range(1_000_000).select(F.lit(1).alias("k"), t.alias("t"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) / 4.0).alias("v"))
    want = plain({r.t: r.v for r in events.groupBy("t").agg(F.sum("v").alias("v")).toLocalIterator()})
    got = sorted((r.start, r.end, r.instants, r.total) for r in span_sessions(events, ["k"], GAP, SPAN, 60_000.0).collect())
    assert got == want


def test_nothing(spark):
    assert span_sessions(spark.createDataFrame([], "k INT, t BIGINT, v DOUBLE"), ["k"], GAP, SPAN).count() == 0
    with pytest.raises(ValueError):
        span_sessions(spark.createDataFrame([], "k INT, t BIGINT, v DOUBLE"), ["k"], GAP, SPAN, 10.0)
