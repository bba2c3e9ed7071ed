"""Bucketed order operators against plain Python on keys that hold most of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health as H
from tidemark.operators import ordered as O

BASE = datetime(2024, 1, 1)
random.seed(7)
# Key 0 holds nine of ten rows.
ROWS = [(0 if random.random() < 0.9 else random.randint(1, 5), BASE + timedelta(minutes=random.randint(0, 3000)), i,
         random.choice([None, "a", "b"]), random.randint(0, 3)) for i in range(600)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k INT, at TIMESTAMP, id BIGINT, v STRING, n INT")


def ordered_rows(k):
    return sorted((r for r in ROWS if r[0] == k), key=lambda r: (r[1], r[2]))


def test_carry_previous(df):
    got = {r["id"]: r["p"] for r in O.carry_previous(df, ["k"], ["at", "id"], "v", "p", O.time_bucket("at", 3600)).collect()}
    for k in range(6):
        last = None
        for row in ordered_rows(k):
            assert got[row[2]] == last
            last = row[3] or last


def test_running_sum_and_ordinal(df):
    summed = O.running_sum(df, ["k"], ["at", "id"], F.col("n").cast("bigint"), "s", O.time_bucket("at", 3600))
    got = {r["id"]: (r["s"], r["o"]) for r in O.ordinal(summed, ["k"], ["at", "id"], "o", O.time_bucket("at", 7200)).collect()}
    for k in range(6):
        total = 0
        for place, row in enumerate(ordered_rows(k), 1):
            total += row[4]
            assert got[row[2]] == (total, place)


def test_latest_before_is_strict_and_ignores_null_payloads(df):
    payload = F.when(F.col("v") == "a", F.struct("at", "id"))
    got = {r["id"]: r["p"]["id"] if r["p"] else None for r in O.latest_before(df, ["k"], "at", {"p": payload}, 3600).collect()}
    for k, at, ident, _, _ in ROWS:
        earlier = [(r[1], r[2]) for r in ROWS if r[0] == k and r[1] < at and r[3] == "a"]
        assert got[ident] == (max(earlier)[1] if earlier else None)


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join(spark, df, forward):
    asks = [(i, k, BASE + timedelta(minutes=137 * i) if i % 7 else None) for i in range(25) for k in (0, 3)]
    asks = [(n, k, t) for n, (_, k, t) in enumerate(asks)]
    left = spark.createDataFrame(asks, "ask BIGINT, k INT, t TIMESTAMP")
    got = {r["ask"]: r["f"]["id"] if r["f"] else None for r in O.asof_join(left, df, ["k"], "t", "ask", "at", "id", ["id"], "f", forward=forward, width_s=3600).collect()}
    for ask, k, t in asks:
        mine = [(r[1], r[2]) for r in ROWS if r[0] == k and (t is None or (r[1] >= t if forward else r[1] <= t))]
        want = (min(mine) if forward else max(mine))[1] if mine else None
        assert got[ask] == want


def test_window_head(spark, df):
    spans = [(i, i % 3, BASE + timedelta(minutes=90 * i), BASE + timedelta(minutes=90 * i + 700), 4) for i in range(20)]
    left = spark.createDataFrame(spans, "span BIGINT, k INT, a TIMESTAMP, z TIMESTAMP, lim BIGINT")
    got = {}
    for r in O.window_head(left, df.withColumn("lim", F.lit(4).cast("bigint")), ["k"], "span", "a", "z", "at", "id", "lim", 3600).collect():
        got.setdefault(r["span"], []).append((r["position"], r["id"]))
    for span, k, a, z, n in spans:
        want = [r[2] for r in ordered_rows(k) if a <= r[1] <= z][:n]
        assert [i for _, i in sorted(got.get(span, []))] == want


def test_top_n_beyond_the_trim_limit(spark):
    big = spark.range(25_000).select((F.col("id") % 2).alias("k"), F.col("id"))
    got = O.top_n(big, ["k"], [F.col("id").desc()], 11_000)
    assert got.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m")).orderBy("k").collect() == [(0, 11_000, 3_000), (1, 11_000, 3_001)]


def test_exact_percentiles(df):
    import numpy as np

    got = {r["k"]: (r["p50"], r["p95"]) for r in O.exact_percentiles(df.withColumn("x", F.col("id") * 1.5), ["k"], "x", {"p50": 0.5, "p95": 0.95}, 20.0).collect()}
    for k in got:
        values = [r[2] * 1.5 for r in ROWS if r[0] == k]
        assert got[k] == pytest.approx((np.percentile(values, 50), np.percentile(values, 95)))


def test_drilldown_budget_matches_a_sequential_fold(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(900):
        conn, inv = rng.choice([1, 1, 1, 2]), rng.randint(0, 25)
        rows.append((conn, inv, f"r{rng.randint(0, 400)}", seq, f"2024-01-{seq // 120 + 1:02d}"))
    seen, per_inv, per_day, want = set(), {}, {}, {}
    for conn, inv, key, seq, day in rows:
        if (conn, inv, key) in seen:
            continue
        seen.add((conn, inv, key))
        if per_inv.get((conn, inv), 0) >= 4:
            verdict = "INVESTIGATION_BUDGET_EXCEEDED"
        elif per_day.get((conn, day), 0) >= 8:
            verdict = "DAILY_BUDGET_EXCEEDED"
        else:
            verdict = "ACCEPTED"
            per_inv[(conn, inv)] = per_inv.get((conn, inv), 0) + 1
            per_day[(conn, day)] = per_day.get((conn, day), 0) + 1
        want[(conn, inv, key)] = verdict
    asked = spark.createDataFrame(rows, "connection_id INT, investigation_id INT, request_key STRING, seq BIGINT, day STRING")
    got = {(r[0], r[1], r[2]): r["verdict"] for r in H.drilldown_budget(asked, 50).collect()}
    assert got == want and len(set(want.values())) == 3
