"""Baselines, state machines, interval joins and net change against plain Python, on keys that hold most of the rows."""

from __future__ import annotations

import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies as A
from tidemark.operators import baseline as B
from tidemark.operators import events as E
from tidemark.operators import intervals as I
from tidemark.operators import machines as M
from tidemark.operators.external import external_relevance
from tidemark.operators.ordered import time_bucket

START = datetime(2024, 2, 1)


# --- baselines --------------------------------------------------------------------------------
def plain_cell(at, zone):
    local = at.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    week = (local.date() - datetime(1970, 1, 5).date()).days // 7
    return week, local.weekday() * 24 + local.hour


@pytest.mark.parametrize("weeks", [1, 3, 8])
def test_baseline_equals_a_fold(spark, weeks):
    rng = random.Random(weeks)
    rows = []
    for i in range(6000):
        # One series holds nine of ten points, all in few hours of the week, over both clock changes of its zone.
        hot = rng.random() < 0.9
        at = START + timedelta(weeks=rng.randint(0, 40), days=rng.choice([5, 6]), hours=rng.randint(0, 4)) if hot else START + timedelta(hours=rng.randint(0, 40 * 168))
        value = rng.choice([0.0, -0.0, 1.0, 2.5, -7.25, rng.random() * 1000, -rng.random(), None, float("nan"), 1e300])
        rows.append(("hot" if hot else f"s{i % 3}", at, value, "America/New_York" if hot else "Australia/Lord_Howe"))
    frame = spark.createDataFrame(rows, "series_id STRING, period_start TIMESTAMP, value DOUBLE, zone STRING")
    cells = defaultdict(list)
    for series, at, value, zone in rows:
        if value is not None and value == value:
            week, hour = plain_cell(at, zone)
            cells[series, hour, week].append(value)
    wanted = {}
    for series, hour, week in {(s, h, w + k) for s, h, w in cells for k in range(1, weeks + 1)}:
        held = sorted(v for k in range(1, weeks + 1) for v in cells.get((series, hour, week - k), []))
        if len(held) >= 2:
            wanted[series, hour, week] = (len(held), statistics.median(held))
    got = {(r.series_id, r.hour_of_week, r.week): r for r in B.hour_week_baseline(frame, weeks).collect()}
    assert set(got) == set(wanted)
    for key, (n, median) in wanted.items():
        assert got[key].points == n
        assert got[key].expected == pytest.approx(median, rel=1e-12, abs=1e-12)
        assert (got[key].trained_to - got[key].trained_from).days == 7 * weeks


def test_clock_changes(spark):
    at = ["2024-11-03 05:30:00", "2024-11-03 06:30:00", "2024-03-10 06:30:00", "2024-03-10 07:30:00"]
    frame = spark.createDataFrame([(a,) for a in at], "a STRING").select(F.col("a").cast("timestamp").alias("a"), F.lit("America/New_York").alias("z"))
    hours = [r[0] for r in frame.select(B.local_cell(F.col("a"), F.col("z"))[1]).collect()]
    assert hours == [145, 145, 145, 147]


# --- machines ---------------------------------------------------------------------------------
@pytest.mark.parametrize("states", [2, 4])
def test_machine_equals_a_fold(spark, states):
    rng = random.Random(states)
    rows = [
        (0 if rng.random() < 0.9 else rng.randint(1, 4), START + timedelta(minutes=rng.randint(0, 5000)), i, [rng.randrange(states) for _ in range(states)])
        for i in range(3000)
    ]
    frame = spark.createDataFrame(rows, "k INT, at TIMESTAMP, id BIGINT, moves ARRAY<INT>")
    active = [states - 1]
    for width in (600, 86_400):
        got = M.run_machine(frame, ["k"], ["at", "id"], F.col("moves"), states, active, time_bucket("at", width))
        found = {r.id: (r.state_before, r.state_after, r.ordinal) for r in got.collect()}
        assert len(found) == len(rows)
        for k in range(5):
            state = count = 0
            for _, _, i, moves in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                before, state = state, moves[state]
                count += state in active and before not in active
                assert found[i] == (before, state, count)


def test_machine_over_many_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(conf)
    spark.conf.set(conf, "7")
    try:
        test_machine_equals_a_fold(spark, 3)
    finally:
        spark.conf.set(conf, held)


def test_lifecycle_of_runs_that_speak_twice(spark):
    rows = [
        (1, 1, 0, "SUPPORT", "HIGH", 1, 1), (1, 1, 1, "UPSERT", "LOW", 2, 3),  # what came before the opening does not count
        (2, 2, 0, "SUPPORT", "MEDIUM", 1, 1), (2, 2, 1, "RESOLVE", "LOW", 0, 0),  # already linked: ignored
        (3, 3, 0, "RESOLVE", "LOW", 0, 0), (3, 3, 1, "UPSERT", "HIGH", 4, 4),  # closes, and opens the next
        (4, 4, 0, "RESOLVE", "LOW", 0, 0), (5, 5, 0, "RESOLVE", "LOW", 0, 0),
    ]
    frame = spark.createDataFrame(
        [("c", datetime(2026, 1, d), run, seq, action, severity, a, v) for d, run, seq, action, severity, a, v in rows],
        "key STRING, at TIMESTAMP, run_id BIGINT, seq INT, action STRING, severity STRING, affected_count BIGINT, valid_count BIGINT",
    )
    got = E.condition_lifecycle(frame, ["key"], ["at", "run_id", "seq"]).orderBy("episode").select(
        "episode", "opened_by", F.dayofmonth("detected_at"), F.dayofmonth("ended_at"), "severity", "supporting_count", "affected_count", "status"
    )
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1, 3, "MEDIUM", 2, 2, "RESOLVED"), (2, 3, 3, 4, "HIGH", 1, 4, "RESOLVED")]


def test_hysteresis(spark):
    # expected 10: sizes of the fall are 0.1 0.6 0.3 0.6 0.9 0.3 (unjudged 0.0) 0.6 0.2 0.7 0.8
    values = [9, 4, 7, 4, 1, 7, None, 4, 8, 3, 2]
    rows = [("s", i, START + timedelta(hours=i), START + timedelta(hours=i + 1), None if v is None else float(v), None if v is None else 10.0, "MATURE") for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "series_id STRING, point_id BIGINT, period_start TIMESTAMP, period_end TIMESTAMP, value DOUBLE, expected DOUBLE, freshness STRING")
    frame = frame.withColumn("deviation", (F.col("value") - F.col("expected")) / F.col("expected")).withColumn("trained_points", F.lit(9))
    got = A.anomaly_episodes(frame, ["series_id"], bucket_s=7200).where("direction = 'BELOW'").orderBy("started_at").collect()
    hours = lambda t: None if t is None else int((t - START).total_seconds() // 3600)
    # A single exceedance does not start one; the middle band keeps one open; an unjudged hour changes nothing.
    assert [(hours(r.started_at), hours(r.detected_at), hours(r.ended_at), r.persistence_buckets, r.observed_value, r.status) for r in got] == [
        (3, 5, 8, 4, 1.0, "RESOLVED"), (9, 11, None, 2, 2.0, "ACTIVE")
    ]


# --- interval joins ---------------------------------------------------------------------------
def spans(rng, n, hot, longest):
    out = []
    for i in range(n):
        start = START + timedelta(minutes=rng.randint(-(10**6), 10**6))
        end = None if rng.random() < 0.05 else start + timedelta(minutes=int(longest ** rng.random()) - 1)
        out.append((0 if rng.random() < hot else rng.randint(1, 3), i, start, end))
    out += [(0, n, None, START), (0, n + 1, START, START - timedelta(hours=1)), (0, n + 2, START, START), (0, n + 3, datetime(1960, 1, 1), datetime(1960, 1, 2))]
    return out


@pytest.mark.parametrize("split", [None, 5, 100_000])
def test_interval_join_equals_all_pairs(spark, split):
    rng = random.Random(3)
    left, right = spans(rng, 250, 0.9, 200_000), spans(rng, 250, 0.9, 2_000)
    a = spark.createDataFrame(left, "k INT, l BIGINT, s TIMESTAMP, e TIMESTAMP")
    b = spark.createDataFrame(right, "k INT, r BIGINT, s2 TIMESTAMP, e2 TIMESTAMP")
    far = datetime(9999, 1, 1)
    fine = lambda x: x[2] is not None and (x[3] is None or x[3] >= x[2])
    wanted = sorted(
        (x[1], y[1]) for x in left for y in right
        if fine(x) and fine(y) and x[0] == y[0] and x[2] <= (y[3] or far) and y[2] <= (x[3] or far)
    )
    got = I.interval_join(a, b, ["k"], ("s", "e"), ("s2", "e2"), split)
    assert got.columns == ["k", "l", "s", "e", "r", "s2", "e2"]
    assert sorted((r.l, r.r) for r in got.collect()) == wanted and len(wanted) > 1000
    points = a.select("k", "l", F.col("s").alias("at"))
    inside = sorted((x[1], y[1]) for x in left for y in right if x[2] is not None and fine(y) and x[0] == y[0] and y[2] <= x[2] <= (y[3] or far))
    assert sorted((r.l, r.r) for r in I.instant_join(points, b, ["k"], "at", ("s2", "e2"), split).collect()) == inside


def test_interval_join_of_many_meets_little_more_than_it_returns(spark):
    """10^5 by 10^5 intervals of very different lengths, a third of them on one key: what meets in bins stays near the output."""
    side = lambda seed, id_, s, e: spark.range(100_000).select(
        F.when(F.rand(seed) < 0.33, 0).otherwise((F.rand(seed + 1) * 1000).cast("int")).alias("k"), F.col("id").alias(id_),
        F.timestamp_seconds(1_700_000_000 + (F.rand(seed + 2) * 3e8).cast("bigint")).alias(s), F.pow(10, 1 + F.rand(seed + 3) * 4.5).cast("bigint").alias("len"),
    ).withColumn(e, F.timestamp_seconds(F.unix_seconds(s) + F.col("len"))).drop("len")
    a, b = side(1, "l", "s", "e"), side(11, "r", "s2", "e2")
    scope = ["k", "_level", "_bin"]
    pa, pb = I._placed(a, "s", "e", "a"), I._placed(b, "s2", "e2", "b")
    low = I._met(I._climbing(pa, "a", False, None), I._binned(pb, "b", F.array("_b_level")), scope, None).count()
    high = I._met(I._climbing(pb, "b", True, None), I._binned(pa, "a", F.array("_a_level")), scope, None).count()
    out = I.interval_join(a, b, ["k"], ("s", "e"), ("s2", "e2")).count()
    assert out > 10_000 and low + high < 12 * out


def test_open_incidents_are_compared_in_many_tasks(spark):
    """Few bytes make many pairs: blocks of both sides are dealt over all shuffle partitions, not merged by size."""
    incidents = spark.range(30).selectExpr("id AS incident_id", "1 AS site", "'A' AS product", "array('x') AS segments", "timestamp'2024-01-01' AS onset", "CAST(NULL AS TIMESTAMP) AS ended")
    events = spark.range(40).selectExpr(
        "id AS event_id", "element_at(array('A', 'B', NULL), CAST(id % 3 + 1 AS INT)) AS event_product", "array('x', 'z', 'y') AS scope", "timestamp'2024-02-01' AS started_at", "CAST(NULL AS TIMESTAMP) AS event_ended"
    )
    found = external_relevance(incidents, events)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 4
    rows = found.collect()
    assert len(rows) == 30 * 40
    assert {(r.external_event_id % 3, r.relation, r.reason) for r in rows} == {
        (0, "NOT_MATCHING_SEGMENT", "same product; scope not held by the incident: y,z"), (1, "CONTEXT", "overlaps in time; concerns B"), (2, "CONTEXT", "overlaps in time; the event names no product")
    }
