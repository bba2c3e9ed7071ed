"""Work and what it holds grow no faster than rows: each case counts what an operator sends on, or holds it against a plain version."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import intervals as V
from tidemark.operators import investigate as I
from tidemark.operators import lineage as L
from tidemark.operators import ordered as O
from tidemark.operators import similarity as S

START = datetime(2024, 1, 1)


def test_net_change_looks_up_snapshots_not_changes(spark, monkeypatch):
    """One snapshot holds many members: its instant meets the windows once, and every change of it follows."""
    snapshots = spark.createDataFrame(
        [(i, 7, START + timedelta(days=i), "F" if i == 1 else "O") for i in range(4)], "snapshot_id BIGINT, url_id BIGINT, at TIMESTAMP, status STRING"
    )
    members = spark.createDataFrame([(s, m) for s in range(4) for m in range(50) if m % 4 <= s], "snapshot_id BIGINT, member BIGINT")
    incidents = spark.createDataFrame([(1, 7, START + timedelta(days=2, hours=5))], "incident_id BIGINT, url_id BIGINT, onset TIMESTAMP")
    met, join = [], L.instant_join
    monkeypatch.setattr(L, "instant_join", lambda points, *rest: met.append(points.count()) or join(points, *rest))
    changes = L.member_changes(snapshots, {"SCRIPT": members}, "url_id")
    found = L.changed_since_lkg(incidents, snapshots, changes, "url_id", F.col("status") == "F").collect()
    assert met == [4] and changes.count() == 50
    assert sorted(int(r.stable_key) for r in found) == [m for m in range(50) if m % 4 == 2]
    assert {(r.lkg_id, r.change, r.events, r.last_changed_at) for r in found} == {(1, "ADDED", 1, START + timedelta(days=2))}


def test_similarity_sends_on_the_best_not_the_pairs(spark):
    """Ninety incidents share one label, 4,005 pairs; each sends on two neighbours from each block it meets."""
    rows = [(i, "all") for i in range(90)] + [(i, f"own{i // 3}") for i in range(90)]
    labels = S.weighted_labels(spark.createDataFrame(rows, "incident_id BIGINT, label STRING"))
    found = S.neighbours(S.indexed(labels, 0.01), labels, 2, 0.01, label_rows=30).collect()
    assert len(found) <= 90 * 2 * 5
    best = {i: {j for j in range(90) if j // 3 == i // 3 and j != i} for i in range(90)}
    assert all(best[i] <= {r.to_incident_id for r in found if r.from_incident_id == i} for i in range(90))


def test_united_spans_hold_the_same_instants(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        begin = rng.randint(0, 900)
        rows.append((rng.choice([None, 1, 2, 3]), START + timedelta(days=begin), START + timedelta(days=begin + rng.randint(-2, 9))))
    rows += [(1, START + timedelta(days=880), None), (4, None, START), (5, START, None), (5, START + timedelta(days=3), START + timedelta(days=4))]
    got = O.merged_spans(spark.createDataFrame(rows, "k INT, a TIMESTAMP, z TIMESTAMP"), ["k"], "a", "z").collect()
    holds = lambda spans, day: {k for k, a, z in spans if a is not None and a <= day and (z is None or z > day)}
    for day in range(0, 1000):
        for hour in (0, 12):
            assert holds(rows, at := START + timedelta(days=day, hours=hour)) == holds(got, at)
            assert sum(a <= at and (z is None or z > at) for k, a, z in got) == len(holds(got, at))
    assert len(got) < len(rows)


def test_packs_refused_by_byte_sums_are_not_unrolled(spark, monkeypatch):
    """Thirty incidents over 400 notes of 1,000 bytes: refused by sums, so no note is looked up for them; the small one is whole."""
    day = lambda n: START + timedelta(days=n)
    incidents = spark.createDataFrame(
        [(i, 1, "a", day(0), day(3)) for i in range(30)] + [(30, 2, "b", day(0), day(3)), (31, 1, "before", day(-9), day(-5))],
        "incident_id INT, site INT, incident_text STRING, window_start TIMESTAMP, window_end TIMESTAMP",
    )
    fact = "site INT, at TIMESTAMP, id BIGINT, entry STRING"
    none = spark.createDataFrame([], fact)
    notes = spark.createDataFrame([(1, day(1), i, "x" * 1000) for i in range(400)] + [(2, day(1), 1, "short"), (1, day(9), 500, None)], fact)
    asked, head = [], I.window_head
    monkeypatch.setattr(I, "window_head", lambda spans, *rest: asked.append(spans.select("incident_id").distinct().count()) or head(spans, *rest))
    packs = {r["incident_id"]: r for r in I.evidence_pack(incidents, none, none, none, none, notes).collect()}
    assert asked == [2] and len(packs) == 32
    assert all(packs[i]["content"] is None for i in range(30))
    assert '"short"' in packs[30]["content"] and '"human_reported_notes":[]' in packs[31]["content"]


def test_a_bin_of_many_pairs_is_cut_on_both_sides(spark):
    """Two hundred points and two hundred open spans share one bin; no part of it compares more than a few of each."""
    points = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("l"), F.lit(START).cast("timestamp").alias("at"))
    spans = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("r"), F.lit(START).cast("timestamp").alias("a"), F.lit(None).cast("timestamp").alias("z"))
    short = V._climbing(V._placed(points, "at", "at", "a"), "a", False, None).where(F.col("_level") == V.TOP)
    long = V._binned(V._placed(spans, "a", "z", "b"), "b", F.array("_b_level"))
    met = V._met(short, long, ["k", "_level", "_bin"], 80)
    assert met.count() == 200 * 200 and met.select("l", "r").distinct().count() == 200 * 200
    shown = met._jdf.queryExecution().analyzed().toString()
    assert "_part_rows" in shown and "_part_cols" in shown
    assert V.instant_join(points, spans, ["k"], "at", ("a", "z"), 80).count() == 200 * 200


def test_points_stay_one_row_where_few_rules_are_cut(spark, monkeypatch):
    """Six hundred points meet forty rules of many lengths: no point climbs a level, and the pairs are all there."""
    rng, met, join = random.Random(8), [], V._met
    monkeypatch.setattr(V, "_met", lambda short, long, *rest, **more: met.append((short.count(), long.count())) or join(short, long, *rest, **more))
    at = lambda hours: START + timedelta(hours=hours)
    points = [(rng.choice([1, 2]), i, at(rng.randint(0, 9_000))) for i in range(600)]
    rules = [(rng.choice([1, 2]), i, at(b := rng.randint(-9_000, 9_000)), None if i % 5 == 0 else at(b + rng.choice([0, 5, 300, 3_000, 9_000, -2]))) for i in range(40)]
    a, b = spark.createDataFrame(points, "k INT, l INT, at TIMESTAMP"), spark.createDataFrame(rules, "k INT, r INT, since TIMESTAMP, until TIMESTAMP")
    got = V.instant_join(a, b, ["k"], "at", ("since", "until")).select("l", "r").collect()
    inside = lambda p, r: p[0] == r[0] and r[2] <= p[2] and (r[3] is None or r[3] >= p[2])
    assert sorted(map(tuple, got)) == sorted((p[1], r[1]) for p in points for r in rules if inside(p, r))
    assert met[0][0] == 600 and met[0][1] <= 2 * 640
    # Windows of six hours: one or two bins each, on one level.
    del met[:]
    windows = a.withColumn("end", F.expr("at + INTERVAL 6 HOURS"))
    got = V.interval_join(windows, b, ["k"], ("at", "end"), ("since", "until")).select("l", "r").collect()
    meets = lambda p, r: p[0] == r[0] and r[2] <= p[2] + timedelta(hours=6) and (r[3] is None or r[3] >= max(r[2], p[2]))
    assert sorted(map(tuple, got)) == sorted((p[1], r[1]) for p in points for r in rules if meets(p, r))
    assert met[0][0] <= 1_200 and met[1] == (0, 0)


def test_short_rules_are_not_cut_into_wide_bins(spark):
    """Rules of an hour beside a few open ones keep their own levels; either way, and without points, the pairs are the same."""
    rng = random.Random(9)
    at = lambda hours: START + timedelta(hours=hours)
    points = [(i, at(rng.randint(0, 40_000))) for i in range(60)]
    for lengths in ([1], [1, 1, 1, None], [None], [20_000, None]):
        rules = [(i, at(b := rng.randint(-500, 40_000)), None if (n := rng.choice(lengths)) is None else at(b + n)) for i in range(300)]
        b = spark.createDataFrame(rules, "r INT, since TIMESTAMP, until TIMESTAMP")
        for held in (points, []):
            a = spark.createDataFrame(held, "l INT, at TIMESTAMP")
            got = V.instant_join(a, b, [], "at", ("since", "until")).select("l", "r").collect()
            assert sorted(map(tuple, got)) == sorted((p[0], r[0]) for p in held for r in rules if r[1] <= p[1] and (r[2] is None or r[2] >= p[1]))


def test_only_snapshots_of_a_window_are_compared(spark):
    """Ninety snapshots, four of them inside the window of an incident: the members of these alone are held against those before."""
    snapshots = spark.createDataFrame([(i, i % 2, START + timedelta(days=i), "F" if i in (40, 41) else "O") for i in range(90)], "snapshot_id BIGINT, url_id BIGINT, at TIMESTAMP, status STRING")
    members = spark.createDataFrame([(s, m) for s in range(90) for m in range(20) if (s // 2 + m) % 3], "snapshot_id BIGINT, member BIGINT")
    incidents = spark.createDataFrame([(1, 0, START + timedelta(days=48, hours=5)), (2, 1, START)], "incident_id BIGINT, url_id BIGINT, onset TIMESTAMP")
    healthy = F.col("status") == "F"
    moments = L.since_lkg(incidents, snapshots, "url_id", healthy)
    changes, every = (L.member_changes(snapshots, {"SCRIPT": members}, "url_id", w) for w in (moments, None))
    assert {r.snapshot_id for r in changes.collect()} == {42, 44, 46, 48} and every.count() > changes.count()
    got, whole = (L.changed_since_lkg(incidents, snapshots, c, "url_id", healthy, m).collect() for c, m in ((changes, moments), (every, None)))
    assert sorted(map(str, got)) == sorted(map(str, whole)) and got
