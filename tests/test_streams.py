"""Streams fed in several steps end where the batch form of the same rows ends."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark import catalogs
from tidemark.operators import events as E
from tidemark.operators import metrics as M
from tidemark.plans import catalogue  # noqa: F401
from tidemark.plans.lake import TABLES, Lake
from tidemark.plans.stream_queries import RATIO_SCHEMA, StreamLake
from tidemark.streaming import jobs as J
from tidemark.streaming import runner as R

SF = "/root/testdata/sf0.001"


class StepLake(StreamLake):
    def table(self, name):
        return R.read_stream(self.spark, TABLES[name], self.sf_dir, 1)


def step_through(spark, table, parts, tmp_path, build, purpose, mode="append", **options):
    """Add one file at a time and continue from the checkpoint."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = build(StepLake(Lake(spark, source), table))
        R.run_available(stream, purpose, mode, folder=folder, **options)
    return folder


def split(df, order, n=3):
    edges = df.approxQuantile(order, [i / n for i in range(1, n)], 0.0)
    bounds = [float("-inf"), *edges, float("inf")]
    return [df.where((F.col(order) > lo) & (F.col(order) <= hi)) for lo, hi in zip(bounds, bounds[1:])]


def test_conditions_survive_restarts(spark, tmp_path):
    orders = Lake(spark, SF).orders
    parts = [p.drop("_s") for p in split(orders.withColumn("_s", F.unix_seconds("o_orderdate").cast("double")), "_s")]
    folder = step_through(spark, "orders", parts, tmp_path, lambda t: J.stream_conditions(t.actions), "conditions", "update")
    rows = R.latest_version(R.sink(spark, folder, J.CONDITION_OUT), ["condition_key", "episode"])
    columns = ["condition_key", "episode", "detected_at", "ended_at", "severity", "supporting_count", "affected_count", "valid_count"]
    batch = E.condition_lifecycle(Lake(spark, SF).actions, ["condition_key"], ["at", "run_id", "seq"]).select(*columns)
    assert sorted(map(str, rows.select(*columns).collect())) == sorted(map(str, batch.collect()))


def test_late_points_add_revisions_and_the_newest_equals_the_batch(spark, tmp_path):
    events = Lake(spark, SF).events
    # Odd events arrive first, so the second step is late for every interval.
    parts = [events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0")]
    roles = catalogs.ratio_roles(spark)
    schema = R.schema_text(Lake(spark, SF).points)
    folder = step_through(
        spark, "events", parts, tmp_path, lambda t: t.points, "reconcile", writer=J.late_reconcile(roles, schema, RATIO_SCHEMA)
    )
    rows = R.sink(spark, folder, RATIO_SCHEMA)
    keys = ["site", "ratio_code", "period_start"]
    batch = {tuple(r[:3]): r["derivation_key"] for r in M.ratio_derive(Lake(spark, SF).points, roles).where("alignment = 'OK'").select(*keys, "derivation_key").collect()}
    stored = {r["derivation_key"] for r in rows.collect()}
    assert set(batch.values()) <= stored
    assert rows.count() == len(stored)
    first = M.ratio_derive(Lake(spark, SF).points.where("point_id % 2 = 1"), roles).where("alignment = 'OK'").select("derivation_key").collect()
    assert {r[0] for r in first} <= stored  # never overwritten


def test_duplicate_points_are_taken_once_across_steps(spark, tmp_path):
    events = Lake(spark, SF).events
    folder = step_through(spark, "events", [events, events], tmp_path, lambda t: J.stream_points(t.points), "points")
    stream = Lake(spark, SF).points
    got = R.sink(spark, folder, R.schema_text(stream)).select("series_id", "period_start", "extract_id")
    assert got.count() == got.distinct().count() == stream.select("series_id", "period_start", "extract_id").distinct().count()


def test_rows_of_a_key_are_ordered_without_a_frame(monkeypatch):
    """every key of every trigger sorted a frame; the order stays that of sort_values, nulls last."""
    import random

    import pandas as pd

    from tidemark.streaming.jobs import in_order

    rng = random.Random(5)
    rows = pd.DataFrame({"at": [pd.Timestamp(rng.randrange(9), unit="s") for _ in range(60)], "run_id": [rng.randrange(4) for _ in range(60)], "seq": [rng.randrange(2) for _ in range(60)], "no": range(60)})
    holes = rows.assign(at=rows["at"].mask(rows["no"] % 7 == 0), seq=rows["seq"].astype("float64").mask(rows["no"] % 5 == 0))
    order = ["at", "run_id", "seq"]
    want, want_holes = (x.sort_values([*order, "no"])["no"].tolist() for x in (rows, holes))
    assert in_order(holes, [*order, "no"])["no"] == want_holes
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    assert in_order(rows, order)["no"] == want


def test_conditions_share_a_few_states(spark, tmp_path, monkeypatch):
    """Three thousand keys, one null and some above 2^53, in sixteen states: in three steps they end as a plain fold does."""
    monkeypatch.setattr(J, "CONDITION_GROUPS", 16)
    rng, n, start = random.Random(2), 3_000, datetime(2026, 1, 1)
    rows = [
        (rng.choice([None, *range(n)]), start + timedelta(hours=rng.randint(0, 59)), k // 2, k % 2, rng.choice(["UPSERT", "SUPPORT", "RESOLVE"]), rng.choice(["LOW", "HIGH"]), rng.randint(0, 9), rng.randint(0, 9))
        for k in range(3 * n)
    ]
    rows += [(None, start + timedelta(hours=h), h, 0, "UPSERT" if h % 3 else "RESOLVE", "LOW", h, h) for h in range(60)]
    rows += [(2**60 + k, start, k, 0, "UPSERT", "LOW", 1, 2) for k in range(3)]
    schema = "condition_key BIGINT, at TIMESTAMP, run_id BIGINT, seq INT, action STRING, severity STRING, affected_count BIGINT, valid_count BIGINT"
    source, folder = f"{tmp_path}/actions", f"{tmp_path}/sink"
    for step in range(3):
        part = [r for r in rows if (r[1] - start) // timedelta(hours=20) == step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        R.run_available(J.stream_conditions(R.read_stream(spark, schema, source)), "conditions", "update", folder=folder)
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() == 16
    expected = set()
    for key in {r[0] for r in rows}:
        now, count, last = None, 0, None
        for _, at, run, _, action, severity, hit, seen in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:4]):
            again, last = run == last, run
            if now and again:
                continue
            if not now and action == "UPSERT":
                count, now = count + 1, (at, None, severity, 1, hit, seen)
            elif now and action == "RESOLVE":
                expected.add((key, count, now[0], at, *now[2:]))
                now = None
            elif now:
                now = (now[0], None, min(now[2], severity), now[3] + 1, max(now[4], hit), max(now[5], seen))
        if now:
            expected.add((key, count, *now))
    found = R.latest_version(R.sink(spark, folder, J.CONDITION_OUT), ["condition_key", "episode"])
    got = [tuple(r) for r in found.select(*[c.split()[0] for c in J.CONDITION_OUT.split(", ")]).collect()]
    assert len(got) == len(expected) and set(got) == expected
