"""Append-only sinks: reruns add nothing, revisions add rows, the newest ranking wins."""

from datetime import datetime

from tidemark.sources import sinks as S

POINTS = "point_id BIGINT, series_id STRING, period_start TIMESTAMP, extract_id STRING, value DOUBLE"
HOUR = datetime(2026, 8, 1, 10)


def test_points_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [(1, "s", HOUR, "e1", 1.0), (2, "s", HOUR, "e1", 9.0), (3, "s", HOUR, "e2", 2.0), (4, "t", HOUR, "sealed", 3.0)]
    batch = spark.createDataFrame(rows, POINTS)
    empty = spark.createDataFrame([], POINTS)
    extracts = spark.createDataFrame([("sealed", "COMPLETE"), ("e1", "PENDING")], "extract_id STRING, status STRING")
    new = S.append_points(batch, empty, extracts)
    assert sorted(r["point_id"] for r in new.collect()) == [1, 3]  # one per key, none of a sealed extract
    S.write_points(new, path)
    stored = spark.read.parquet(path)
    assert S.append_points(batch, stored, extracts).count() == 0
    late = spark.createDataFrame([(5, "s", HOUR, "e3", 4.0)], POINTS)
    S.write_points(S.append_points(late, stored, extracts), path)
    assert spark.read.parquet(path).count() == 3


def test_newest_ranking_replaces_only_its_incidents(spark, tmp_path):
    path, schema = str(tmp_path / "ranked"), "incident_id INT, hypothesis_key STRING, rank INT"
    S.write_ranked(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], schema), path, 1)
    for _ in range(2):
        S.write_ranked(spark.createDataFrame([(1, "c", 1)], schema), path, 2)
    assert sorted(map(tuple, S.read_ranked(spark, path, schema).collect())) == [(1, "c", 1), (2, "a", 1)]


def test_one_run_key_must_keep_one_identity(spark):
    rows = [(1, "k", "d", "q", "f"), (1, "k", "d", "q", "f"), (1, "m", "d", "q", "f"), (1, "m", "d", "q2", "f")]
    df = spark.createDataFrame(rows, "connection_id INT, run_key STRING, definition STRING, query STRING, freshness STRING")
    assert [r["run_key"] for r in S.extract_conflicts(df).collect()] == ["m"]
