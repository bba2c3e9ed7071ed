"""What several branches read is made once, and tasks are cut by what they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import chain as N
from tidemark.operators import config_text as K
from tidemark.operators import lineage as L
from tidemark.operators.sessions import span_sessions
from tidemark.session import apply_job_conf


def plan(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_robots_files_are_parsed_once(spark, capsys):
    text = "User-agent: *\nDisallow:\t/a b \nAllow: /%7eC\xe9%2f:x\n\nUser-agent: bot # x\nDisallow:\n"
    files = spark.createDataFrame([(1, text)], "file_id BIGINT, text STRING")
    rules = K.robots_rules(files)
    assert sorted(map(tuple, rules.collect()), key=str) == [
        (1, "*", "allow", "/~C%C3%A9%2F:x"), (1, "*", "disallow", "/a%20b"), (1, "bot", None, None),
    ]
    assert "posexplode" not in plan(rules, capsys)


def test_visible_ascii_is_kept_and_the_rest_taken_apart(spark):
    values = ["/a/b?c=*$", "/a%41%2f", "/%zz", "/a\n", "/\xe9 ", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v STRING").select(U.norm_octets(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == ["/a/b?c=*$", "/aA%2F", "/%25zz", "/a%0A", "/%C3%A9%20", "", None]


def test_short_chains_stay_in_columns_and_long_ones_share_calls(spark, capsys):
    rows = [(k, t, v) for k in range(50) for t, v in ((0, 0.0), (10, 0.0), (20, 1.0), (30, 0.0), (5000, 0.0))]
    got = span_sessions(spark.createDataFrame(rows, "k INT, t BIGINT, v DOUBLE"), ["k"], 1000, 5000)
    assert "FlatMapGroupsInPandas" not in plan(got, capsys)
    assert sorted(tuple(r) for r in got.where("k = 7").collect()) == [(7, 0.0, 0.0, 1, 0.0), (7, 10.0, 10.0, 1, 0.0), (7, 20.0, 30.0, 2, 1.0), (7, 5000.0, 5000.0, 1, 0.0)]
    assert got.count() == 200


def test_changes_are_found_once(spark, capsys):
    changes = spark.range(7).select((F.col("id") % 2).alias("snapshot_id"), F.lit("DOM").alias("component"), F.lit("X").alias("kind"), F.col("id").cast("string").alias("stable_key"))
    got = L.bounded_changes(changes, 3)
    assert "Range" not in plan(got, capsys)
    assert sorted((r.snapshot_id, r.position, r.change_count, r.truncated) for r in got.collect()) == [
        (0, 1, 4, True), (0, 2, 4, True), (0, 3, 4, True), (1, 1, 3, False), (1, 2, 3, False), (1, 3, 3, False),
    ]


def test_more_rows_make_more_tasks(spark):
    apply_job_conf(spark)
    keys = spark.range(0, 4_000_000, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    tasks = keys.groupBy("k").count().select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_episodes_work_their_candidates_out_once(spark, capsys):
    found = spark.range(6).selectExpr(
        "0 AS section", "1L AS site", "timestamp_seconds(id) AS scheduled_for", "2L AS template_id", "3L AS scenario_id", "id % 2 AS url_id", "id AS run_id",
        "'JS_ERROR_STARTED' AS code", "'e' AS subject", "CASE WHEN id < 2 THEN 'UPSERT' WHEN id < 3 THEN 'RESOLVE' WHEN id < 4 THEN 'SUPPORT' ELSE 'RECORD' END AS action",
        "'MEDIUM' AS severity", "timestamp_seconds(id) AS detected_at", "1L AS affected_count", "1L AS valid_count", "1L AS runs",
    )
    episodes = N.event_episodes(found)
    assert "Range" not in plan(episodes, capsys)
    assert sorted((r.url_id, r.episode, r.supporting_count, r.status) for r in episodes.collect()) == [(0, 1, 1, "RESOLVED"), (1, 1, 2, "ACTIVE")]
