"""Evidence beyond the bounds that used to cut it: every row and every character counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import evidence as V

NET = "run_id BIGINT, url STRING, resource_type STRING, status INT, error_text STRING, at_ms BIGINT"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def requests(n, last="zzz"):
    rows = [(1, f"https://h{i}.example.com/a", "script", 200, None, i) for i in range(n)]
    return [*rows, (1, f"https://{last}.example.com/a", "script", 200, None, 5)]


def test_state_hashes_cover_all_identities(spark):
    a, b = (spark.createDataFrame(requests(2_500, last), NET) for last in ("zzz", "zzy"))
    states = [V.network_state(V.network_agg(f)).first() for f in (a, b)]
    assert [s["dependencies"] for s in states] == [2_501, 2_501] and states[0]["state_hash"] != states[1]["state_hash"]
    scripts = [V.script_set(f.select("run_id", "url")).first() for f in (a, b)]
    assert [s["scripts"] for s in scripts] == [2_501, 2_501] and scripts[0]["state_hash"] != scripts[1]["state_hash"]
    again = V.network_state(V.network_agg(a.orderBy(F.rand(3)).repartition(7))).first()
    assert again["state_hash"] == states[0]["state_hash"]


def test_phases_and_counts_are_whole(spark):
    frame = spark.createDataFrame(requests(2_500), NET)
    consent = spark.createDataFrame([(1, 1_000, "ACCEPT")], "run_id BIGINT, boundary_ms BIGINT, consent_path STRING")
    assert V.consent_phase_agg(frame, consent).count() == 2_501
    videos = spark.range(10_005).select(
        F.lit(1).cast("bigint").alias("run_id"), F.lit("https://v.example.com/vast/x").alias("url"), F.lit("xhr").alias("resource_type"),
        F.lit(200).alias("status"), F.lit(None).cast("string").alias("error_text"),
    )
    players = spark.createDataFrame([(1, "p")], "run_id BIGINT, player STRING")
    assert V.video_attribution(videos, players).first()["vast"] == 10_005
    bids = spark.range(1_500).select(
        F.lit(1).alias("run_id"), F.lit("a").alias("auction_key"), F.lit("b").alias("bidder"), F.lit("bidResponse").alias("event_type"),
        F.col("id").alias("seq"), F.col("id").cast("double").alias("response_ms"),
    )
    row = V.bidder_agg(bids).first()
    assert (row["response_max"], row["response_avg"], row["responses"]) == (1_499.0, 749.5, 1_500)
    slots = spark.range(250).select(
        F.lit(1).alias("run_id"), F.col("id").alias("pos"), F.concat(F.lit("/net/"), F.col("id").cast("string")).alias("ad_unit_path"), F.lit("x").alias("element_id")
    )
    assert V.slot_rows(slots).count() == 250


def test_texts_are_read_whole(spark):
    assert one(spark, T.challenge_marker(F.lit("x" * 150_000 + " Access Denied"))) == "access denied"
    assert one(spark, T.mask_volatile(F.lit("word " * 100 + "end"))).endswith("end")
    assert one(spark, T.safe_tokens(F.lit(" ".join(f"t{chr(97 + i)}" for i in range(26))))).count(" ") == 25
    long = "segment-" * 20
    assert one(spark, T.path_family(F.lit(f"/{long}a"))) != one(spark, T.path_family(F.lit(f"/{long}b")))
    assert one(spark, T.path_family(F.lit("/" + "f" * 130))) == "/:id"
    assert one(spark, T.consent_hash(F.lit("c" * 10_001))) != one(spark, T.consent_hash(F.lit("c" * 10_002)))
    assert one(spark, T.slot_key(F.lit(None).cast("string"), F.lit("e" * 400))) == "gpt|dom|" + "e" * 400
    assert one(spark, U.is_media(F.lit("/" + "a" * 3_000 + ".mp4"), F.lit("xhr"))) is True
    target = "https://site.example.com/" + "p" * 3_000
    assert one(spark, U.canonical_url(F.lit(target), F.lit("https://site.example.com/"))) == target
    assert one(spark, U.resource_type(F.lit("K" * 60))) == "k" * 60


def test_many_shifts_and_samples(spark):
    import json

    body = {"supported_entry_types": ["layout-shift", "event", "largest-contentful-paint"], "was_hidden": False, "lcp_candidates": [1.0] * 2_500 + [9.0],
            "layout_shifts": [[0.0, 0.0]] * 2_500 + [[10.0, 4.0], [20.0, 5.0]], "interactions": [[1.0, 2.0]] * 2_500 + [[3.0, 70.0]], "errors": ["NOISE"] * 30 + ["SNAPSHOT_ERROR"]}
    row = V.perf_summary(spark.createDataFrame([(1, json.dumps(body))], "run_id BIGINT, payload STRING")).first()
    assert (row["lcp_ms"], row["inp_ms"], row["cls"]) == (9.0, 70.0, 9.0)
    assert "performance_observer_partial_error" in row["limitations"]
