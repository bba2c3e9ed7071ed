"""Anomaly episodes: persistent deviations from a baseline, entered and left at different thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shape import either
from tidemark.operators.baseline import METHOD, VERSION
from tidemark.operators.machines import run_machine
from tidemark.operators.ordered import DAY, time_bucket

DIRECTIONS = ("BELOW", "ABOVE")


def hysteresis(size: Column, judged: Column, enter: float, leave: float, persist: int) -> Column:
    """Transition over the states 0 (normal), 1 to persist - 1 (exceeding so many buckets) and persist (anomalous).

    A deviation of ``enter`` or more counts one further and keeps an anomaly; below ``leave`` everything ends; in between an
    anomaly goes on but nothing pending does.  Rows that are not judged change nothing.
    """
    same = list(range(persist + 1))
    numbers = lambda states: F.array(*[F.lit(s) for s in states])
    return either(
        (~F.coalesce(judged, F.lit(False)), numbers(same)),
        (size >= enter, numbers([min(s + 1, persist) for s in same])),
        (size < leave, numbers([0] * (persist + 1))),
        otherwise=numbers([0] * persist + [persist]),
    )


def anomaly_episodes(
    points: DataFrame, keys: list[str], enter: float = 0.5, leave: float = 0.25, persist: int = 2, min_volume: float = 1.0, bucket_s: int = DAY
) -> DataFrame:
    """Episodes per key and direction, open ones included.

    Points: keys, point_id, period_start, period_end, value, expected, deviation, freshness, trained_points.  Only mature
    points of enough expected volume are judged.  An episode starts with the first of the buckets that exceed, is detected with the
    last of the ``persist`` that make it one, and ends at the bucket that falls below ``leave``; observed, expected and
    deviation are those of its largest deviation, the earliest of equals.
    """
    judged = (F.col("freshness") == "MATURE") & (F.abs("expected") >= min_volume) & F.col("deviation").isNotNull()
    size = F.when(F.col("direction") == "BELOW", -F.col("deviation")).otherwise(F.col("deviation"))
    both = points.withColumn("direction", F.explode(F.array(*map(F.lit, DIRECTIONS)))).withColumn("_judged", F.coalesce(judged, F.lit(False)))
    both = both.withColumn("_size", size)
    moved = run_machine(
        both, [*keys, "direction"], ["period_start", "point_id"], hysteresis(F.col("_size"), F.col("_judged"), enter, leave, persist),
        persist + 1, list(range(1, persist + 1)), time_bucket("period_start", bucket_s),
    )
    inside = F.col("_judged") & (F.col("state_after") > 0)
    peak = F.struct(F.col("_size").alias("size"), (-F.unix_micros("period_start")).alias("early"), (-F.col("point_id")).alias("id"), "value", "expected", "deviation")
    grown = F.col("state_after") == persist
    groups = moved.where((F.col("state_before") > 0) | (F.col("state_after") > 0)).groupBy(*keys, "direction", F.col("ordinal").alias("episode")).agg(
        F.min(F.when(inside, F.col("period_start"))).alias("started_at"),
        F.min(F.when(grown, F.col("period_end"))).alias("detected_at"),
        F.min(F.when(F.col("state_after") == 0, F.col("period_start"))).alias("ended_at"),
        F.count_if(inside).alias("persistence_buckets"),
        F.max(F.when(inside, peak)).alias("_peak"),
    )
    found = groups.where(F.col("detected_at").isNotNull())
    severity = either((F.col("_peak.size") >= 4 * enter, "CRITICAL"), (F.col("_peak.size") >= 2 * enter, "HIGH"), otherwise="MEDIUM")
    return found.select(
        *keys, "direction", "started_at", "ended_at", "detected_at", F.lit(METHOD).alias("baseline_method"), F.lit(VERSION).alias("baseline_version"),
        F.col("_peak.value").alias("observed_value"), F.col("_peak.expected").alias("expected_value"), F.col("_peak.deviation").alias("deviation"),
        "persistence_buckets", severity.alias("severity"), F.when(F.col("ended_at").isNull(), "ACTIVE").otherwise("RESOLVED").alias("status"),
    )
