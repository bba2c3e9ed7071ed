"""Retention eligibility, holds and audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalogs import RETENTION_DAYS
from tidemark.functions.shape import either


def retention_eligible(artifacts: DataFrame, now: Column) -> DataFrame:
    """RAW_MEDIUM artifacts of a known type past their age; unknown types never qualify."""
    days = either(*[(F.col("artifact_type") == k, F.lit(v)) for k, v in RETENTION_DAYS.items()])
    aged = F.unix_micros("created_at") <= F.unix_micros(now) - days * F.lit(86_400_000_000)
    return artifacts.where((F.col("retention_class") == "RAW_MEDIUM") & aged)


def active_holds(holds: DataFrame) -> DataFrame:
    return holds.where(F.col("released_at").isNull()).select("artifact_id").distinct()


def hold_filter(eligible: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deletable, held)"""
    held = active_holds(holds)
    return eligible.join(held, "artifact_id", "left_anti"), eligible.join(held, "artifact_id", "left_semi")


def retention_order(eligible: DataFrame) -> DataFrame:
    """Oldest first, as a distributed sort."""
    return eligible.orderBy("created_at", "artifact_id")


def retention_audit(artifacts: DataFrame, holds: DataFrame, now: Column) -> DataFrame:
    """Eligible, held and deletable counts per artifact type in one join."""
    marked = retention_eligible(artifacts, now).join(
        active_holds(holds).withColumn("held", F.lit(True)), "artifact_id", "left"
    )
    held = F.coalesce("held", F.lit(False))
    return marked.groupBy("artifact_type").agg(
        F.count("*").alias("eligible"), F.count_if(held).alias("held"), F.count_if(~held).alias("deletable")
    )
