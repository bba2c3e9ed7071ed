"""Append-only sinks: what is new against what is stored, and the writes that add it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import canonical_hash
from tidemark.operators.ordered import first_per_key

POINT_KEYS = ["series_id", "period_start", "extract_id"]


def append_points(points: DataFrame, existing: DataFrame, stored_extracts: DataFrame) -> DataFrame:
    """New rows only: one per (series, period start, extract), none of a COMPLETE stored extract."""
    fresh = first_per_key(points, POINT_KEYS, [F.col("point_id")])
    sealed = stored_extracts.where(F.col("status") == "COMPLETE").select("extract_id")
    return fresh.join(sealed, "extract_id", "left_anti").join(existing.select(*POINT_KEYS), POINT_KEYS, "left_anti")


def write_points(points: DataFrame, path: str) -> None:
    points.withColumn("day", F.to_date("period_start")).write.mode("append").partitionBy("day").parquet(path)


def series_key(*parts: Column | str) -> Column:
    """Identity of a series: tenant or site, source, metric, semantics, granularity, dimensions in order."""
    return canonical_hash(*parts)


def upsert_series(points: DataFrame, series: DataFrame) -> DataFrame:
    """Series not stored yet; the first point (smallest id) of a key describes it."""
    described = first_per_key(points, ["series_key"], [F.col("point_id")])
    return described.join(series.select("series_key"), "series_key", "left_anti")


def extract_conflicts(extracts: DataFrame) -> DataFrame:
    """Run keys reused with another definition, query or freshness.

    Equal minimum and maximum of an identity hash mean one identity, without a distinct count.
    """
    identity = canonical_hash("definition", "query", "freshness")
    return extracts.groupBy("connection_id", "run_key").agg(
        F.count("*").alias("extracts"), F.min(identity).alias("_low"), F.max(identity).alias("_high")
    ).where(F.col("_low") != F.col("_high")).drop("_low", "_high")


def entity_upsert(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity dimension after a batch: first_seen stays, last_seen follows the latest observation."""
    keys = ["site", "kind", "stable_key"]
    seen = observations.select(*keys, F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    return entities.select(*keys, "first_seen", "last_seen").unionByName(seen).groupBy(*keys).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def observation_key(*parts: Column | str) -> Column:
    return canonical_hash(*parts)


def snapshot_append(snapshots: DataFrame, existing: DataFrame) -> DataFrame:
    """Snapshots whose observation key is not stored; a replay within the batch keeps the first."""
    once = first_per_key(snapshots, ["observation_key"], [F.col("snapshot_id")])
    return once.join(existing.select("observation_key"), "observation_key", "left_anti")


def write_ranked(ranked: DataFrame, path: str, version: int) -> None:
    """Store the ranking of the given incidents as one version; writing a version again replaces it."""
    ranked.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_ranked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Current ranking: of each incident the set of its newest version, so stale keys are gone."""
    stored = spark.read.schema(schema + ", version BIGINT").parquet(path)
    newest = stored.groupBy("incident_id").agg(F.max("version").alias("version"))
    return stored.join(newest, ["incident_id", "version"], "left_semi").drop("version")
