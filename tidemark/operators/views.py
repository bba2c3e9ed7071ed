"""Latest-state views kept up to date by increments, and read whole or not at all.

A view is a folder with two tables.  ``data`` holds the newest row of every key, by bucket of the key and
generation; ``versions`` holds one row per finished increment that names the generation each bucket has.
An increment reads only the buckets its keys fall into, writes them as a new generation
with dynamic partition overwrite, and adds its version row last: until that row is there readers see
the version before, whatever the increment has already written.  A repeated increment overwrites its
own half-written partitions and changes nothing a reader sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

VERSION = "version BIGINT, generations MAP<INT, BIGINT>"


def newest(facts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key by ``order``, combined before the shuffle."""
    rest = [c for c in facts.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return facts.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in facts.columns])


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def current_version(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """(version, generation by bucket) of the last finished increment; version 0 has no buckets."""
    try:
        rows = spark.read.schema(VERSION).parquet(f"{folder}/versions")
        last = rows.orderBy(F.col("version").desc()).limit(1).collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0, {}
    return (last[0]["version"], dict(last[0]["generations"])) if last else (0, {})


def _of(spark: SparkSession, folder: str, schema, generations: dict[int, int]) -> DataFrame:
    """Rows of the named partitions only; the filter is on partition columns, so no other folder is opened."""
    schema = schema.add("bucket", IntegerType()).add("generation", LongType())
    if not generations:
        return spark.createDataFrame([], schema).drop("generation")
    named = F.create_map(*[F.lit(x) for b, g in generations.items() for x in (b, g)])
    data = spark.read.schema(schema).parquet(f"{folder}/data").where(F.col("bucket").isin(*generations))
    return data.where(F.col("generation") == named[F.col("bucket")]).drop("generation")


def read_view(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The view as of its last finished increment."""
    return _of(spark, folder, _copy(schema), current_version(spark, folder)[1]).drop("bucket")


def _copy(schema):
    return type(schema)(list(schema.fields))


def apply_increment(spark: SparkSession, folder: str, facts: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int = 32) -> int:
    """Bring the view up to date with ``facts``, in whatever order they come, and return the new version.

    ``order`` tells a key's rows apart; a fact older than what the view holds changes nothing.  One increment runs at a time.
    """
    version, generations = current_version(spark, folder)
    bucketed = facts.withColumn("bucket", bucket_of(keys, buckets))
    # As many rows as there are buckets at most.
    touched = {r["bucket"] for r in bucketed.select("bucket").distinct().collect()}
    if not touched:
        return version
    held = _of(spark, folder, _copy(facts.schema), {b: g for b, g in generations.items() if b in touched})
    merged = newest(held.select(*bucketed.columns).unionByName(bucketed), [*keys, "bucket"], order)
    generation = version + 1
    writer = merged.withColumn("generation", F.lit(generation).cast("bigint")).repartition("bucket").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(f"{folder}/data")
    finish(spark, folder, generation, generations | dict.fromkeys(touched, generation))
    return generation


def finish(spark: SparkSession, folder: str, version: int, generations: dict[int, int]) -> None:
    spark.createDataFrame([(version, generations)], VERSION).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
