"""Session settings and the shared working folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RANK_TRIM_LIMIT = 10_000

# Runtime settings every job relies on; cluster sizing stays with the cluster.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tasks are cut by what they read, so what one sorts or keeps in a map stays small however large the input is.
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Ranks up to this bound are trimmed on the map side, so hot keys shuffle only their heads.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(RANK_TRIM_LIMIT),
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_job_conf(spark: SparkSession) -> SparkSession:
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the checkpoint folder the cluster names.

    Only where the session names none and runs in one process (tests) a temporary folder stands in; on a cluster the
    executors would not share it, and what they write there would be read back in part without an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the working folder and read again, for what several branches of a job read."""
    spark = frame.sparkSession
    path = work_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
