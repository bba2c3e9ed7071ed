"""Helpers of the corpus operators: table access, working tables, streams of sorted groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_folder

# Session settings that bound what a Python worker holds at once, where the cluster has set none.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = work_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it new to docs (Spark compares names without case)."""
    known = {c.lower() for c in docs.columns}
    while name.lower() in known:
        name += "_"
    return name


def shielded(docs: DataFrame, reserved: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns out of the way of reserved names, and what gives a result docs' columns back.

    Names with a dot move as well: Spark's Python passes take them for fields.
    """
    names, held = docs.columns, docs
    taken = {r.lower() for r in reserved}
    moved = {}
    for column in names:
        if column.lower() in taken or "." in column:
            moved[column] = free_name(held, column.replace(".", "_") + "__")
            held = held.withColumnRenamed(column, moved[column])
    return held, lambda result: result.select(*(F.col(f"`{moved.get(c, c)}`").alias(c) for c in names))


def in_batches(frame: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInPandas in Arrow batches small enough for whole texts: fewer rows, and fewer bytes where Spark bounds those."""
    conf = frame.sparkSession.conf
    for key, most in BATCH_BOUNDS.items():
        if conf.get(key, None) is None:
            conf.set(key, str(most))
    return frame.mapInPandas(function, schema)


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a stream sorted by keys into whole groups; holds one group and one batch at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if frame.empty:
            continue
        change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        cuts = [*change.nonzero()[0].tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            part = frame.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges, for every node on an edge.

    Alternates large-star and small-star rounds until the edge set stands still; every round is a
    minimum per node (combined before the shuffle) and a join, and is written to the shared folder.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = stored(spark, pairs, "edges")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(spark, large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        pairs = stored(spark, small, "small-star")
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
    return tuple(row)
