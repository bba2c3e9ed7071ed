"""Merkle fixity audit of two replicas of an archive.

A record's leaf is the SHA-256 of its bytes; a parent hashes its ordered children, sixteen at a time, so a node covers
an ordered range of offsets. Replicas are compared from the root down, and only the children of differing nodes
are joined, until the corrupt records are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

FAN_OUT = 16
# Digest of a null record; no SHA-256 reads so.
NULL_RECORD = "null"


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a WARC 1.0 response record; nulls count as empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def leaves(records: DataFrame) -> DataFrame:
    """(node, digest) of records (position, record). Rows at one position are hashed as a set with counts: number, smallest,
    largest and two sums of differently seeded hashes, so no position gathers its rows. A null record has a digest of its own.
    Null positions are left out."""
    sha = records.where("position IS NOT NULL").select("position", F.coalesce(F.sha2("record", 256), F.lit(NULL_RECORD)).alias("sha"))
    sums = {k: F.sum(F.xxhash64(F.lit(k), "sha").cast("decimal(20,0)")) for k in ("x", "y")}
    agg = sha.groupBy("position").agg(
        F.count("*").alias("n"), F.min("sha").alias("lo"), F.max("sha").alias("hi"), *(v.cast("string").alias(k) for k, v in sums.items())
    )
    many = F.sha2(F.concat_ws(":", F.col("n").cast("string"), "lo", "hi", "x", "y"), 256)
    return agg.select(F.col("position").alias("node"), F.when(F.col("n") == 1, F.col("lo")).otherwise(many).alias("digest"))


def tree(spark: SparkSession, records: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves (0) up to the root, each a written table (node, digest)."""
    levels = [stored(spark, leaves(records), "merkle-0")]
    for level in range(1, height + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        folded = F.sha2(F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c.node.cast("string"), c.digest))), 256)
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN_OUT).alias("parent")).agg(folded.alias("digest"))
        levels.append(stored(spark, up.select(F.col("parent").alias("node"), "digest"), f"merkle-{level}"))
    return levels


def tree_height(*records: DataFrame) -> int:
    """Levels above the leaves until one node covers every position of every replica."""
    ends = [r.agg(F.min("position"), F.max("position")).first() for r in records]
    known = [e for e in ends if e[0] is not None]
    lo, hi = min((e[0] for e in known), default=0), max((e[1] for e in known), default=0)
    height = 0
    while lo != hi and not (lo, hi) == (-1, 0):
        lo, hi, height = lo // FAN_OUT, hi // FAN_OUT, height + 1
    return height


def audit(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """(position, status, left_sha256, right_sha256) of every position whose records differ.

    status is changed, missing (not in right) or extra (not in left). Empty replicas are trees without nodes.
    """
    height = tree_height(left, right)
    ours, theirs = tree(spark, left, height), tree(spark, right, height)
    suspects = None
    for level in range(height, -1, -1):
        a, b = ours[level].alias("a"), theirs[level].alias("b")
        if suspects is not None:
            parent = F.floor(F.col("node") / FAN_OUT).alias("parent")
            a, b = (x.withColumn("parent", parent).join(suspects, "parent", "left_semi").drop("parent").alias(n) for x, n in ((ours[level], "a"), (theirs[level], "b")))
        pairs = a.join(b, F.col("a.node") == F.col("b.node"), "full_outer").where("NOT a.digest <=> b.digest")
        found = pairs.select(F.coalesce("a.node", "b.node").alias("node"), F.col("a.digest").alias("l"), F.col("b.digest").alias("r"))
        if level:
            suspects = stored(spark, found.select(F.col("node").alias("parent")), "merkle-suspects")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    return found.select(F.col("node").alias("position"), status.alias("status"), F.col("l").alias("left_sha256"), F.col("r").alias("right_sha256"))
