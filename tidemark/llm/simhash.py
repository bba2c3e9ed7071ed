"""SimHash near-duplicates found by bit-sliced comparison.

Fingerprints are reduced to distinct values. Two values within two bits of each other agree on at least two of
four 16-bit blocks, so each value goes to the six buckets of its block pairs. A bucket is cut into slices of a
bounded size, every pair of slices is one comparison: one side lies vertically as 64 bit planes, the other side's
values are added plane by plane into carry-save counters, and a slice is left once all its lanes are past the radius.
A comparison returns only a spanning forest of its links, so a dense bucket never returns all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, in_batches, sorted_groups, stored

RADIUS = 2
SLICE_ROWS = 2048
HASH_SEED = 42
BLOCK_BITS = 16
BLOCKS = 4


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), dtype=np.uint64)
    return fingerprint_of(hashes)


def with_fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint's bits as a signed number; a null text counts as empty."""

    def mark(frames):
        for frame in frames:
            values = np.array([fingerprint(t, width) for t in frame["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": values})

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), mark, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """The values' bits stored vertically: row k holds bit k of every value, packed in 64-lane words."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    lanes = -len(values) % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, lanes))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def close_lanes(query: np.ndarray, flat: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Boolean (queries, n): lanes within the radius. Carry-save counters saturate above 3."""
    if radius > 3:
        raise ValueError("the two-bit counters hold radii up to 3")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(query), flat.shape[1])
    low, high, over = (np.zeros(shape, np.uint64) for _ in range(3))
    alive = np.arange(len(query))
    out = np.zeros((len(query), n), bool)
    for k in range(64):
        flip = np.where((query[alive] >> np.uint64(k)) & np.uint64(1), full, np.uint64(0))
        differs = flat[k][None, :] ^ flip[:, None]
        carry = low & differs
        low ^= differs
        over |= high & carry
        high ^= carry
        if k % 8 == 7:
            keep = (~_past(low, high, over, radius)).any(axis=1)
            if not keep.all():
                alive, low, high, over = alive[keep], low[keep], high[keep], over[keep]
                if not len(alive):
                    return out
    near = ~_past(low, high, over, radius)
    out[alive] = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return out


def _past(low, high, over, radius):
    if radius == 3:
        return over
    if radius == 2:
        return over | (high & low)
    return over | high if radius == 1 else over | high | low


def forest(left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Spanning forest of the links between two slices of distinct fingerprints."""
    values = left if same else np.concatenate([left, right])
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = 0 if same else len(left)
    flat, links = planes(right), []
    for at in range(0, len(left), 256):
        rows, cols = close_lanes(left[at : at + 256], flat, len(right)).nonzero()
        for i, j in zip((rows + at).tolist(), (cols + shift).tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    signed = values.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def links(spark: SparkSession, distinct: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links within the radius do."""
    mask = (1 << BLOCK_BITS) - 1
    keys = []
    for no, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        block = [F.shiftrightunsigned("fp", BLOCK_BITS * x).bitwiseAND(F.lit(mask)) for x in (i, j)]
        keys.append(F.lit(no << 32) + block[0] * F.lit(1 << 16) + block[1])
    spread = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    placed = spread.join(sizes, "bucket").select("bucket", "fp", slices.alias("s"), F.pmod(F.xxhash64("fp"), slices).cast("int").alias("at"))
    other = F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o")
    paired = placed.select("bucket", "fp", "at", other).select(
        "bucket", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "at", "fp"
    )
    cut = ["bucket", "i", "j"]

    def compare(frames):
        for group in sorted_groups(frames, cut):
            i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
            values = group["fp"].to_numpy(np.int64).view(np.uint64)
            at = group["at"].to_numpy()
            found = forest(values[at == i], values[at == j], i == j)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    # A fixed number: comparisons are small in bytes and long in time, so their partitions are not to be merged.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(parts, *cut).sortWithinPartitions(*cut).mapInPandas(compare, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and blank texts have fingerprint zero and link like any other; equal rows give equal rows; an empty table
    gives none. A null doc_id gets its component's smallest non-null id (null if there is none). Other columns are ignored.
    """
    marked = stored(spark, with_fingerprint(docs, width), "fingerprints")
    distinct = stored(spark, marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = components(spark, links(spark, distinct))
    roots = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
