"""Context-triggered piecewise hashing: document fingerprints compared by edit distance.

A rolling hash over seven bytes ends a chunk where it is -1 modulo the block size; every chunk gives one
base-64 character. The block size doubles until the signature fits 64 characters, and a second signature at twice the block
size lets neighbours compare. Fingerprints look like `size:signature:signature at twice the size`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches

ROLL = 7
LEAST_BLOCK = 3
SIGNATURE = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_MIX = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B1) + np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
_BYTE = (_MIX ^ (_MIX >> np.uint64(15))).astype(np.uint32)


def _rolled(data: bytes) -> np.ndarray:
    """Hash of the seven bytes that end at each byte, rotated by their age."""
    each = _BYTE[np.frombuffer(data, np.uint8)]
    out = each.copy()
    for age in range(1, min(ROLL, len(each))):
        turn = np.uint32(age * 4)
        out[age:] ^= (each[:-age] << turn) | (each[:-age] >> (np.uint32(32) - turn))
    return out * np.uint32(0x2C1B3C6D) >> np.uint32(3)


def _signature(data: bytes, ends: np.ndarray) -> str:
    """Chunks end after the given positions; past 63 of them the tail is one chunk."""
    cuts = [0, *(ends[: SIGNATURE - 1] + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(ALPHABET[xxhash.xxh32_intdigest(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:]))


def fingerprint(data: bytes) -> str:
    rolled = _rolled(data)
    block = LEAST_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    # Multiples of the least block size only: each larger size's boundaries are among the smaller one's.
    ends = np.flatnonzero(rolled % LEAST_BLOCK == LEAST_BLOCK - 1)
    marks = rolled[ends] // np.uint32(LEAST_BLOCK)
    at = lambda size: ends[marks % np.uint32(size // LEAST_BLOCK) == size // LEAST_BLOCK - 1]
    while block > LEAST_BLOCK and len(at(block)) < SIGNATURE // 2:
        block //= 2
    return f"{block}:{_signature(data, at(block))}:{_signature(data, at(block * 2))}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors, one column step per character."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        vertical = eq | minus
        flat = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(flat | plus) & full, plus & flat
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return score


def likeness(one: str, two: str) -> float:
    """0 to 1: one less the share of edits, at the best block size both have; 0 at incompatible sizes."""
    if one == two:
        return 1.0
    (n, a, b), (m, c, d) = one.split(":"), two.split(":")
    n, m, best = int(n), int(m), 0.0
    sizes = {n: a, 2 * n: b}
    for size, other in ((m, c), (2 * m, d)):
        if size in sizes and (sizes[size] or other):
            best = max(best, 1 - edit_distance(sizes[size], other) / max(len(sizes[size]), len(other)))
    return best


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ordered_pairs(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, k, text, doc_id, tail) in which each part is a doc_id range followed by the next range's first row.

    k orders the rows (null ids first). Only one row per range is looked up apart from the rows themselves.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    points = [i / parts for i in range(1, parts)]
    bounds = sorted(set(base.agg(F.percentile_approx("k", points or [0.5], 10_000)).first()[0] or [])) if points else []
    part = F.lit(0)
    if bounds:
        edges = F.array(*map(F.lit, bounds))
        part = F.size(F.filter(edges, lambda e: e <= F.col("k")))
    base = base.withColumn("part", part.cast("int"))
    least = base.groupBy("part").agg(F.min("k").alias("k"))
    firsts = base.join(F.broadcast(least), ["part", "k"]).groupBy("part").agg(F.min(F.struct("k", "text", "doc_id")).alias("f"))
    # One row per range; the last range is followed by the first.
    order = Window.orderBy("part")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())))
    tails = firsts.select(F.col("before").alias("part"), F.col("f.k").alias("k"), F.col("f.text").alias("text"), F.lit(True).alias("tail"), F.col("f.doc_id").alias("doc_id"))
    rows = base.select("part", "k", "text", F.lit(False).alias("tail"), "doc_id").unionByName(tails)
    return rows.repartition(parts, "part").sortWithinPartitions("part", "tail", "k", "text")


def fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """The contract's columns: fingerprints of each text and of its edited text, and their likenesses.

    Null texts count as empty (`3::`, like any equal fingerprint with likeness 1). Order is ascending doc_id, null
    ids first, then by text; a table of one row follows itself; repeated rows follow each other.
    """

    def rate(frames):
        held = None  # the row that waits for its follower: part, doc_id, text, fingerprint
        for frame in frames:
            rows = []
            for part, text, tail, doc_id in zip(frame["part"], frame["text"], frame["tail"], frame["doc_id"]):
                mark = fingerprint(text.encode("utf-8", "replace"))
                if held is not None and held[0] == part:
                    changed = edited(held[2], text).encode("utf-8", "replace")
                    other = fingerprint(changed)
                    rows.append((held[1], len(held[2]), hashlib.sha256(changed).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], mark)))
                held = None if tail else (part, None if pd.isna(doc_id) else int(doc_id), text, mark)
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield out.astype({"doc_id": "Int64", "n_chars": "int64"})

    return in_batches(
        ordered_pairs(docs, parts), rate, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
