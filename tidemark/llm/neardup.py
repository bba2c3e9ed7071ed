"""Near-duplicate texts by SimHash, widened by MinHash, with an exact check of Jaccard similarity of word shingles.

Texts are reduced to distinct shingle sets. Sets whose SimHash fingerprints lie within two bits, found by op7's bit-sliced
comparison, are candidates. Texts at similarity 0.8 lie up to 17 of 64 bits apart in the test tables, and no choice of blocks
serves such a radius, so MinHash bands add candidates: two sets of similarity 0.8 share a band of six minima with probability
1 - (1 - 0.8^6)^48, all but one pair in two million. Candidates of both kinds are joined into groups. A group's sets are cut into slices of a bounded size, every pair of slices is one comparison by exact intersection counts, and a comparison returns
only a spanning forest of its links.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, in_batches, shielded, sorted_groups, stored
from tidemark.llm.licenses import _Hashes
from tidemark.llm.licenses import shingles as hashed_shingles
from tidemark.llm.simhash import fingerprint_of
from tidemark.llm.simhash import links as fingerprint_links

WIDTH = 5
BANDS = 48
ROWS = 6
# Shingles of a slice: two slices, eight bytes a shingle, are held at once.
SLICE_SHINGLES = 400_000


def row_key(docs: DataFrame) -> Column:
    """Key of a row by all its columns, nulls included: only rows that are equal throughout share it."""
    return F.md5(F.concat_ws(":", *(F.coalesce(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), F.lit("-")) for c in docs.columns)))


def shingle_set(text: str | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.unique(hashed_shingles(words, hashes, min(width, len(words)))) if words else np.zeros(0, np.uint64)


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    draw = lambda: rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    return (draw() << np.uint64(1)) + np.uint64(1), draw()


def band_keys(found: np.ndarray) -> list[int]:
    """One signed key per band; none for the empty set."""
    if not len(found):
        return []
    mul, add = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[None, at : at + 2048] * mul[:, None] + add[:, None]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
    return (keys ^ (keys >> np.uint64(31))).view(np.int64).tolist()


def fingerprint_candidates(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(node, low): edges that join all sets (node, fp) whose fingerprints lie within the radius of op7."""
    named = stored(spark, sets.groupBy("fp").agg(F.min("node").alias("low")), "set-fingerprints")
    alike = sets.join(named, "fp").select("node", "low")
    near = fingerprint_links(spark, named.select("fp"))
    left, right = (named.select(F.col("fp").alias(side), F.col("low").alias(node)) for side, node in (("a", "node"), ("b", "low")))
    return alike.unionByName(near.join(left, "a").join(right, "b").select("node", "low")).where("node <> low")


def close_pairs(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with similarity of at least 0.8, as places in left + right (in left if same)."""
    sets = left if same else left + right
    target = left if same else right
    shift = 0 if same else len(left)
    parent = np.arange(len(sets))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in target])
    owner = np.repeat(np.arange(len(target)), sizes)
    every = np.concatenate(target)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    links, parts = [], len(sets)
    for i, found in enumerate(left):
        if parts == 1:
            break
        starts, stops = np.searchsorted(every, found), np.searchsorted(every, found, "right")
        shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(starts, stops)]), minlength=len(target))
        for j in np.flatnonzero(9 * shared >= 4 * (len(found) + sizes)).tolist():
            a, b = root(i), root(j + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parts -= 1
                links.append((i, j + shift))
    return links


def _links(spark: SparkSession, members: DataFrame, slice_shingles: int) -> DataFrame:
    """(a, b): links that join the same nodes as all pairs of members (root, node, text, n) above the threshold do."""

    def shrink(frames):
        hashes = _Hashes()
        for frame in frames:
            yield frame.assign(text=[shingle_set(t, hashes).tobytes() for t in frame["text"]]).rename(columns={"text": "found"})

    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / slice_shingles).cast("int").alias("s"))
    sets = in_batches(members.select("root", "node", "text"), shrink, "root string, node string, found binary")
    placed = sets.join(sizes, "root").withColumn("at", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    paired = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(
        "root", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "at", "node", "found"
    )
    cut = ["root", "i", "j"]

    def compare(frames):
        for group in sorted_groups(frames, cut):
            group = group.drop_duplicates("node")
            i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
            sides = [group[group["at"] == k] for k in (i, j)]
            left, right = ([np.frombuffer(b, np.uint64) for b in side["found"]] for side in sides)
            if not left or not right:
                continue
            names = sides[0]["node"].tolist() + ([] if i == j else sides[1]["node"].tolist())
            found = close_pairs(left, right, i == j)
            if found:
                yield pd.DataFrame([(names[a], names[b]) for a, b in found], columns=["a", "b"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return in_batches(paired.repartition(parts, *cut).sortWithinPartitions(*cut), compare, "a string, b string")


def one_of_each_group(spark: SparkSession, docs: DataFrame, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """One row of every component of texts linked by a Jaccard similarity of at least 0.8 over five-word shingles.

    The row with the smallest doc_id stays, a null doc_id last, ties by the key of the whole row; of equal rows one stays.
    Texts without words, null among them, count as one text. Rows are told apart by all their columns, so doc_id may be null or shared.
    """
    held, back = shielded(docs, ["_row"])
    keyed = held.withColumn("_row", row_key(held))

    def mark(frames):
        hashes = _Hashes()
        for frame in frames:
            sets = [shingle_set(t, hashes) for t in frame.pop("text")]
            names = [hashlib.md5(s.tobytes()).hexdigest() for s in sets]
            prints = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            yield frame.assign(node=names, n=[len(s) for s in sets], fp=prints, bands=[band_keys(s) for s in sets])

    columns = keyed.select("_row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = in_batches(columns, mark, "_row string, doc_id long, node string, n long, fp long, bands array<long>")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    same = [F.first(c).alias(c) for c in ("n", "fp", "bands")]
    distinct = stored(spark, marked.groupBy("node").agg(F.min(key).alias("key"), *same), "shingle-sets")
    spread = distinct.select("node", F.explode("bands").alias("band"))
    # A minimum combined before the shuffle and a join that splits a common band, where a window would hold the band in one task.
    low = spread.join(spread.groupBy("band").agg(F.min("node").alias("low")), "band").where("node <> low")
    edges = low.select("node", "low").unionByName(fingerprint_candidates(spark, distinct.where("n > 0").select("node", "fp")))
    groups = components(spark, edges, "node", "low")
    members = distinct.join(groups, "node").select("root", "node", "n", F.col("key._row").alias("_row"))
    members = stored(spark, members, "candidate-sets")
    texts = keyed.select("_row", F.col("text").cast("string").alias("text"))
    linked = components(spark, _links(spark, members.join(texts, "_row"), slice_shingles))
    named = distinct.select("node", "key").join(linked, "node", "left")
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("key").alias("key"))
    return back(keyed.join(kept.select("key._row"), "_row", "left_semi").dropDuplicates(["_row"]))
