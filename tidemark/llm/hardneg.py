"""Hard negatives by coordinate pruning over length buckets.

Rows and anchors are cut into blocks of bounded size, each one row of a table; pairs of blocks meet by a join on block
numbers and are searched one by one. Inside a block the rows lie in length buckets, each with one sorted list per coordinate of
its unit vectors. A score of at least s with an anchor q needs an angle of at most acos(s / (|q| l)) to it, l being the
bucket's greatest length, and two vectors that far apart differ from a coordinate axis by at most that much more or less: this
gives a feasible range of values for each of the anchor's focus coordinates (its largest ones). The ranges are cut out of the
sorted lists, the lists' rows intersected, and only what is left is scored, exactly. The bound s rises while a block is
searched: to the anchor's k-th best score so far for positives; for negatives it starts at the interval's lower end.

Scores are exact: components are whole numbers, and doubles add them without error while the product of two lengths stays
below 2^53; longer vectors are scored in Python integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
ROWS_PER_BLOCK = 4096
ANCHORS_PER_BLOCK = 1024
# A new length bucket starts where lengths fall below this share of the bucket's greatest.
BUCKET_RATIO = 0.9
FOCUS = 4
# Room for rounding in lengths and angles; pruning may keep a row too many, never one too few.
SLACK = 1e-7
EXACT = 2.0**53

PAYLOAD = ("ids", "names", "blanks", "labels", "widths", "vectors", "kind")
BLOCK = "ids binary, names binary, blanks binary, labels binary, widths binary, vectors binary, kind string, held array<long>, bounds array<array<long>>"
BLOCK_COLUMNS = [*PAYLOAD, "held", "bounds"]


def usable(rows: DataFrame, anchor_step: int, relabel_step: int, labels: int) -> DataFrame:
    """(vec_id, label, q, norm, is_anchor) of the rows that take part; q holds whole numbers as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    # NaN is greater than every number in Spark's order, so one comparison finds it and the infinities.
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: _floored(v * SCALE))
    moved = F.coalesce(F.col("vec_id") % relabel_step == 0, F.lit(False))
    label = F.when(moved, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    taken = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    anchor = F.coalesce(F.col("vec_id") % anchor_step == 0, F.lit(False))
    norm = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    return taken.select(F.col("vec_id").cast("long"), label.alias("label"), whole.alias("q"), anchor.alias("is_anchor")).withColumn("norm", norm)


def _floored(v: Column) -> Column:
    """Floor that stays a double: Spark's own gives a long, which large values do not fit; those are whole already."""
    return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)


def _pack(vectors: list) -> dict[str, bytes]:
    """Vectors as 32-bit integers where they fit, else as doubles."""
    flat = np.concatenate([np.asarray(v, "<f8") for v in vectors])
    small = np.abs(flat).max(initial=0) < 2**31
    return {"widths": np.array([len(v) for v in vectors], "<i4").tobytes(), "vectors": (flat.astype("<i4") if small else flat).tobytes(), "kind": "<i4" if small else "<f8"}


def _unpack(widths: bytes, vectors: bytes, kind: str, width: int) -> np.ndarray:
    """The block's matrix; shorter vectors end in zeros."""
    sizes, flat = np.frombuffer(widths, "<i4"), np.frombuffer(vectors, kind).astype("<f8")
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    ends = np.cumsum(sizes)
    for k, (a, b) in enumerate(zip(ends - sizes, ends)):
        out[k, : b - a] = flat[a:b]
    return out


def blocks(spark: SparkSession, rows: DataFrame, size: int) -> DataFrame:
    """Rows (rid, vec_id, label, q, norm, bounds) in order of label and falling length, as blocks of at most size rows."""

    def cut(frames):
        held: list[pd.DataFrame] = []
        count = 0

        def close(part: pd.DataFrame) -> pd.DataFrame:
            columns = {"ids": part["rid"], "names": part["vec_id"], "labels": part["label"]}
            packed = {c: v.to_numpy("<i8").tobytes() for c, v in columns.items()} | _pack(part["q"].tolist())
            bounds = [list(b) if b is not None else [] for b in part["bounds"]]
            return pd.DataFrame([packed | {"blanks": part["blank"].to_numpy(bool).tobytes(), "held": sorted(set(part["label"].tolist())), "bounds": bounds}], dtype=object)[BLOCK_COLUMNS]

        for frame in frames:
            held.append(frame)
            count += len(frame)
            while count >= size:
                whole = pd.concat(held)
                yield close(whole.iloc[:size])
                held, count = [whole.iloc[size:]], count - size
        if count:
            yield close(pd.concat(held))

    # A null would turn a pandas column of ids into doubles, so ids travel with a mark.
    named = [F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("blank")]
    bounds = F.col("bounds") if "bounds" in rows.columns else F.lit(None).cast("array<long>").alias("bounds")
    order = ["label", F.col("norm").desc(), "rid"]
    dealt = rows.select("rid", *named, "label", "q", "norm", bounds).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(spark, dealt.drop("norm").mapInPandas(cut, BLOCK).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


class Bucket:
    """Rows of about one length, with a sorted list per coordinate of their unit vectors."""

    def __init__(self, matrix: np.ndarray, lengths: np.ndarray, at: np.ndarray):
        self.matrix, self.at = matrix, at
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        unit = matrix / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.values = np.take_along_axis(unit, self.order, axis=0)

    def feasible(self, q: np.ndarray, length: float, bound: float, focus: np.ndarray) -> np.ndarray | None:
        """Rows of the bucket that may score the bound or more with q; None for all of them."""
        if bound == -math.inf:
            return None
        reach = length * (self.longest if bound > 0 else self.shortest)
        if not math.isfinite(reach):
            return None
        if reach == 0:
            return None if bound <= 0 else np.zeros(0, np.int64)
        cosine = bound / reach - SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        width = math.acos(cosine)
        ranges = []
        for f in focus.tolist():
            own = math.acos(min(1.0, max(-1.0, q[f] / length)))
            low, high = math.cos(min(math.pi, own + width)) - SLACK, math.cos(max(0.0, own - width)) + SLACK
            values = self.values[:, f]
            ranges.append((int(np.searchsorted(values, low, "left")), int(np.searchsorted(values, high, "right")), f))
        ranges.sort(key=lambda r: r[1] - r[0])
        if not ranges or ranges[0][1] - ranges[0][0] > 0.6 * len(self.at):
            return None
        a, b, f = ranges[0]
        found = self.order[a:b, f]
        for a, b, f in ranges[1:]:
            if b - a > 0.9 * len(self.at):
                break
            marked = np.zeros(len(self.at), bool)
            marked[self.order[a:b, f]] = True
            found = found[marked[found]]
        return found


def buckets(matrix: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> list[Bucket]:
    """Length buckets of the rows at the given places, longest first."""
    at = at[np.argsort(-lengths[at], kind="stable")]
    out, start = [], 0
    for k in range(1, len(at) + 1):
        if k == len(at) or lengths[at[k]] < BUCKET_RATIO * lengths[at[start]]:
            out.append(Bucket(matrix[at[start:k]], lengths[at[start:k]], at[start:k]))
            start = k
    return out


def products(matrix: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (matrix @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q.tolist())) for row in matrix.tolist()]
    if any(not -(1 << 63) <= s < 1 << 63 for s in whole):
        raise ValueError("a score does not fit 64 bits")
    return np.array(whole, np.int64)


def _lengths(matrix: np.ndarray) -> np.ndarray:
    scale = np.abs(matrix).max(axis=1, initial=0.0)
    return scale * np.sqrt(((matrix / np.where(scale > 0, scale, 1.0)[:, None]) ** 2).sum(axis=1))


class Side:
    """The rows of a block, unpacked."""

    def __init__(self, row: dict, prefix: str, width: int):
        get = lambda name: row[prefix + name]
        self.ids, self.names, self.labels = (np.frombuffer(get(c), "<i8") for c in ("ids", "names", "labels"))
        self.blanks = np.frombuffer(get("blanks"), bool)
        self.matrix = _unpack(get("widths"), get("vectors"), get("kind"), width)
        self.lengths = _lengths(self.matrix)


def _sides(row: dict) -> tuple[Side, Side, bool]:
    width = max(int(np.frombuffer(row[c], "<i4").max(initial=0)) for c in ("widths", "a_widths"))
    rows, anchors = Side(row, "", width), Side(row, "a_", width)
    return rows, anchors, bool(rows.lengths.max(initial=0) * anchors.lengths.max(initial=0) < EXACT)


class Best:
    """The first k places of a block by falling score and rising id, rows without id last."""

    def __init__(self, rows: Side, k: int):
        self.rows, self.k, self.at, self.scores = rows, k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray) -> None:
        if len(self.at) == self.k and len(scores):
            near = scores >= self.scores[-1]
            at, scores = at[near], scores[near]
        if not len(at):
            return
        at, scores = np.concatenate([self.at, at]), np.concatenate([self.scores, scores])
        first = np.lexsort((self.rows.ids[at], self.rows.names[at], self.rows.blanks[at], -scores))[: self.k]
        self.at, self.scores = at[first], scores[first]

    def bound(self, least: float) -> float:
        return max(least, float(self.scores[-1])) if len(self.at) == self.k else least


def _scored(bucket: Bucket, found: np.ndarray | None, q: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    if found is None:
        return bucket.at, products(bucket.matrix, q, exact)
    return bucket.at[found], products(bucket.matrix[found], q, exact)


def _focus(q: np.ndarray) -> np.ndarray:
    return np.argsort(-np.abs(q), kind="stable")[:FOCUS]


def positives_in(row: dict, k: int) -> list[tuple]:
    """(anchor, anchor id, row, row id, score): the first k rows of each anchor's own label in a pair of blocks."""
    rows, anchors, exact = _sides(row)
    out = []
    for label in np.intersect1d(rows.labels, anchors.labels):
        held = buckets(rows.matrix, rows.lengths, np.flatnonzero(rows.labels == label))
        for n in np.flatnonzero(anchors.labels == label):
            q, best = anchors.matrix[n], Best(rows, k)
            focus = _focus(q)
            for bucket in held:
                found = bucket.feasible(q, float(anchors.lengths[n]), best.bound(-math.inf), focus)
                at, scores = _scored(bucket, found, q, exact)
                other = rows.ids[at] != anchors.ids[n]
                best.add(at[other], scores[other])
            out += [(anchors.ids[n], anchors.names[n], rows.ids[i], _named(rows, i), s) for i, s in zip(best.at, best.scores)]
    return out


def interval(positive: int) -> tuple[int, int]:
    """The whole scores s with 50 p <= 100 s <= 95 p."""
    return -(-LEAST_PERCENT * positive // 100), MOST_PERCENT * positive // 100


def negatives_in(row: dict, k: int) -> list[tuple]:
    """(anchor, positive score, row, row id, score): the first k rows of other labels in each positive score's interval."""
    rows, anchors, exact = _sides(row)
    held, out = buckets(rows.matrix, rows.lengths, np.arange(len(rows.ids))), []
    for n, wanted in enumerate(row["a_bounds"]):
        spread = {int(p): interval(int(p)) for p in wanted}
        spread = {p: limits for p, limits in spread.items() if limits[0] <= limits[1]}
        if not spread:
            continue
        q, best = anchors.matrix[n], {p: Best(rows, k) for p in spread}
        focus = _focus(q)
        for bucket in held:
            least = min(best[p].bound(low) for p, (low, _) in spread.items())
            found = bucket.feasible(q, float(anchors.lengths[n]), float(least), focus)
            at, scores = _scored(bucket, found, q, exact)
            other = (rows.labels[at] != anchors.labels[n]) & (scores >= least)
            at, scores = at[other], scores[other]
            for p, (low, high) in spread.items():
                fits = (scores >= low) & (scores <= high)
                best[p].add(at[fits], scores[fits])
        out += [(anchors.ids[n], p, rows.ids[i], _named(rows, i), s) for p, b in best.items() for i, s in zip(b.at, b.scores)]
    return out


def _named(rows: Side, i: int) -> int | None:
    return None if rows.blanks[i] else int(rows.names[i])


def _search(function, k: int, columns: list[str]):
    def run(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                yield pd.DataFrame(function(row, k), columns=columns, dtype=object).astype(dict.fromkeys(columns, "Int64"))

    return run


def _met(pairs: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of blocks with the contents of both."""
    anchors = asked.select("block", *(F.col(c).alias("a_" + c) for c in (*PAYLOAD, "bounds")))
    rows = held.select(F.col("block").alias("row_block"), *PAYLOAD)
    return pairs.join(anchors, "block").join(rows, "row_block")


def _ranked(frame: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("row_id").asc_nulls_last(), "row")
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    anchor_step: int = 50,
    relabel_step: int = 7,
    labels: int = 10,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    rows_per_block: int = ROWS_PER_BLOCK,
    anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label or vector, or with a null or non-finite component, take no part. A row without id is never an
    anchor and comes last among equal scores. Repeated rows and rows that share an id are rows of their own, each
    other's positives included. Vectors may differ in length: missing components are 0, and an empty vector scores 0. An
    empty table gives no rows; a positive without a fitting negative gives none. Other columns are ignored.
    """
    base = usable(rows.select("vec_id", "embedding", "label"), anchor_step, relabel_step, labels)
    base = stored(spark, base.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    held = blocks(spark, base, rows_per_block)
    asked = blocks(spark, base.where("is_anchor"), anchors_per_block)
    ours = held.select(F.col("block").alias("row_block"), F.explode("held").alias("label"))
    pairs = ours.join(asked.select("block", F.explode("held").alias("label")), "label").select("row_block", "block").distinct()
    columns = ["anchor", "anchor_id", "row", "row_id", "score"]
    found = _met(pairs, asked, held).mapInPandas(_search(positives_in, positives, columns), ", ".join(f"{c} long" for c in columns))
    best = stored(spark, _ranked(found, ["anchor"], positives), "positives")

    bounds = best.groupBy("anchor").agg(F.collect_set("score").alias("bounds"))
    again = blocks(spark, base.where("is_anchor").join(bounds.withColumnRenamed("anchor", "rid"), "rid"), anchors_per_block)
    slots = max(1, again.count())
    numbers = held.select(F.col("block").alias("row_block"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    dealt = again.select("block", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"))
    columns = ["anchor", "positive_score", "row", "row_id", "score"]
    found = _met(numbers.join(dealt, "slot").drop("slot"), again, held).mapInPandas(_search(negatives_in, negatives, columns), ", ".join(f"{c} long" for c in columns))
    ranked = _ranked(found, ["anchor", "positive_score"], negatives)
    wanted = best.select("anchor", "anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ranked = ranked.select("anchor", "positive_score", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return wanted.join(ranked, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
