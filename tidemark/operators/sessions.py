"""Sessions with a longest gap and a longest span, without gathering a key.

Where a session starts depends on where the one before started, back to the first event.  A block of time turns that into a
small map: an event that is a start fixes every later start of its block, so a block is known by the last start that
follows from each event the first start can fall on, and those lie within one span of the block's beginning.  The maps of a key
are walked in order, which gives every block its first start, and the blocks then cut themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from tidemark.operators.ordered import carry_previous, running_count
from tidemark.session import written


def following(t: np.ndarray, v: np.ndarray, gap: float, span: float) -> np.ndarray:
    """Index of the session start after each event, were that event a start; the length where the block holds none."""
    n = len(t)
    heads = np.append(np.flatnonzero(np.diff(t) >= gap) + 1, n)
    after_gap = heads[np.searchsorted(heads, np.arange(n), side="right")]
    return np.where(v > 0, np.minimum(after_gap, np.searchsorted(t, t + span)), np.arange(1, n + 1))


def last_starts(after: np.ndarray) -> np.ndarray:
    """Last start of the block that follows from each event, by doubling steps."""
    n = len(after)
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def in_groups(frame: DataFrame, names: list[str], order: str, fold: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: StructType) -> DataFrame:
    """``fold`` over sorted groups: it gets the rows of whole groups and the place where each begins.

    The groups of a task stream through it one batch after the other, so a call serves many small groups and a task holds a
    batch and the group that lies across its end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            heads = np.flatnonzero((batch[names] != batch[names].shift()).any(axis=1).to_numpy())
            if kept and bool((kept[-1][names].iloc[-1] == batch[names].iloc[0]).all()):
                heads = heads[1:]
            if len(heads):
                yield from folded([*kept, batch.iloc[: heads[-1]]])
                kept = []
                batch = batch.iloc[heads[-1] :]
            kept.append(batch)
        yield from folded(kept)

    def folded(pieces: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = [p for p in pieces if len(p)]
        if pieces:
            rows = pd.concat(pieces, ignore_index=True) if len(pieces) > 1 else pieces[0].reset_index(drop=True)
            yield fold(rows, np.flatnonzero((rows[names] != rows[names].shift()).any(axis=1).to_numpy()))

    return frame.repartition(*names).sortWithinPartitions(*names, order).mapInPandas(run, schema)


def span_sessions(events: DataFrame, keys: list[str], gap: float, span: float, block: float = 600_000.0) -> DataFrame:
    """Sessions of each key: start, end, instants, total.  Events: keys (never null), t, v (not negative, never null).

    A session goes on while the gap to its last event is below ``gap``, the distance to its start below ``span`` and its sum above
    zero.  Events of one instant count as one, and what no gap parts is looked at by itself.  Of a key, a task holds the instants of
    one block or what can come first in each of its blocks; ``block`` is at least ``span``.
    """
    if block < span:
        raise ValueError("a block is at least a span")
    instants = events.groupBy(*keys, F.col("t").cast("double").alias("t")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    place = F.floor(F.col("t") / F.lit(block)).cast("bigint")
    lagged = carry_previous(instants, keys, ["t"], "t", "_before", place)
    head = F.col("_before").isNull() | (F.col("t") - F.col("_before") >= gap)
    chained = running_count(lagged, keys, ["t"], head, "_chain", place).drop("_before")
    # Several branches read the chains; written once, they are not found again in each.
    chained = written(chained, "chains")
    chains = chained.groupBy(*keys, "_chain").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("instants"), F.sum("v").alias("total"), F.min_by("v", "t").alias("_first"),
        F.min(F.when(F.col("v") > 0, F.col("t"))).alias("_positive"),
    )
    # A chain shorter than a span is one session from its first value above zero on, and what lies before is one session an instant.
    short = F.col("end") - F.col("start") < span
    whole = short & ((F.col("_first") > 0) | (F.col("instants") == 1))
    own, keys = list(keys), [*keys, "_chain"]
    shown = [*own, "start", "end", "instants", "total"]
    rest = chained.join(chains.where(~whole).select(*keys, short.alias("_short"), "_positive"), keys)
    begins = F.when(F.col("t") >= F.col("_positive"), F.col("_positive")).otherwise(F.col("t"))
    total = F.when(F.count("v") == F.count("*"), F.sum("v"))
    led = rest.where("_short").groupBy(*keys, begins.alias("start")).agg(F.max("t").alias("end"), F.count("*").alias("instants"), total.alias("total"))
    simple = chains.where(whole).select(*shown).unionByName(led.select(*shown))

    instants = rest.where("NOT _short").drop("_short", "_positive").withColumn("_block", place)
    scope = [instants.schema[c] for c in [*keys, "_block"]]
    names = [*keys, "_block"]

    def summary(rows: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        out, blocks = [], rows["_block"].to_numpy()[heads]
        for t, v, place in zip(np.split(rows["t"].to_numpy(), heads[1:]), np.split(rows["v"].to_numpy(), heads[1:]), blocks):
            last = last_starts(following(t, v, gap, span))
            gaps = np.flatnonzero(np.diff(t) >= gap) + 1
            head = int(gaps[0]) if len(gaps) else len(t)
            # What comes first in the block can be any event up to the first that must be a start.
            most = min(head, int(np.searchsorted(t, place * block + span)), len(t) - 1) + 1
            out.append((t[:most].tolist(), t[last[:most]].tolist(), (v[last[:most]] > 0).tolist(), head < most, t[-1]))
        firsts, lasts, alive, forced, end = zip(*out)
        return rows.iloc[heads][names].assign(firsts=firsts, lasts=lasts, alive=alive, forced=forced, end=end)

    def walk(rows: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        fresh = np.zeros(len(rows), dtype=bool)
        fresh[heads] = True
        start, alive, end, out = 0.0, False, 0.0, []
        for first, firsts, lasts, alives, forced, until in zip(fresh, rows["firsts"], rows["lasts"], rows["alive"], rows["forced"], rows["end"]):
            if first:
                start, alive, end = 0.0, False, 0.0
            place = 0
            if alive and firsts[0] - end < gap:
                place = int(np.searchsorted(np.asarray(firsts), start + span))
                place = min(place, len(firsts) - 1) if forced else place
            out.append((start, firsts[place] if place < len(firsts) else np.inf))
            if place < len(firsts):
                start, alive = lasts[place], bool(alives[place])
            end = until
        return rows[names].assign(_carried=[x[0] for x in out], _entry=[x[1] for x in out])

    def cut(rows: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        out, sizes = [], []
        carried, entry = rows["_carried"].to_numpy()[heads], rows["_entry"].to_numpy()[heads]
        for t, v, before, first in zip(np.split(rows["t"].to_numpy(), heads[1:]), np.split(rows["v"].to_numpy(), heads[1:]), carried, entry):
            after, at, starts = following(t, v, gap, span), int(np.searchsorted(t, first)), []
            marks = [0] if at else []
            begins = [before] if at else []
            while at < len(t):
                starts.append(at)
                at = int(after[at])
            edges = np.array(marks + starts)
            out.append((np.concatenate([begins, t[starts]]), t[np.append(edges[1:], len(t)) - 1], np.diff(np.append(edges, len(t))), np.add.reduceat(v, edges)))
            sizes.append(len(edges))
        sessions = rows.iloc[np.repeat(heads, sizes)][keys].reset_index(drop=True)
        return sessions.assign(**{c: np.concatenate(x) for c, x in zip(("start", "end", "instants", "total"), zip(*out))})

    numbers = ArrayType(DoubleType())
    maps = in_groups(instants, names, "t", summary, StructType([
        *scope, StructField("firsts", numbers), StructField("lasts", numbers), StructField("alive", ArrayType(BooleanType())),
        StructField("forced", BooleanType()), StructField("end", DoubleType()),
    ]))
    entries = in_groups(maps, keys, "_block", walk, StructType([*scope, StructField("_carried", DoubleType()), StructField("_entry", DoubleType())]))
    parts = in_groups(instants.join(entries, names), names, "t", cut, StructType([
        StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("instants", LongType()), StructField("total", DoubleType()), *scope[:-1],
    ]))
    joined = parts.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.sum("instants").alias("instants"), F.sum("total").alias("total"))
    return simple.unionByName(joined.select(*shown))
