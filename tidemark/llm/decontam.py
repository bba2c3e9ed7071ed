"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows.

Lower-cased words are joined by single spaces, the automaton's keys are whole windows between spaces, and a text is
scanned once. Hits are word ranges; `hit_spans` maps them to offsets in the original text. The automaton is built
from a block of items under a byte bound, checked before; a larger benchmark takes several blocks, each a pass
whose written result feeds the next.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, stored

WINDOW_WORDS = 10
BLOCK_BYTES = 8_000_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def automaton(items: list[tuple[str | None, str | None]], width: int = WINDOW_WORDS):
    """Automaton whose values are (item names, words in the window); None without any word."""
    owners: dict[bytes, set[str]] = {}
    sizes: dict[bytes, int] = {}
    for name, text in items:
        found = words(text)
        for i in range(max(1, len(found) - width + 1) if found else 0):
            key = b" ".join(found[i : i + width])
            # Windows of an unnamed item are hits without a name.
            owners.setdefault(key, set()).update([] if name is None else [name])
            sizes[key] = min(width, len(found) - i)
    if not owners:
        return None
    machine = ahocorasick.Automaton()
    for key, names in owners.items():
        machine.add_word(f" {key.decode('latin-1')} ", (tuple(sorted(names)), sizes[key]))
    machine.make_automaton()
    return machine


def scan(machine, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Word count, merged hit word ranges [start, stop), and the items with a window in the text."""
    found = words(text)
    if not found or machine is None:
        return len(found), [], []
    line = b" " + b" ".join(found) + b" "
    hits = list(machine.iter(line.decode("latin-1")))
    if not hits:
        return len(found), [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    stops = np.searchsorted(spaces, [end for end, _ in hits]).tolist()
    names: set[str] = set()
    for _, (owners, _) in hits:
        names.update(owners)
    ranges = sorted((stop - size, stop) for stop, (_, (_, size)) in zip(stops, hits))
    return len(found), merged(ranges), sorted(names)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hit_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


ADDED = ["n_words", "hit_starts", "hit_stops", "span_starts", "span_stops", "item_ids"]


def scan_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_starts, hit_stops (merged word ranges), span_starts, span_stops (code points), item_ids.

    Null texts have no words; repeated rows are scanned alike; items without words are never found; items without
    id are hit but not named; an empty benchmark hits nothing. Columns of docs pass unchanged unless they bear one of the added names.
    """
    added = ADDED
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("name"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    longest = items.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()[0]
    if longest > 16 * block_bytes:
        raise ValueError("a benchmark item exceeds the automaton's bound")
    blocks = max(1, math.ceil(size / block_bytes))
    base = docs.drop(*added)
    empty = F.array().cast("array<int>")
    frame = base.withColumns({"n_words": F.lit(0).cast("long"), **{c: empty for c in added[1:5]}, "item_ids": F.array().cast("array<string>")})
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block).distinct()
        held = spark.sparkContext.broadcast([(r.name, r.text) for r in part.collect()])
        frame = in_batches(frame, _pass(held, width), frame.schema)
        if blocks > 1:
            frame = stored(spark, frame, "benchmark-hits")
    return frame


def _pass(held, width):
    def run(frames):
        machine = automaton(held.value, width)
        for frame in frames:
            rows = []
            for text, starts, stops, names in zip(frame["text"], frame["hit_starts"], frame["hit_stops"], frame["item_ids"]):
                count, ranges, found = scan(machine, text)
                ranges = merged(ranges + list(zip(map(int, starts), map(int, stops)))) if len(starts) else ranges
                spans = hit_spans(text, ranges) if ranges else []
                rows.append((count, [a for a, _ in ranges], [b for _, b in ranges], [a for a, _ in spans], [b for _, b in spans], sorted({*found, *names})))
            for k, name in enumerate(("n_words", "hit_starts", "hit_stops", "span_starts", "span_stops", "item_ids")):
                frame[name] = pd.Series([r[k] for r in rows], index=frame.index, dtype="int64" if k == 0 else object)
            yield frame

    return run


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    lengths = F.zip_with("hit_starts", "hit_stops", lambda a, b: (b - a).cast("long"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
