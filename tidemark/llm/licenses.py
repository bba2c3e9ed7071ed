"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

For each template length, every run of as many words is a window (step one). A window's MinHash is a sliding
minimum over its five-word shingles. Bands of one row retrieve a template whenever any band agrees: windows that
hold four fifths of a template's shingles agree on at least one of sixteen bands with probability above
1 - (1/3)^16. A band is a permutation of the shingles, so its minimum is a template's only in windows that hold the
one shingle from which the template has it: bands whose shingle a text lacks are not slid over that text.
Retrieved windows are verified by exact shingle containment and touching ones are merged.
"""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
_WORD = re.compile(r"[a-z0-9]+")

# Short notices by which licenses are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


# Full texts beside this module, by file name.
TEXTS = {"Apache-2.0-text": "Apache-2.0", "BSD-3-Clause-text": "BSD", "GPL-3.0-text": "GPL-3", "MIT-full-text": "MIT", "MPL-2.0-text": "MPL-2.0"}


def all_templates() -> dict[str, str]:
    """Notices and full texts."""
    folder = files("tidemark.llm").joinpath("license_texts")
    return TEMPLATES | {name: folder.joinpath(file).read_text("utf-8") for name, file in TEXTS.items()}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Hash of a word, kept while the vocabulary is small."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@cache
def _bands(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 62, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, bands, dtype=np.uint64)


def shingles(tokens: list[str], hashes: _Hashes, size: int = SHINGLE) -> np.ndarray:
    """Hash per shingle of consecutive words; fewer words than that have none."""
    each = np.array([hashes[w] for w in tokens], dtype=np.uint64)
    count = len(each) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[k : k + count]
    return out ^ (out >> np.uint64(31))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :]) if span < width else out


class _Held:
    """Number of distinct wanted shingles in windows of one width, asked for in ascending order."""

    def __init__(self, values: list[int], wanted: set[int], width: int):
        self.values, self.wanted, self.width = values, wanted, width
        self.start = self.stop = 0
        self.counts: dict[int, int] = {}

    def at(self, i: int) -> int:
        if i >= self.stop:
            self.start, self.stop, self.counts = i, i, {}
        for value in self.values[self.stop : i + self.width]:
            if value in self.wanted:
                self.counts[value] = self.counts.get(value, 0) + 1
        for value in self.values[self.start : i]:
            if value in self.wanted:
                self.counts[value] -= 1
                if not self.counts[value]:
                    del self.counts[value]
        self.start, self.stop = i, i + self.width
        return len(self.counts)


class Matcher:
    """Templates with their band keys by window size."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT):
        self.hashes, self.bands, self.containment = _Hashes(), bands, containment
        self.by_size: dict[int, list[tuple[str, set[int], np.ndarray]]] = {}
        # Per shingle the (window size, band) in which some template has its minimum there.
        self.sources: dict[int, set[tuple[int, int]]] = {}
        mul, add = _bands(bands)
        for name, text in templates.items():
            found = shingles(words(text), self.hashes)
            if not len(found):
                raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
            permuted = found[None, :] * mul[:, None] + add[:, None]
            keys = permuted.min(axis=1)
            for band, source in enumerate(found[permuted.argmin(axis=1)].tolist()):
                self.sources.setdefault(source, set()).add((len(found), band))
            self.by_size.setdefault(len(found), []).append((name, set(found.tolist()), keys))

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, best containment), merged per template."""
        tokens = words(text or "")
        all_shingles = shingles(tokens, self.hashes)
        values = all_shingles.tolist()
        hits: dict[tuple[str, int], set[int]] = {}
        mul, add = _bands(self.bands)
        for size, band in set().union(*(self.sources[v] for v in self.sources.keys() & values)):
            group = self.by_size[size]
            # A text shorter than the template is one window if it can hold the share at all.
            if len(values) < self.containment * min(len(w) for _, w, _ in group):
                continue
            least = _least(all_shingles * mul[band] + add[band], min(size, len(values)))
            for name, _, keys in group:
                found = np.flatnonzero(least == keys[band])
                if len(found):
                    hits.setdefault((name, size), set()).update(found.tolist())
        out = []
        for (name, size), places in hits.items():
            wanted = next(s for n, s, _ in self.by_size[size] if n == name)
            spans: list[list] = []
            held = _Held(values, wanted, min(size, len(values)))
            for i in sorted(places):
                share = held.at(i) / len(wanted)
                if share < self.containment:
                    continue
                end = min(i + size + SHINGLE - 1, len(tokens))
                if spans and i <= spans[-1][1]:
                    spans[-1][1:] = [end, max(spans[-1][2], share)]
                else:
                    spans.append([i, end, share])
            out.extend((name, a, b, s) for a, b, s in spans)
        return sorted(out)


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, start_word, end_word, containment) of every notice found.

    Null, empty and short texts give no rows; repeated rows give repeated results; other columns are ignored.
    The templates are a parameter of the driver program, not a table, and so are small; without one, all_templates().
    A template below five words is refused.
    """
    templates = all_templates() if templates is None else templates

    def scan(frames):
        matcher = Matcher(templates, bands, containment)
        for frame in frames:
            rows = [(d, *hit) for d, text in zip(frame["doc_id"], frame["text"]) for hit in matcher.scan(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "start_word", "end_word", "containment"])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(columns, scan, "doc_id long, license string, start_word long, end_word long, containment double")
