"""Op 13 against brute force over all pairs, with pruning at work, ties, repeats, nulls and long components."""

from __future__ import annotations

import math
import random

import numpy as np

from tidemark.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, block string, rid string"


def brute(rows, step=50):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % step:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), i, own) for n, (i, own, v) in enumerate(kept) if n != k]
        positives = sorted((s for s in scored if s[2] == label), key=order)[:5]
        for p, positive, _ in positives:
            fits = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(anchor, positive, rank + 1, i, p, s) for rank, (s, i, _) in enumerate(fits)]
    return sorted(out, key=str)


def result(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, hardneg.hard_negatives(spark, frame, **options).collect()), key=str)


def test_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12)) * 0.5
    rows = []
    for k in range(700):
        c = int(rng.integers(6))
        v = (centres[c] + rng.normal(size=12) * 0.15) * float(rng.choice([0.2, 1.0, 3.0]))
        rows.append((k, v.tolist(), c if k % 11 else int(rng.integers(10))))
    rows += [(50, rows[3][1], 2), (rows[4][0], *rows[4][1:]), *[rows[100]] * 6]
    rows += [(None, rows[9][1], 1), (900, None, 1), (950, [1.0, None], 2), (1000, [float("nan")] * 12, 2), (1050, [float("inf")] * 12, 3), (1100, [0.1] * 12, None)]
    rows += [(1150, [], 4), (1200, [0.0] * 12, 4), (1250, [0.5, 0.25], 4), (2**60 + 8, rows[0][1], 3)]
    wanted = brute(rows)
    assert len(wanted) > 60
    assert result(spark, rows) == wanted
    assert result(spark, rows, rows_per_block=37, anchors_per_block=3) == wanted


def test_long_components(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1, 1]) * rng.random() * 2.0**22 for _ in range(4)], k % 3) for k in range(60)]
    assert result(spark, rows) == brute(rows)
    rows = [(k, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 20) for _ in range(3)], k % 3) for k in range(60)]
    assert result(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0, 0.0], 1)]) == []
    same = [(k, [1.0, 0.0], 1) for k in range(1, 9)]
    assert result(spark, [(0, [1.0, 0.0], 0), *same]) == brute([(0, [1.0, 0.0], 0), *same])


def test_ranges_lose_nothing():
    rng = np.random.default_rng(5)
    matrix = np.floor(256 * rng.normal(size=(900, 10)) * rng.choice([0.1, 1.0], size=(900, 1)))
    lengths, pruned, total = hardneg._lengths(matrix), 0, 0
    for q in np.floor(256 * rng.normal(size=(40, 10))):
        length, scores = float(np.linalg.norm(q)), matrix @ q
        for bound in (float(np.sort(scores)[-5]), float(np.sort(scores)[-100]), -10.0):
            for bucket in hardneg.buckets(matrix, lengths, np.arange(900)):
                found = bucket.feasible(q, length, bound, hardneg._focus(q))
                kept = set(bucket.at.tolist() if found is None else bucket.at[found].tolist())
                assert {int(i) for i in bucket.at if scores[i] >= bound} <= kept
                pruned, total = pruned + len(bucket.at) - len(kept), total + len(bucket.at)
    assert pruned > total / 10
