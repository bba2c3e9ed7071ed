"""Incremental views against full recomputes, and similar incidents against all pairs."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidemark.operators import similarity as S
from tidemark.operators import views as W
from tidemark.session import work_folder

SCHEMA = "key STRING, at TIMESTAMP, id BIGINT, state STRING"


def facts(rng, n, start):
    return [(f"k{rng.randint(0, 60)}", datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 400)), start + i, rng.choice(["a", "b", None])) for i in range(n)]


def latest(rows):
    best = {}
    for key, at, i, state in rows:
        best[key] = max(best.get(key, (datetime.min, -1, None)), (at, i, state), key=lambda x: x[:2])
    return {k: v for k, v in best.items()}


def seen(spark, folder):
    return {r.key: (r.at, r.id, r.state) for r in W.read_view(spark, folder, spark.createDataFrame([], SCHEMA).schema).collect()}


def test_increments_equal_a_recompute(spark):
    rng, folder, rows = random.Random(1), work_folder(spark, "view"), []
    assert seen(spark, folder) == {}
    for step in range(4):
        more = facts(rng, 200 if step else 30, step * 1000)
        if step == 2:
            more += more[:20]
        rows += more
        W.apply_increment(spark, folder, spark.createDataFrame(more, SCHEMA), ["key"], ["at", "id"], 8)
        assert seen(spark, folder) == latest(rows)
    assert W.apply_increment(spark, folder, spark.createDataFrame([], SCHEMA), ["key"], ["at", "id"], 8) == 4
    W.apply_increment(spark, folder, spark.createDataFrame([("k1", datetime(2020, 1, 1), 9_999, "old")], SCHEMA), ["key"], ["at", "id"], 8)
    assert seen(spark, folder) == latest(rows)


def test_a_killed_increment_shows_nothing(spark, monkeypatch):
    rng, folder = random.Random(2), work_folder(spark, "view")
    first, second = facts(rng, 100, 0), facts(rng, 100, 1000)
    W.apply_increment(spark, folder, spark.createDataFrame(first, SCHEMA), ["key"], ["at", "id"], 8)
    before = seen(spark, folder)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(W, "finish", killed)
        with pytest.raises(KeyboardInterrupt):
            W.apply_increment(spark, folder, spark.createDataFrame(second, SCHEMA), ["key"], ["at", "id"], 8)
    assert seen(spark, folder) == before == latest(first)
    # Another increment of other buckets, then the first one again.
    third = [("k5", datetime(2025, 1, 1), 5_000, "c")]
    W.apply_increment(spark, folder, spark.createDataFrame(third, SCHEMA), ["key"], ["at", "id"], 8)
    assert seen(spark, folder) == latest(first + third)
    W.apply_increment(spark, folder, spark.createDataFrame(second, SCHEMA), ["key"], ["at", "id"], 8)
    assert seen(spark, folder) == latest(first + second + third)


@pytest.mark.parametrize(("least", "label_rows"), [(0.15, 2_000), (0.5, 7)])
def test_similar_incidents_equal_all_pairs(spark, least, label_rows):
    rng = random.Random(6)
    # One label is in all incidents, one in a third, most in few.
    rows = []
    for i in range(150):
        rows += [(i, "all")] + [(i, "third")] * (i % 3 == 0) + [(i, f"l{int(rng.random() ** 2 * 60)}") for _ in range(rng.randint(0, 8))]
    rows += [(200, "only"), (201, "twin"), (202, "twin"), (None, "all"), (3, None), *rows[:10]]
    sets = {}
    for i, label in rows:
        if i is not None and label is not None:
            sets.setdefault(i, set()).add(label)
    df = Counter(label for s in sets.values() for label in s)
    weight = {label: len(sets) // n for label, n in df.items()}
    wanted = set()
    for a in sets:
        scored = []
        for b in sets:
            shared = sum(weight[x] for x in sets[a] & sets[b])
            value = shared / sum(weight[x] for x in sets[a] | sets[b])
            if a != b and sets[a] & sets[b] and value >= least:
                scored.append((-value, b, len(sets[a] & sets[b])))
        wanted |= {(a, b, k + 1, round(-v, 9), n) for k, (v, b, n) in enumerate(sorted(scored)[:4])}
    got = S.incident_similarity(spark.createDataFrame(rows, "incident_id BIGINT, label STRING"), 4, least, label_rows)
    found = {(r.from_incident_id, r.to_incident_id, r.position, round(r.similarity, 9), r.shared_labels) for r in got.collect()}
    assert found == wanted and len(wanted) > 10
