"""Packs above the byte bound: their size and hash are those of the whole document."""

from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import digests as D
from tidemark.operators import investigate as I

START = datetime(2026, 1, 1)
FACT = "site INT, at TIMESTAMP, id BIGINT, entry STRING"
INCIDENT = "incident_id INT, site INT, incident_text STRING, window_start TIMESTAMP, window_end TIMESTAMP"
NAMES = ("scheduled_checkpoints", "public_config_states", "events", "relations", "human_reported_notes")


def day(n):
    return START + timedelta(days=n)


def whole(incident, facts, bounds=(200, 100, 200, None, None)):
    """The document as plain Python builds it."""
    _, site, text, since, until = incident
    document = {"engine_version": "pack-v1"} | ({} if text is None else {"incident": text})
    for name, rows, most in zip(NAMES, facts, bounds):
        inside = lambda at: at is not None and until is not None and at <= until and (name == NAMES[-1] or since is not None and at >= since)
        held = sorted((r for r in rows if r[0] == site and inside(r[1])), key=lambda r: (r[1], r[2] is not None, r[2] or 0, json.dumps(r[3], ensure_ascii=False)))
        document[name] = [r[3] for r in held][:most]
    said = json.dumps(document, separators=(",", ":"), ensure_ascii=False).encode()
    return len(said), hashlib.sha256(said).hexdigest()


def shown(rows):
    return sorted((r["incident_id"], r["content_bytes"], r["content_hash"]) for r in rows)


def test_large_packs_have_the_size_and_hash_of_the_whole(spark):
    rng = random.Random(5)
    facts = []
    for name, n in zip(NAMES, (900, 300, 700, 500, 500)):
        long = name in NAMES[3:]
        facts.append([(rng.randint(1, 2), day(rng.randint(0, 30)), rng.choice([None, *range(9)]), rng.choice([None, "", 'a "quote" \\ ü', "x" * (9_000 if long else 5)])) for _ in range(n)] + [(1, None, 1, "no time")])
    incidents = [(i, rng.randint(1, 3), rng.choice(["text", None, 'a "b"']), day(rng.randint(0, 9)), day(rng.randint(10, 40))) for i in range(60)]
    incidents += [(60, 1, "open", None, day(30)), (61, 1, "endless", day(0), None), (62, 2, "before", day(-9), day(-5))]
    packs = I.evidence_pack(spark.createDataFrame(incidents, INCIDENT), *[spark.createDataFrame(rows, FACT) for rows in facts]).collect()
    expected = {i[0]: whole(i, facts) for i in incidents}
    large = [r for r in packs if r["content"] is None]
    assert len(packs) == len(incidents) and len(large) > 30
    # Rows of one time and id have no order in a small pack.
    assert shown(large) == sorted((i, *expected[i]) for i in {r["incident_id"] for r in large})
    assert all(r["content_bytes"] > I.PACK_BYTES for r in large)


def test_no_number_of_entries_is_too_large(spark):
    """More entries than any pack can hold, and empty ones: all of them count."""
    none, n = spark.createDataFrame([], FACT), I.PACK_BYTES // I.PACK_ENTRY + 9
    incident = (1, 1, "a", day(0), day(3))
    at = F.lit(day(1)).cast("timestamp").alias("at")
    notes = spark.range(n).select(F.lit(1).alias("site"), at, "id", F.lit("").alias("entry"))
    nulls = spark.range(n).select(F.lit(1).alias("site"), at, "id", F.lit(None).cast("string").alias("entry"))
    rows = [(1, day(1), i, "") for i in range(n)]
    for given, held in ((notes, rows), (nulls, [(*r[:3], None) for r in rows])):
        found = I.evidence_pack(spark.createDataFrame([incident], INCIDENT), none, none, none, none, given).collect()
        assert shown(found) == [(1, *whole(incident, [[], [], [], [], held]))]


@pytest.mark.parametrize("block", [1, 4, 100])
def test_documents_of_a_scope_are_hashed_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["p", "q"]), rng.choice(["s", "t"]), day(rng.randint(0, 20)), i, f'"{i}"') for i in range(400)]
    documents = [(i, rng.choice(["p", "q", "r", None]), '{"a":1', day(rng.randint(0, 10)), day(rng.randint(5, 25))) for i in range(30)]
    documents += [documents[0]]
    got = D.document_digests(
        spark.createDataFrame(documents, "doc INT, scope STRING, head STRING, since TIMESTAMP, until TIMESTAMP"),
        spark.createDataFrame(rows, "scope STRING, section STRING, at TIMESTAMP, id BIGINT, entry STRING"), [D.Section("s", 3), D.Section("t", None)], block,
    )
    expected = []
    for doc, scope, head, since, until in documents:
        held = {s: [r[4] for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[:2] == (scope, s) and since <= r[2] <= until] for s in "st"}
        said = f'{head},"s":[{",".join(held["s"][:3])}],"t":[{",".join(held["t"])}]}}'.encode()
        expected.append((doc, len(said), hashlib.sha256(said).hexdigest()))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
