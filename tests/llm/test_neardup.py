"""The pipeline's near-dedup stage against brute-force Jaccard, with planted near copies."""

from __future__ import annotations

import random

import corpus_pipeline
from tidemark.llm import neardup
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Places of the rows that stay: the smallest (doc_id, nulls last) of each component."""
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if root[a] != root[b] and 5 * same >= 4 * union:
                root = [root[b] if r == root[a] else r for r in root]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return {min((k for k in range(len(rows)) if root[k] == r), key=order) for r in set(root)}


def planted(rng):
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 64, 300]))]
        rows.append((len(rows), " ".join(words)))
        for edits in range(1, 9):
            copy = list(words)
            for _ in range(rng.randint(1, edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, "  "), (902, rows[0][1]), (903, rows[0][1].upper())]


def test_planted_near_copies(spark):
    rows = planted(random.Random(8))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    want = {rows[k][0] for k in plain_kept(rows)}
    for slice_shingles in (neardup.SLICE_SHINGLES, 200):
        got = [r.doc_id for r in neardup.one_of_each_group(spark, docs, slice_shingles).collect()]
        assert sorted(got) == sorted(want)
    assert len(rows) - len(want) > 100


def test_stage_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert got == sorted(rows[k][0] for k in plain_kept(rows))


def test_fingerprints_find_near_copies_without_bands(spark, monkeypatch):
    """SimHash, which names the stage, finds candidates by itself; before, nothing was found without MinHash bands."""
    monkeypatch.setattr(neardup, "band_keys", lambda found: [])
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(words[:n]) for n in (3998, 3999, 4000)] + ["something else that stands alone here"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in neardup.one_of_each_group(spark, docs).collect()) == [0, 3]


def test_fingerprint_candidates_join_what_lies_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(64), bits)) for b in base for bits in (0, 0, 1, 2, 3)]
    rows = [(f"n{i:03}", p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    edges = {(r.node, r.low) for r in neardup.fingerprint_candidates(spark, spark.createDataFrame(rows, "node string, fp long")).collect()}
    root = {n: n for n, _ in rows}
    want = dict(root)
    for pairs, of in ((edges, root), ({(a, b) for a, x in rows for b, y in rows if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}, want)):
        for a, b in pairs:
            low, high = sorted((of[a], of[b]))
            of.update({n: low for n, r in of.items() if r == high})
    assert root == want and len(set(root.values())) < len(rows)
