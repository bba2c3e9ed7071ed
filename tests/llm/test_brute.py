"""Operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from tests import harness
from tidemark.llm import ctph, decontam, langid, licenses, linededup, mixing, queries, runindex, simhash, warcaudit, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, h long, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 3, "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = ["\n".join(" ".join(word() for _ in range(9)) for _ in range(4)) for _ in range(4)]
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "...", "en", "a"), (3, " \t\n", "de", None)]
    for i in range(4, 60):
        own = " ".join(word() for _ in range(rng.randint(1, 40)))
        text = own + "\n" + rng.choice(passages) + "\n" + own[::-1] if i % 3 else own
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b"])))
    rows += [(60 + i, rows[5][1], "en", "a") for i in range(5)]
    rows += [(70, " ".join(word() for _ in range(30_000)) + passages[0], "en", "a"), rows[9], (None, passages[1], "en", None)]
    return rows


def test_long_matches(spark, odd):
    got = sorted(map(tuple, runindex.digest(runindex.without_long_matches(spark, frame(spark, odd))).collect()), key=str)
    first: dict[bytes, int] = {}
    data = [(-(1 << 63) if i is None else i, i, (t or "").encode()) for i, t, _, _ in odd]
    for k, _, b in data:
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(k, first.get(w, k))
    want = []
    for k, i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < k:
                gone[s + 1 : s + 51] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
        want.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[2] for r in want) > 1000


def test_simhash_groups(spark, odd):
    got = sorted(map(tuple, simhash.near_duplicates(spark, frame(spark, odd)).collect()), key=str)

    def plain(text):
        ws = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sh = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    fps = [plain(t) for _, t, _, _ in odd]
    root = list(range(len(odd)))
    for a in range(len(odd)):
        for b in range(len(odd)):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root = [root[a] if r == root[b] else r for r in root]
    want = []
    for k, (i, *_) in enumerate(odd):
        ids = [j for r, (j, *_) in zip(root, odd) if r == root[k] and j is not None]
        want.append((i, f"{fps[k]:016x}", min(ids) if ids else None))
    assert got == sorted(want, key=str)


def test_bit_planes_against_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    base[100:200] = base[:100] ^ np.uint64(5)
    near = simhash.close_lanes(base, simhash.planes(base), len(base))
    assert (near == (np.bitwise_count(base[:, None] ^ base[None, :]) <= 2)).all()


def test_links_in_cut_buckets(spark):
    rng = np.random.default_rng(2)
    values = sorted({int(x) ^ (1 << int(b)) for x in rng.integers(0, 1 << 40, 6) for b in rng.integers(0, 30, 40)})
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    whole, cut = (simhash.components(spark, simhash.links(spark, distinct, n)) for n in (2048, 16))
    assert sorted(whole.collect()) == sorted(cut.collect()) != []


def test_wavelet_round_trip():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 300, 1000).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids, np.array([400, 600])).to_bytes())
    assert (matrix.all_ids() == ids).all() and (matrix.access(np.arange(1000)) == ids).all()
    for token in (int(ids[0]), 299, 511, 5000):
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places) and matrix.count(token, 100, 700) == ((places >= 100) & (places < 700)).sum()
        assert [matrix.select(token, k) for k in range(len(places) + 1)] == [*places.tolist(), -1]


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(map(tuple, wavelet.encode_documents(spark, frame(spark, odd), queries.tokenizer_path(), 500).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t, _, _ in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_piecewise_hash(spark, odd):
    got = sorted(map(tuple, ctph.fingerprints(frame(spark, odd), 3).collect()), key=str)
    rows = sorted(((i, t or "") for i, t, _, _ in odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        f, g, h = (ctph.fingerprint(x.encode()) for x in (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, ctph.likeness(f, g), ctph.likeness(f, h)))
    assert got == sorted(want, key=str)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert ctph.edit_distance(a, b) == plain(a, b)


def test_licenses(spark, odd):
    notes = [(500, "x y z " + licenses.TEMPLATES["GPL-3.0"] + " a b " + licenses.TEMPLATES["MIT"], "en", "a"), (501, licenses.TEMPLATES["MIT"][:20], "en", "a")]
    got = {(r.doc_id, r.license) for r in licenses.license_spans(frame(spark, odd + notes)).collect()}
    assert got == {(500, "GPL-3.0"), (500, "MIT")}


def test_spans_in_the_original():
    machine = decontam.automaton([("1", "Alpha, béta gamma")])
    text = "é (ALPHA béta--Gamma) x"
    count, ranges, names = decontam.scan(machine, text)
    assert (count, ranges, names) == (5, [(1, 4)], ["1"])
    assert [text[a:b] for a, b in decontam.hit_spans(text, ranges)] == ["ALPHA béta--Gamma"]


def test_contamination_in_blocks(spark, odd):
    bench = spark.createDataFrame([(i, t) for i, t, _, _ in odd[4:20]] + [(None, "a b"), (99, None)], "item_id long, text string")
    docs = frame(spark, odd)
    one, many = (decontam.digest(decontam.scan_documents(spark, docs, bench, block_bytes=n)).collect() for n in (1 << 20, 1000))
    assert sorted(one, key=str) == sorted(many, key=str) and any(r.contaminated for r in one)


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd", "", ""), (2, "x\na\nb\nc\nz", "", ""), (3, None, "", ""), (4, "", "", ""), (5, "q\nq\nq\nq\nq", "", ""), (None, "b\nc\nd", "", "")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.without_repeats(frame(spark, rows)).collect()}
    assert got == {None: ("b\nc\nd", 3, 0), 1: ("a", 4, 3), 2: ("x\nz", 5, 3), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("q", 5, 4)}


def test_language(spark):
    rows = [(i, t, lang, "s") for i in range(30) for t, lang in (("the and of them " * 9, "en"), ("les été où une " * 9, "fr"))]
    net = langid.fit(frame(spark, rows))
    out = langid.predict(frame(spark, rows + [(99, None, None, None), (98, "12 !", None, None)]), net).collect()
    assert all(r.lang_pred == (r.lang or "und") and 0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.predict(frame(spark, rows), None).collect()} == {"und"}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert runindex.without_long_matches(spark, none).count() == 0
    assert simhash.near_duplicates(spark, none).count() == 0
    assert wavelet.encode_documents(spark, none, queries.tokenizer_path()).count() == 0
    assert ctph.fingerprints(none, 2).count() == 0
    assert linededup.without_repeats(none).count() == 0
    assert licenses.license_spans(none).count() == 0
    assert langid.fit(none) is None
    assert mixing.mixed(none, queries.mix_domain(), queries.mix_weights(), 1, 70, 2).count() == 0
    pages = spark.createDataFrame([], "position long, record binary")
    assert warcaudit.audit(spark, pages, pages).count() == 0


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_sql(spark, key):
    ok, note = harness.compare(spark, key)
    assert ok, note
