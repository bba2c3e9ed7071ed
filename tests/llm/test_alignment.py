"""Op 12 against the two libraries' own tokens, aligned one text at a time."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "a  b\t\tc\n\n", "don't we'll I'M 'S", "<s>x</s> <|endoftext|> <0x41>", "▁under", "  é é é ﬁ", "日本語 тест 🙂🙂 🏳️‍🌈",
    "\x00\x01 null", "1234567 3.14 12,000", "The the THE the", "x" * 5000, " " * 3000, "The the THE the", "naïve café " * 3000, "﻿bom", "a\r\nb",
]


@pytest.fixture(scope="module")
def wanted():
    plain, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    plain.encode_special_tokens = True
    byte = alignment._byte_of()
    out, counts = {}, Counter()
    for k, text in enumerate(TEXTS):
        out[k] = None
        if not text:
            continue
        own = plain.encode(" " + text, add_special_tokens=False)
        left = [bytes(byte[c] for c in t) for t in own.tokens]
        ids = model.encode(text)
        named = [model.id_to_piece(i) for i in ids]
        right = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, named)]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            continue
        ends = [[len(b"".join(x[: i + 1])) for i in range(len(x))] if len(x) < 2000 else list(_sums(x)) for x in (left, right)]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = [{e: i for i, e in enumerate(x)} for x in ends]
        links = [(own.ids[at[0][e]], ids[at[1][e]]) for e in both]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in both:
            groups.append(",".join(map(str, own.ids[i : at[0][e] + 1])) + "|" + ",".join(map(str, ids[j : at[1][e] + 1])))
            i, j = at[0][e] + 1, at[1][e] + 1
        out[k] = (len(left), len(right), len(both), links, ";".join(groups))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    rows = {}
    for k, found in out.items():
        if found is None:
            rows[k] = (0, 0, 0, 0, 0, 0, "", "")
        else:
            n_a, n_b, n, links, groups = found
            best = sum(counts[x] == highest[x[1]] for x in links)
            rows[k] = (n_a, n_b, n, len(links), best, sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest(), groups)
    return rows


def _sums(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


def test_alignment(spark, wanted):
    rows = [(k, t, 7, [1]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, pairs array<int>").repartition(3)
    got = alignment.alignment(spark, docs, A, B, with_groups=True).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        found = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups or "")
        assert found == wanted[r.doc_id], TEXTS[r.doc_id]
    assert wanted[7][0] == 0 and wanted[3][0] > 0


def test_encoders_agree():
    fast, plain = alignment.byte_level(A), alignment._library_encoder(A)
    texts = [" " + (t or "") for t in TEXTS]
    assert fast.encode(texts) == plain(texts)


def test_empty_and_shared_ids(spark):
    schema = "doc_id long, text string"
    assert alignment.alignment(spark, spark.createDataFrame([], schema), A, B).collect() == []
    assert {r.n_a for r in alignment.alignment(spark, spark.createDataFrame([(1, None), (2, "")], schema), A, B).collect()} == {0}
    rows = [(None, "one two"), (None, "one two"), (2**60 + 1, "one")]
    got = alignment.alignment(spark, spark.createDataFrame(rows, schema), A, B).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1152921504606846977", "None", "None"]
    # "one" ends a token pair in all three rows, "two" in two of them.
    assert sorted(r.count_sum for r in got) == [3, 5, 5]
