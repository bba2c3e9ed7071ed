"""License scan against brute-force containment, with edited texts and the license lines of the tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, queries
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def parts(text):
    ws = re.findall("[a-z0-9]+", text.lower())
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def plain(text, templates):
    """Templates of which some window of their length holds four fifths."""
    mine, out = parts(text), set()
    for name, body in templates.items():
        wanted, size = set(parts(body)), len(parts(body))
        starts = range(max(1, len(mine) - size + 1))
        if len(wanted & set(mine)) >= 0.8 * len(wanted) and any(len(wanted & set(mine[i : i + size])) >= 0.8 * len(wanted) for i in starts):
            out.add(name)
    return out


def test_edited_texts_against_brute_force(spark):
    every = licenses.all_templates()
    texts = ["Licensed under CC BY-NC 4.0."]
    for name in licenses.TEXTS:
        words = every[name].split()
        changed = [("edited" if k % 60 == 30 else w) for k, w in enumerate(words)]
        broken = [("edited" if k % 9 == 5 else w) for k, w in enumerate(words)]
        texts += [" ".join(x) for x in (words, changed, ["before"] * 30 + changed + ["after"] * 30, words[: len(words) * 9 // 10], broken)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {k: set() for k in range(len(texts))}
    for r in licenses.license_spans(docs).collect():
        got[r.doc_id].add(r.license)
    assert got == {k: plain(t, every) for k, t in enumerate(texts)}
    assert got[0] == {"CC-BY-NC-4.0"} and all(name in got[1 + 5 * k + j] for k, name in enumerate(licenses.TEXTS) for j in range(4))


def test_lines_of_the_table(spark):
    rows = table(spark, SF, "documents").where(F.col("text").rlike("(?i)licen[sc]e")).select("doc_id", "text").collect()
    short = licenses.TEMPLATES
    want = {(r.doc_id, name) for r in rows for name in plain(r.text, short)}
    got = {(r.doc_id, r.license) for r in queries.op6_license_scan(spark, SF).collect()}
    assert want <= got and sum(name == "CC-BY-NC-4.0" for _, name in want) == 4


def test_short_template_is_refused():
    with pytest.raises(ValueError):
        licenses.Matcher({"x": "only four words here"})


def test_bands_are_slid_only_where_their_shingle_occurs(monkeypatch):
    slid, least = [], licenses._least
    monkeypatch.setattr(licenses, "_least", lambda values, width: slid.append(width) or least(values, width))
    every = licenses.all_templates()
    matcher = licenses.Matcher(every)
    assert matcher.scan("a long text that speaks of software, of files and of their copies, without a license " * 20) == [] and not slid
    # Templates cut, changed and run together: every band of every size finds no more than that.
    mul, add = licenses._bands(licenses.BANDS)
    for name, other in zip(every, reversed(every)):
        body = every[name].split()
        for step in (7, 40, 10_000):
            text = " ".join(("edited" if k % step == 6 else w) for k, w in enumerate(body[len(body) // 12 :] + every[other].split()))
            found = licenses.shingles(licenses.words(text), matcher.hashes)
            want = set()
            for size, group in matcher.by_size.items():
                for band in range(licenses.BANDS):
                    runs = least(found * mul[band] + add[band], min(size, len(found)))
                    for title, wanted, keys in group:
                        starts = (i for i in (runs == keys[band]).nonzero()[0] if len(wanted & set(found[i : i + size].tolist())) >= 0.8 * len(wanted))
                        want.update((title, int(i)) for i in starts)
            got = matcher.scan(text)
            assert {t for t, _ in want} == {t for t, *_ in got}
            assert all(any(t == title and a <= i < b for t, a, b, _ in got) for title, i in want)
