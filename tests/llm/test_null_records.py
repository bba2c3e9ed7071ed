"""Archive audits with repeated and null records; benchmark items without an id."""

from __future__ import annotations

from tidemark.llm import decontam, warcaudit


def test_repeats_and_nulls_in_an_audit(spark):
    left = [(1, k) for k in "AXXZ"] + [(2, None), (3, "C"), (4, None)]
    right = [(1, k) for k in "AYYZ"] + [(3, "C"), (4, None), (5, None)]
    a, b = (spark.createDataFrame([(p, r and r.encode()) for p, r in rows], "position long, record binary") for rows in (left, right))
    assert {(r.position, r.status) for r in warcaudit.audit(spark, a, b).collect()} == {(1, "changed"), (2, "missing"), (5, "extra")}


def test_items_without_id(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (None, None), (7, "one two")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontam.digest(decontam.scan_documents(spark, docs, bench)).collect()}
    assert got == {1: (3, 0, True), 2: (2, 1, True)}
