"""Pipeline rows with null and shared doc_ids."""

from __future__ import annotations

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed):
    return " ".join(f"w{seed}x{k}" for k in range(40))


def test_rows_without_and_with_shared_ids(spark):
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (None, text(3)), (None, text(4)), (None, text(2)), (5, text(5)), (5, text(5)), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got == {(1, text(1)), (2, text(2)), (None, text(3)), (None, text(4)), (5, text(5)), (7, None)} and kept.count() == len(got)


def test_mixture_cuts_by_row(spark):
    rows = [(None, text(k)) for k in range(10)] + [(3, text(k)) for k in range(10, 20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    first, again = (sorted(r.text for r in corpus_pipeline.mix(spark, d, "").collect()) for d in (docs, docs.repartition(7)))
    # Nine tenths of 20 equal rows, whole.
    assert len(first) == 18 == len(set(first)) and first == again
