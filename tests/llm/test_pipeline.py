"""Pipeline stages, each on its predecessor's rows; near-dedup, decontamination and token files against plain versions."""

from __future__ import annotations

import random
import re
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, queries
from tidemark.llm.common import free_name, shielded, stored, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def windows(words):
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    from tokenizers import Tokenizer

    steps = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(spark, stage(spark, steps[-1], SF), name))
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:5]]
    assert all(set(b) <= set(a) for a, b in pairwise(texts)) and all(s.columns == steps[0].columns for s in steps[:5])
    sets = {d: shingles(t) for d, t in texts[1].items()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sets:
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert set(texts[2]) == set(root.values())
    bench = [plain_words(r.text) for r in table(spark, SF, "benchmark").collect()]
    wanted = set().union(*map(windows, bench))
    assert min(map(len, bench)) >= 10
    assert set(texts[3]) == {d for d, t in texts[2].items() if not windows(plain_words(t)) & wanted}
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in steps[5].collect()}
    assert got == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts[4].items()}


def test_language_stage_keeps_unlabelled_texts(spark):
    rows = [(1, "some plain words", None, "a", 1), (2, None, None, "a", 1), (3, "", None, "a", 1), (4, "123 ...", None, "a", 1), (None, "mehr Worte", None, None, 1)]
    kept = corpus_pipeline.identify(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_language_stage_rejects_random_letters_and_nothing_clean(spark):
    rng = random.Random(4)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    junk = [(10**6 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(200, 900))), None, "x", 1) for i in range(30)]
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), SF).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("text rlike '\\\\p{L}' AND n_chars > 100").select("doc_id").collect()}
    assert len(clean - kept) <= len(clean) / 500
    assert not {d for d, *_ in junk} & kept


def test_held_out_accuracy_without_labels_of_others(spark):
    """The query's answers do not depend on labels it may not learn from, and are right on rows it has not learned."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    hidden = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    nets = [langid.fit(d.where(~langid.held_out())) for d in (docs, hidden)]
    assert all((getattr(nets[0], f) == getattr(nets[1], f)).all() for f in nets[0].__dataclass_fields__ if f != "labels")
    rated = langid.predict(docs.where(langid.held_out()), nets[0])
    right, n = rated.where("lang_pred <> 'und'").agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("lang")).first()
    assert right / n > 0.97


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_on_an_empty_table(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []


def test_clashing_columns_pass(spark):
    extra = ", lang_pred string, score double, _letters int, _row string, n_words int, hit_starts string, item_ids string, `a.b` int"
    rows = [(i, f"word{i} and many others stand here {i * i} times over", "en", "s", 1, "p", 0.5, 7, "r", 3, "h", "i", i) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA + extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {tuple(r) for r in got.collect()} <= set(rows), name


def test_free_names(spark):
    docs = spark.createDataFrame([(1, 2)], "_X int, `_x_` int")
    assert free_name(docs, "_x") == "_x__"
    held, back = shielded(docs, ["_x"])
    assert "_X" not in held.columns and back(held).columns == docs.columns
