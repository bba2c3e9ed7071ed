"""Metrics of ranked answers against plain counting, and the weights of the replicates."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V

FAMILIES = ["VIDEO", "CONSENT_CMP", "GAM_ADSERVING", "OTHER"]


def data(n, seed=1):
    rng = random.Random(seed)
    cases = [(i, rng.choice([None, [], ["VIDEO"], ["VIDEO", "OTHER"]]), rng.choice(["a", None])) for i in range(n)]
    ranked = []
    for i, _, _ in cases[: n - 5]:
        picked = rng.sample(FAMILIES, rng.randint(1, 4))
        ranked += [(i, f, r + 1, "LEADING" if r == 0 and rng.random() < 0.6 else "CONTENDER") for r, f in enumerate(picked)]
    return cases, ranked


def frames(spark, cases, ranked):
    return spark.createDataFrame(cases, "case_id BIGINT, accepted ARRAY<STRING>, kind STRING"), spark.createDataFrame(ranked, "case_id BIGINT, family STRING, rank INT, status STRING")


def plain(cases, ranked):
    of = {}
    for i, accepted, _ in cases:
        good = set(accepted or [])
        rows = [r for r in ranked if r[0] == i]
        asserted = [r[1] for r in rows if r[3] == "LEADING"]
        of[i] = (
            (any(r[1] in good and r[2] == 1 for r in rows), bool(good)), (any(r[1] in good and r[2] <= 3 for r in rows), bool(good)),
            (any(f not in good for f in asserted), True), (not asserted and not good, not asserted), (not asserted and not good, not good),
        )
    out = {}
    for m, name in enumerate(V.METRICS):
        chosen = [of[i][m][0] for i in of if of[i][m][1]]
        out[name] = (len(chosen), sum(chosen) / len(chosen) if chosen else None)
    return out


def test_values_equal_plain_counts(spark):
    cases, ranked = data(300)
    got = V.eval_set_metrics(*frames(spark, cases, ranked), ["kind"], 40).collect()
    for slice_value, chosen in (("", cases), ("a", [c for c in cases if c[2] == "a"])):
        name = "all" if chosen is cases else "kind"
        want = plain(chosen, ranked)
        for r in (r for r in got if r.slice == name and r.slice_value == slice_value):
            assert (r.cases, r.value) == (want[r.metric][0], pytest.approx(want[r.metric][1]))
            assert r.lower <= r.value <= r.upper
            # About two standard errors to each side.
            assert r.upper - r.lower < 6 * (r.value * (1 - r.value) / r.cases) ** 0.5 + 1e-9
    assert {(r.slice, r.slice_value) for r in got} == {("all", ""), ("kind", "a"), ("kind", "")}


def test_replicates_repeat_whatever_the_order(spark):
    cases, ranked = data(120, 2)
    read = lambda c, r: sorted(map(tuple, V.eval_set_metrics(*frames(spark, c, r), ["kind"], 25).collect()), key=str)
    one = read(cases, ranked)
    random.Random(0).shuffle(cases)
    random.Random(0).shuffle(ranked)
    assert read(cases, ranked) == one


def test_weights_are_poisson_of_one(spark):
    weights = [r.w for r in spark.range(40000).select(V.poisson_weight(F.col("id").cast("string")).alias("w")).collect()]
    assert statistics.mean(weights) == pytest.approx(1, abs=0.02)
    assert statistics.variance(weights) == pytest.approx(1, abs=0.04)
    assert weights.count(0) / len(weights) == pytest.approx(0.3679, abs=0.01)


def test_no_cases(spark):
    cases, ranked = frames(spark, *data(10))
    assert V.eval_set_metrics(cases.limit(0), ranked, ["kind"]).count() == 0
    bare = V.eval_set_metrics(cases, ranked.limit(0), [], 5).collect()
    assert {r.metric: r.value for r in bare}["unresolved_recall"] == 1.0


def test_a_weight_is_hashed_once_and_sums_are_what_multiplies(spark):
    """the hash stood in the plan once for every comparison of every use, and every slice repeated every replicate of a case."""
    cases, ranked = data(20)
    plan = V.eval_set_metrics(*frames(spark, cases, ranked), ["kind"], 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert plan.index("inline(") < plan.rindex("Aggregate [replicate")
