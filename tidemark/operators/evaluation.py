"""Metrics over evaluation cases with ranked answers, with intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash60

# A replicate gives each case a weight of Poisson(1); the tail beyond the last step has a probability below 1e-12.
MOST = 14


def poisson_steps() -> list[float]:
    """Cumulative probabilities of Poisson(1)."""
    steps, total = [], 0.0
    for k in range(MOST):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    return steps


def poisson_place(seed: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return hash60(seed) / F.lit(float(1 << 60))


def poisson_steps_passed(place: Column) -> Column:
    """Poisson(1) by inversion; reads its argument once a step."""
    return sum((F.when(place >= F.lit(step), 1).otherwise(0) for step in poisson_steps()[1:]), F.when(place >= F.lit(poisson_steps()[0]), 1).otherwise(0))


def poisson_weight(seed: Column) -> Column:
    """Poisson(1) by inversion of a hash: the same seed always weighs the same, on any machine and in any order."""
    return poisson_steps_passed(poisson_place(seed))


def case_outcomes(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per case: numerators and denominators of the metrics as 0 and 1.

    Cases: case_id (unique), accepted (array of families; none or null means that the case is unresolved), slice columns.
    Ranked: case_id, family, rank, status.  An answer asserts a cause where a family leads; a case without any answer does not.
    """
    accepted = F.coalesce("accepted", F.array().cast("array<string>"))
    good = F.array_contains("_accepted", F.col("family"))
    leads = F.col("status") == "LEADING"
    answers = ranked.join(cases.select("case_id", accepted.alias("_accepted")), "case_id").groupBy("case_id").agg(
        F.bool_or(good & (F.col("rank") == 1)).alias("_first"), F.bool_or(good & (F.col("rank") <= 3)).alias("_three"),
        F.bool_or(leads).alias("_asserts"), F.bool_or(leads & ~good).alias("_false"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    settled = F.size(accepted) > 0
    silent = ~yes(F.col("_asserts"))
    metrics = {
        "top1_accuracy": (yes(F.col("_first")), settled),
        "top3_recall": (yes(F.col("_three")), settled),
        "false_cause_rate": (yes(F.col("_false")), F.lit(True)),
        "unresolved_precision": (silent & ~settled, silent),
        "unresolved_recall": (silent & ~settled, ~settled),
    }
    return cases.join(answers, "case_id", "left").select(
        *[c for c in cases.columns if c != "accepted"],
        *[side.cast("bigint").alias(f"{name}_{part}") for name, pair in metrics.items() for part, side in zip(("of", "in"), (pair[0] & pair[1], pair[1]))],
    )


METRICS = ("top1_accuracy", "top3_recall", "false_cause_rate", "unresolved_precision", "unresolved_recall")


def eval_set_metrics(cases: DataFrame, ranked: DataFrame, slices: list[str], replicates: int = 200, level: float = 0.95, seed: str = "") -> DataFrame:
    """Metrics of all cases and of every value of each slice column, with bootstrap intervals.

    Returns slice, slice_value, metric, cases (the denominator), value, lower, upper.  Replicate 0 weighs every case once and
    gives the value.  The others weigh a case by a hash of its id and the replicate: they are made and summed in the pass that
    reads the cases, so no replicate is ever a copy of the data, and what is shuffled is one weight per combination of slice
    values and outcomes, and replicate.  A metric without cases has no value; replicates without cases do not count for the interval.
    """
    names = [F.struct(F.lit("all").alias("slice"), F.lit("").alias("slice_value"))]
    names += [F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("slice_value")) for c in slices]
    outcomes = case_outcomes(cases, ranked)
    sides = [f"{m}_{part}" for m in METRICS for part in ("of", "in")]
    drawn = outcomes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # A column of its own: the fourteen comparisons of a weight read one hash instead of making it again.
    place = poisson_place(F.concat_ws(":", F.lit(seed), F.col("case_id").cast("string"), F.col("replicate").cast("string")))
    placed = drawn.withColumn("_place", F.when(F.col("replicate") > 0, place))
    weight = F.when(F.col("replicate") == 0, 1).otherwise(poisson_steps_passed(F.col("_place")))
    # Cases alike in slices and outcomes are weighed together, so slices and metrics multiply sums, not cases.
    alike = placed.select("replicate", *slices, *sides, weight.alias("_w")).groupBy("replicate", *slices, *sides).agg(F.sum("_w").alias("_w"))
    weighed = alike.select("replicate", "_w", *sides, F.inline(F.array(*names)))
    sums = weighed.groupBy("slice", "slice_value", "replicate").agg(*[F.sum(F.col("_w") * F.col(s)).alias(s) for s in sides])
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_of").alias("of"), F.col(f"{m}_in").alias("of_in")) for m in METRICS]))
    rates = sums.select("slice", "slice_value", "replicate", each).withColumn("rate", F.when(F.col("of_in") > 0, F.col("of") / F.col("of_in")))
    own, again = F.col("replicate") == 0, F.when(F.col("replicate") > 0, F.col("rate"))
    # As many numbers meet here as there are replicates.
    return rates.groupBy("slice", "slice_value", "metric").agg(
        F.coalesce(F.max(F.when(own, F.col("of_in"))), F.lit(0)).alias("cases"), F.max(F.when(own, F.col("rate"))).alias("value"),
        F.percentile(again, F.lit((1 - level) / 2)).alias("lower"), F.percentile(again, F.lit((1 + level) / 2)).alias("upper"),
    )
