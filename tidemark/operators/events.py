"""Cohort rules and condition lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.catalogs import ADS_CONDITION_CODES
from tidemark.functions.numbers import severity_name, severity_rank
from tidemark.functions.shape import either
from tidemark.operators.machines import run_machine
from tidemark.operators.ordered import carry_previous, time_bucket


def window_status(windows: DataFrame, runs: DataFrame, final: tuple[str, ...]) -> DataFrame:
    """Status of each window from the statuses of its runs."""
    keys = ["site", "scheduled_for"]
    counts = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.count_if(~F.col("status").isin(*final)).alias("open_runs"),
        F.count_if(F.col("status") != "PENDING").alias("started"),
        F.count_if(F.col("status") == "BROWSER_ERROR").alias("failed"),
    )
    status = either(
        (F.col("runs").isNull(), "SCHEDULED"),
        ((F.col("open_runs") > 0) & (F.col("started") > 0), "RUNNING"),
        (F.col("open_runs") > 0, "SCHEDULED"),
        (F.col("failed") == F.col("runs"), "FAILED"),
        (F.col("failed") > 0, "PARTIAL"),
        otherwise="COMPLETE",
    )
    return windows.join(counts, keys, "left").withColumn("window_status", status)


COHORT = ["window_id", "template_id", "scenario_id"]


def noindex_cohort(pairs: DataFrame) -> DataFrame:
    """Template events where two or more URLs gained noindex, else one event for the single one.

    Pairs: cohort keys, url_id, run_id, affected, previous_at, current_at; valid count = rows.  A
    cohort with two affected rows always has two valid ones, so what stays single is one row per
    cohort and the aggregate itself carries it: no join back to the pairs.
    """
    hit = F.struct("run_id", "previous_at", "current_at")
    groups = pairs.groupBy(*COHORT).agg(
        F.count_if("affected").alias("hits"), F.count("*").alias("rows"), F.min(F.when(F.col("affected"), hit)).alias("single"),
        F.min(F.when(F.col("affected"), F.col("previous_at"))).alias("occurred_after"),
        F.max(F.when(F.col("affected"), F.col("current_at"))).alias("detected_at"),
    )
    wide = F.col("hits") >= 2
    one = F.lit(1).cast("bigint")
    return groups.where("hits > 0").select(
        *COHORT, F.when(~wide, F.col("single.run_id")).alias("run_id"), F.when(wide, "rendered-template").otherwise("rendered-page").alias("subject"),
        F.when(wide, "CRITICAL").otherwise("MEDIUM").alias("severity"), F.when(wide, F.col("hits")).otherwise(one).alias("affected_count"),
        F.when(wide, F.col("rows")).otherwise(one).alias("valid_count"), "occurred_after", "detected_at",
    )


def slot_cohort(slots: DataFrame, min_affected: int = 2, min_valid: int = 2, critical: int = 3, timed: bool = False) -> DataFrame:
    """Actions per cohort and slot; valid count = distinct URLs.

    Slots: cohort keys, url_id, slot, present, previous_present (null when not seen before).  When ``timed``, slots also carry
    previous_at and current_at, and an action occurred_after, occurred_before (of the runs that caused it) and detected_at.
    """
    missing, seen = ~F.col("present"), F.col("present")
    lost = missing & F.coalesce("previous_present", F.lit(False))
    spans = [
        f(F.when(rows, F.col(c))).alias(f"_{name}_{c}") for name, rows in (("missing", missing), ("seen", seen), ("lost", lost)) if timed
        for f, c in ((F.min, "previous_at"), (F.max, "current_at"))
    ]
    groups = slots.groupBy(*COHORT, "slot").agg(
        F.count_if(missing).alias("affected_count"),
        F.count_if(seen).alias("healthy_count"),
        F.count_if(lost).alias("transitions"),
        F.countDistinct("url_id").alias("valid_count"),
        *spans,
    )
    enough = (F.col("affected_count") >= min_affected) & (F.col("valid_count") >= min_valid)
    action = either(
        (enough & (F.col("transitions") >= min_affected), "UPSERT"),
        (enough, "SUPPORT"),
        ((F.col("affected_count") == 0) & (F.col("healthy_count") >= min_valid) & (F.col("valid_count") >= min_valid), "RESOLVE"),
    )
    all_hit = (F.col("affected_count") >= critical) & (F.col("affected_count") == F.col("valid_count"))
    severity = F.when(F.col("action").isin("UPSERT", "SUPPORT") & all_hit, "CRITICAL").otherwise("HIGH")
    acted = groups.withColumn("action", action).where(F.col("action").isNotNull()).withColumn("severity", severity)
    if not timed:
        return acted
    caused = lambda c: either(
        (F.col("action") == "UPSERT", F.col(f"_lost_{c}")), (F.col("action") == "SUPPORT", F.col(f"_missing_{c}")), otherwise=F.col(f"_seen_{c}")
    )
    detected = F.coalesce("_missing_current_at", "_seen_current_at")
    return acted.withColumns({"occurred_after": caused("previous_at"), "occurred_before": caused("current_at"), "detected_at": detected})


def in_complete_windows(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Cohorts are only judged once their window is complete.  Windows: site, scheduled_for, window_status."""
    complete = windows.where(F.col("window_status") == "COMPLETE").select("site", "scheduled_for")
    return pairs.join(complete, ["site", "scheduled_for"], "left_semi")


def pending_without_cohort(pending: DataFrame, cohort: DataFrame) -> DataFrame:
    """Local pending candidates whose code no cohort of their window emitted, whatever its action."""
    emitted = cohort.select("window_id", "code").distinct()
    return pending.join(emitted, ["window_id", "code"], "left_anti")


def candidate_union(local: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    """Both candidate lists in order (local first), each candidate once at its first position."""
    both = local.withColumn("section", F.lit(0)).unionByName(cohort.withColumn("section", F.lit(1)))
    return both.groupBy(*keys).agg(F.min(F.struct("section", "position")).alias("first")).select(
        *keys, F.col("first.section").alias("section"), F.col("first.position").alias("position")
    )


def condition_lifecycle(
    actions: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None, weight: str | None = None
) -> DataFrame:
    """Fold UPSERT, SUPPORT and RESOLVE actions into episodes.

    Actions: keys, at, run_id, action, severity, affected_count, valid_count.  All actions of a run share its time, and
    ``order`` starts with time and run, so that they follow each other.  Only an UPSERT opens; what a run has to say once it
    counts for the open episode is ignored, a RESOLVE included; what it said before the episode opened does not count.
    ``weight`` names a column with the number of runs an action rests on, one where it is not given.
    """
    bucket = time_bucket("at") if bucket is None else bucket
    line = Window.partitionBy(*keys, bucket).orderBy(*order)
    fresh = ~F.lag("run_id").over(line).eqNullSafe(F.col("run_id"))
    rows = actions.withColumn("_fresh", fresh)
    maps = lambda inactive, active: F.array(F.lit(inactive), F.lit(active))
    moves = either(
        (F.col("action") == "UPSERT", maps(1, 1)), ((F.col("action") == "RESOLVE") & F.col("_fresh"), maps(0, 0)), otherwise=maps(0, 1)
    )
    moved = run_machine(rows, keys, order, moves, 2, [1], bucket)
    was, is_ = F.col("state_before") == 1, F.col("state_after") == 1
    used = moved.withColumn("_counts", is_ & (F.col("_fresh") | ~was)).withColumn("_closes", was & ~is_).where("_counts OR _closes")
    lives = F.col("_counts")
    return used.groupBy(*keys, F.col("ordinal").alias("episode")).agg(
        F.min(F.when(lives, F.col("at"))).alias("detected_at"),
        F.min(F.when(lives & (F.col("state_before") == 0), F.col("run_id"))).alias("opened_by"),
        F.max(F.when(F.col("_closes"), F.col("at"))).alias("ended_at"),
        F.max("at").alias("latest_observed_at"),
        severity_name(F.max(F.when(lives, severity_rank(F.col("severity"))))).alias("severity"),
        (F.count_if(lives) if weight is None else F.sum(F.when(lives, F.col(weight)))).alias("supporting_count"),
        F.max(F.when(lives, F.col("affected_count"))).alias("affected_count"),
        F.max(F.when(lives, F.col("valid_count"))).alias("valid_count"),
        F.max(F.when(lives, F.when(F.col("affected_count") >= 2, 2).otherwise(1))).alias("blast_radius"),
    ).withColumn("status", F.when(F.col("ended_at").isNotNull(), "RESOLVED").otherwise("ACTIVE"))


def with_sibling_resolves(actions: DataFrame) -> DataFrame:
    """Ads file conditions exclude each other: an UPSERT first closes its siblings.

    Adds ``seq`` so that the closing rows sort just before the row that caused them.
    """
    codes = F.array(*[F.lit(c) for c in ADS_CONDITION_CODES.values()])
    siblings = (
        actions.where(F.col("action") == "UPSERT")
        .withColumn("code", F.explode(F.array_except(codes, F.array("code"))))
        .withColumn("action", F.lit("RESOLVE"))
        .withColumn("seq", F.lit(0))
    )
    return actions.withColumn("seq", F.lit(1)).unionByName(siblings)


def exclusive_conditions(actions: DataFrame, keys: list[str]) -> DataFrame:
    return condition_lifecycle(with_sibling_resolves(actions), [*keys, "code"], ["at", "run_id", "seq"])


def reliability_recoveries(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Healthy observations that close an open degradation.

    Observations: keys, at, run_id, state (DEGRADED, CHALLENGE or OK).  The first healthy run
    strictly later than the last degradation, and not that run itself, recovers it; later
    healthy runs stay quiet.
    """
    bad = F.when(F.col("state") != "OK", F.struct("at", "run_id", "state"))
    seen = carry_previous(
        observations.withColumn("_bad", bad), keys, ["at", "run_id"], "_bad", "_open", time_bucket("at")
    )
    healthy = seen.where(
        (F.col("state") == "OK") & (F.col("at") > F.col("_open.at")) & (F.col("run_id") != F.col("_open.run_id"))
    )
    return healthy.groupBy(*keys, F.col("_open.run_id").alias("degraded_run"), F.col("_open.at").alias("degraded_at")).agg(
        F.min(F.struct("at", "run_id")).alias("_first")
    ).select(*keys, "degraded_run", "degraded_at", F.col("_first.run_id").alias("recovered_run"), F.col("_first.at").alias("recovered_at"))


def reliability_events(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded reliability events: every degradation and the recoveries."""
    bad = observations.where(F.col("state") != "OK").select(
        *keys, "at", "run_id", either((F.col("state") == "CHALLENGE", "BROWSER_ACCESS_CHALLENGE_SUSPECTED"), otherwise="BROWSER_SOURCE_DEGRADED").alias("code")
    )
    good = reliability_recoveries(observations, keys).select(
        *keys, F.col("recovered_at").alias("at"), F.col("recovered_run").alias("run_id"), F.lit("BROWSER_SOURCE_RECOVERED").alias("code")
    )
    return bad.unionByName(good)


def reliability_current(events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest reliability event per key decides whether the source is degraded."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("code", "at", "run_id"), F.struct("at", "run_id")).alias("last")).select(
        *keys, F.col("last.code").alias("code"), F.col("last.at").alias("at"), F.col("last.run_id").alias("run_id"),
        F.when(F.col("last.code") == "BROWSER_SOURCE_RECOVERED", "HEALTHY").otherwise("DEGRADED").alias("state"),
    )


def health_trigger(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Each event with the source of its first trigger reference, if any."""
    first = refs.where(F.col("relation").isin("TRIGGER_AFTER", "TRIGGER_BEFORE", "BEFORE")).groupBy("event_id").agg(
        F.min_by("source_id", "ref_id").alias("trigger_source")
    )
    return events.join(first, "event_id", "left")


def evidence_integrity(events: DataFrame, refs: DataFrame, runs: DataFrame) -> DataFrame:
    """References whose event or run is missing, or whose run lies outside the event's scope."""
    scope = events.select("event_id", F.col("site").alias("event_site"), F.col("scenario_id").alias("event_scenario"))
    owner = runs.select(F.col("run_id").alias("source_id"), F.col("site").alias("run_site"), F.col("scenario_id").alias("run_scenario"))
    reason = either(
        (F.col("event_site").isNull(), "EVENT_NOT_FOUND"),
        (F.col("run_site").isNull(), "RUN_NOT_FOUND"),
        (F.col("event_site") != F.col("run_site"), "SITE_MISMATCH"),
        (F.col("event_scenario") != F.col("run_scenario"), "SCENARIO_MISMATCH"),
    )
    return refs.join(scope, "event_id", "left").join(owner, "source_id", "left").withColumn("reason", reason).where(
        F.col("reason").isNotNull()
    )
