"""The chain from comparable pairs to event candidates, skip reasons and condition episodes.

Pairs are the output of ``pair_validity``: run_id, previous_id, site, scheduled_for, template_id, scenario_id, url_id,
skip_reasons and the cur_ and prev_ states.  A pair speaks for itself (section 0) and, once its window is complete, together
with the other pairs of its window (section 1).  Everything is rows: no window and no run gathers its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalogs import EVENT_RULES, VALID_RUN_STATUSES
from tidemark.functions.shape import either
from tidemark.operators import events as E
from tidemark.operators import lineage as L
from tidemark.session import written

WINDOW = ["site", "scheduled_for"]
SCOPE = [*WINDOW, "template_id", "scenario_id"]
CANDIDATE = [
    "section", *SCOPE, "url_id", "run_id", "code", "subject", "action", "severity", "occurred_after", "detected_at", "affected_count", "valid_count", "runs",
]
CONDITION = ["site", "code", "subject", "template_id", "scenario_id", "url_id"]
CONDITION_ACTIONS = ("UPSERT", "SUPPORT", "RESOLVE")
COMPLETE = "window_status = 'COMPLETE'"


def default_severity(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for rule in EVENT_RULES for x in (rule[0], rule[2])]), code)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.size("skip_reasons") == 0)


def in_windows(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs with the status of their window.  Windows: site, scheduled_for, window_status; an unknown one is not complete."""
    status = F.coalesce("window_status", F.lit("UNKNOWN"))
    return pairs.join(windows.select(*WINDOW, "window_status"), WINDOW, "left").withColumn("window_status", status)


def window_skips(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Skip reasons of every window with the number of runs that gave them: site, scheduled_for, reason, runs.

    A window that is not complete gives only that reason; a known one without any pair is empty.  In a complete one each
    unusable pair gives all its reasons.  Pairs carry window_status.
    """
    inputs = pairs.where(F.col("previous_id").isNotNull())
    reasons = F.array_distinct(F.concat(F.array_compact(F.array(L.invalid_reason())), L.component_skips()))
    given = inputs.select(*WINDOW, F.explode(F.when(F.expr(COMPLETE), reasons).otherwise(F.array(F.lit("INCOMPLETE_CHECKPOINT_WINDOW")))).alias("reason"))
    empty = windows.select(*WINDOW).join(inputs.select(*WINDOW).distinct(), WINDOW, "left_anti").select(
        *WINDOW, F.lit("EMPTY_CHECKPOINT_WINDOW").alias("reason"), F.lit(0).cast("bigint").alias("runs")
    )
    return given.groupBy(*WINDOW, "reason").agg(F.count("*").alias("runs")).unionByName(empty)


def run_skips(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Skip reasons of single runs: run_id, reason.  A run without predecessor has only that one."""
    own = F.when(F.col("previous_id").isNull(), F.array(F.lit("NO_PREDECESSOR"))).otherwise(F.col("skip_reasons"))
    lost = facts.where((F.col("kind") == "DEPENDENCY") & ~F.col("here") & F.col("was") & F.col("cut")).select("run_id").distinct()
    return pairs.select("run_id", F.explode(own).alias("reason")).unionByName(lost.withColumn("reason", F.lit("TRUNCATED_DEPENDENCY_ABSENCE")))


def with_prior(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """Adds prior_id, prior_at and whether the exact predecessor of the predecessor may confirm an error."""
    linked = L.lineage_two_back(pairs)
    prior = states.select(
        F.col("run_id").alias("prior_id"), F.col("completed_at").alias("prior_at"), F.col("status").alias("_status"),
        F.col("javascript_errors_version").alias("_version"),
    )
    fit = (
        F.col("_status").isin(*VALID_RUN_STATUSES) & (F.col("prior_at") < F.col("prev_completed_at"))
        & (F.col("_version") == F.col("prev_javascript_errors_version"))
    )
    return linked.join(prior, "prior_id", "left").withColumn("prior_comparable", F.coalesce(fit, F.lit(False))).drop("_status", "_version")


def pair_facts(pairs: DataFrame, dependencies: DataFrame, errors: DataFrame, slots: DataFrame) -> DataFrame:
    """What each usable pair, output of ``with_prior``, holds: one row per pair, kind and member, in one pass over all kinds.

    Dependencies and errors: run_id, member.  Slots: run_id, slot, expected, present; only expected ones count.  ``here``,
    ``was`` and ``before`` say which of the run, its predecessor and the prior one hold the member, ``present`` and
    ``previous_present`` what was seen of a slot.  Pairs carry cur_truncated and prev_truncated.
    """
    flag = F.lit(None).cast("boolean")
    row = lambda df, kind, member, present: df.select(
        F.col("run_id").alias("owner"), F.lit(kind).alias("kind"), F.col(member).cast("string").alias("member"), present.alias("present")
    )
    held = (
        row(dependencies, "DEPENDENCY", "member", flag).unionByName(row(errors, "ERROR", "member", flag))
        .unionByName(row(slots.where(F.col("expected") & F.col("present").isNotNull()), "SLOT", "slot", F.col("present")))
    )
    usable = usable_pairs(pairs)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("owner")) for side, c in enumerate(("run_id", "previous_id", "prior_id"))])
    owners = usable.select("run_id", F.inline(sides)).where(F.col("owner").isNotNull())
    side = lambda n: F.bool_or(F.col("side") == n)
    found = owners.join(held, "owner").where((F.col("side") < 2) | (F.col("kind") == "ERROR")).groupBy("run_id", "kind", "member").agg(
        side(0).alias("here"), side(1).alias("was"), side(2).alias("before"),
        F.bool_or(F.when(F.col("side") == 0, F.col("present"))).alias("present"), F.bool_or(F.when(F.col("side") == 1, F.col("present"))).alias("previous_present"),
    )
    carried = usable.select(
        "run_id", *SCOPE, "url_id", "window_status", "prior_at", "prior_comparable", "prev_completed_at", "cur_completed_at",
        (F.col("cur_truncated") | F.col("prev_truncated")).alias("cut"),
    )
    return found.join(carried, "run_id")


def local_candidates(pairs: DataFrame, facts: DataFrame, gained_noindex: Column) -> DataFrame:
    """What each usable pair says by itself."""
    here, was = F.col("here"), F.col("was")
    of = lambda kind: F.col("kind") == kind
    said = lambda code, action: F.struct(F.lit(code).alias("code"), F.lit(action).alias("action"))
    # Where a list of dependencies was cut off, absence proves nothing.
    verdict = either(
        (of("DEPENDENCY") & here & ~was, said("THIRD_PARTY_DEPENDENCY_ADDED", "RECORD")),
        (of("DEPENDENCY") & ~here & was & ~F.col("cut"), said("THIRD_PARTY_DEPENDENCY_REMOVED", "RECORD")),
        (of("ERROR") & here & ~was, said("JS_ERROR_STARTED", "PENDING")),
        (of("ERROR") & here & F.col("prior_comparable") & ~F.col("before"), said("JS_ERROR_STARTED", "UPSERT")),
        (of("ERROR") & here, said("JS_ERROR_STARTED", "SUPPORT")),
        (of("ERROR") & was, said("JS_ERROR_STARTED", "RESOLVE")),
        (of("SLOT") & ~F.col("present") & F.col("previous_present"), said("GPT_EXPECTED_SLOT_MISSING", "PENDING")),
    )
    kept = ["run_id", *SCOPE, "url_id", "prior_at", "prev_completed_at", "cur_completed_at", "said", "subject"]
    judged = facts.withColumn("said", verdict).withColumn("subject", F.col("member")).where(F.col("said").isNotNull()).select(*kept)
    changed = L.value_changed(F.col("prev_canonical"), F.col("cur_canonical"))
    page = F.array_compact(F.array(F.when(gained_noindex, said("NOINDEX_ADDED", "PENDING")), F.when(changed, said("CANONICAL_CHANGED", "RECORD"))))
    pages = usable_pairs(pairs).withColumn("said", F.explode(page)).withColumn("subject", F.lit("rendered-page")).select(*kept)
    confirmed = F.col("said.action") == "UPSERT"
    one = F.lit(1).cast("bigint")
    # A confirmed error rests on the run before and on this one, everything else on this one.
    return judged.unionByName(pages).select(
        F.lit(0).alias("section"), *SCOPE, "url_id", "run_id", "said.code", "subject", "said.action", default_severity(F.col("said.code")).alias("severity"),
        F.when(confirmed, F.col("prior_at")).otherwise(F.col("prev_completed_at")).alias("occurred_after"), F.col("cur_completed_at").alias("detected_at"),
        one.alias("affected_count"), one.alias("valid_count"), F.when(confirmed, 2 * one).otherwise(one).alias("runs"),
    )


def window_candidates(pairs: DataFrame, facts: DataFrame, gained_noindex: Column) -> DataFrame:
    """What the usable pairs of a complete window say together."""
    window = F.struct(*WINDOW).alias("window_id")
    scope = [window, "template_id", "scenario_id", "url_id"]
    times = [F.col("prev_completed_at").alias("previous_at"), F.col("cur_completed_at").alias("current_at")]
    valid = usable_pairs(pairs).where(COMPLETE)
    cohort = E.noindex_cohort(valid.select(*scope, F.struct("run_id", "url_id").alias("run_id"), gained_noindex.alias("affected"), *times))
    noindex = cohort.select(
        "window_id", "template_id", "scenario_id", "run_id.url_id", "run_id.run_id", F.lit("NOINDEX_ADDED").alias("code"), "subject", F.lit("RECORD").alias("action"),
        "severity", "occurred_after", "detected_at", "affected_count", "valid_count", F.col("affected_count").alias("runs"),
    )
    seen = facts.where(F.expr(COMPLETE) & (F.col("kind") == "SLOT") & F.col("here"))
    none = F.lit(None).cast("bigint")
    gone = E.slot_cohort(seen.select(*scope, F.col("member").alias("slot"), "present", "previous_present", *times), timed=True).select(
        "window_id", "template_id", "scenario_id", none.alias("url_id"), none.alias("run_id"), F.lit("GPT_EXPECTED_SLOT_MISSING").alias("code"),
        F.col("slot").alias("subject"), "action", "severity", "occurred_after", "detected_at", "affected_count", "valid_count", F.col("affected_count").alias("runs"),
    )
    return noindex.unionByName(gone).select(
        F.lit(1).alias("section"), *[F.col(f"window_id.{c}").alias(c) for c in WINDOW], *[c for c in CANDIDATE[1:] if c not in WINDOW]
    )


def event_candidates(local: DataFrame, window: DataFrame) -> DataFrame:
    """Both lists; a pending one goes where the window it belongs to has emitted its code, whatever the action."""
    emitted = window.select(*WINDOW, "code").distinct().withColumn("_emitted", F.lit(True))
    kept = local.join(emitted, [*WINDOW, "code"], "left").where((F.col("action") != "PENDING") | F.col("_emitted").isNull())
    return kept.select(*CANDIDATE).unionByName(window.select(*CANDIDATE))


def event_episodes(candidates: DataFrame) -> DataFrame:
    """Episodes of all conditions: those of single pages carry a url_id, those of a template have none."""
    actions = candidates.where(F.col("action").isin(*CONDITION_ACTIONS)).select(
        *CONDITION[:-1], F.coalesce("url_id", F.lit(-1)).alias("url_id"), F.col("detected_at").alias("at"),
        F.coalesce("run_id", F.unix_seconds("scheduled_for")).alias("run_id"), "action", "severity", "affected_count", "valid_count", "runs",
    )
    # The machine reads its rows twice; written once, the candidates and all that leads to them are not worked out again.
    episodes = E.condition_lifecycle(written(actions, "chain-actions"), CONDITION, ["at", "run_id"], weight="runs")
    return episodes.withColumn("url_id", F.when(F.col("url_id") >= 0, F.col("url_id")))
