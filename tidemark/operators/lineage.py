"""Comparable predecessors and change detection between observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalogs import FINAL_RUN_STATUSES, VALID_RUN_STATUSES
from tidemark.functions.shape import either
from tidemark.operators.intervals import instant_join
from tidemark.operators.ordered import asof_join, carry_previous, DAY, latest_before, time_bucket, top_n
from tidemark.session import written

COMPONENTS = ("scripts", "network", "javascript_errors", "seo")
FAR = "9999-12-31 00:00:00"


def scheduled_cohort(runs: DataFrame) -> DataFrame:
    """Only routine scheduled runs enter lineage, cohorts and reference selection."""
    return runs.where(F.col("observation_kind") == "SCHEDULED")


def previous_comparable(runs: DataFrame, bucket_s: int = 30 * DAY) -> DataFrame:
    """Latest earlier final scheduled run of the scenario: same URL first, else same template.

    Runs: run_id, site, url_id, template_id, scenario_id, scheduled_for, completed_at, status,
    observation_kind.  The template branch is only read where no earlier run of the URL exists,
    so whatever it finds is already another URL.
    """
    final = scheduled_cohort(runs).where(F.col("status").isin(*FINAL_RUN_STATUSES))
    payload = F.struct(
        F.col("scheduled_for").alias("at"),
        F.coalesce("completed_at", F.lit(FAR).cast("timestamp")).alias("done"),
        F.col("run_id").alias("id"),
    )
    exact = latest_before(final, ["site", "scenario_id", "url_id"], "scheduled_for", {"_exact": payload}, bucket_s)
    both = latest_before(exact, ["site", "scenario_id", "template_id"], "scheduled_for", {"_rotated": payload}, bucket_s)
    return both.withColumn("previous_id", F.coalesce("_exact.id", "_rotated.id")).withColumn(
        "selection_scope",
        either((F.col("_exact").isNotNull(), "EXACT_MONITORED_URL"), (F.col("_rotated").isNotNull(), "SAME_TEMPLATE_URL_ROTATION")),
    ).drop("_exact", "_rotated")


def lineage_two_back(pairs: DataFrame) -> DataFrame:
    """Adds prior_id: the exact predecessor of an exact predecessor."""
    earlier = pairs.where(F.col("selection_scope") == "EXACT_MONITORED_URL").select(
        F.col("run_id").alias("previous_id"), F.col("previous_id").alias("prior_id")
    )
    linked = pairs.join(earlier, "previous_id", "left")
    return linked.withColumn(
        "prior_id", F.when(F.col("selection_scope") == "EXACT_MONITORED_URL", F.col("prior_id"))
    )


def with_states(pairs: DataFrame, states: DataFrame, columns: list[str]) -> DataFrame:
    """Attach current and previous columns of each pair as cur_* and prev_*."""
    cur = states.select("run_id", *[F.col(c).alias(f"cur_{c}") for c in columns])
    prev = states.select(F.col("run_id").alias("previous_id"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return pairs.join(cur, "run_id").join(prev, "previous_id", "left")


def invalid_reason() -> Column:
    """First reason, in this order, that makes a pair unusable."""
    valid = F.col("prev_status").isin(*VALID_RUN_STATUSES) & F.col("cur_status").isin(*VALID_RUN_STATUSES)
    return either(
        (~F.col("selection_scope").eqNullSafe(F.lit("EXACT_MONITORED_URL")), "NON_EXACT_URL_LINEAGE"),
        (~F.coalesce(valid, F.lit(False)), "INVALID_CHECKPOINT_STATUS"),
        (F.col("cur_completed_at") <= F.col("prev_completed_at"), "UNORDERED_OBSERVATION_TIME"),
    )


def component_skips(components=COMPONENTS) -> Column:
    """MISSING_ and INCOMPATIBLE_ codes in component order; a null version is a missing state."""
    codes = []
    for name in components:
        before, after = F.col(f"prev_{name}_version"), F.col(f"cur_{name}_version")
        codes.append(
            either(
                (before.isNull() | after.isNull(), F.lit(f"MISSING_{name.upper()}_STATE")),
                (before != after, F.lit(f"INCOMPATIBLE_{name.upper()}_NORMALIZER")),
            )
        )
    return F.array_compact(F.array(*codes))


def pair_validity(pairs: DataFrame) -> DataFrame:
    """Adds skip_reasons; an empty array marks a pair that may be compared."""
    return pairs.withColumn("_reason", invalid_reason()).withColumn(
        "skip_reasons", F.when(F.col("_reason").isNotNull(), F.array("_reason")).otherwise(component_skips())
    ).drop("_reason")


def previous_snapshot(snapshots: DataFrame, keys: list[str], bucket_s: int = DAY) -> DataFrame:
    """Adds previous_* of the snapshot just before (at, snapshot_id) of the same key."""
    carried = [c for c in snapshots.columns if c not in keys]
    packed = snapshots.withColumn("_me", F.struct(*carried))
    found = carry_previous(packed, keys, ["at", "snapshot_id"], "_me", "_prev", time_bucket("at", bucket_s))
    return found.select(
        *snapshots.columns,
        F.col("_prev.snapshot_id").alias("previous_id"),
        *[F.col(f"_prev.{c}").alias(f"previous_{c}") for c in carried if c != "snapshot_id"],
    )


def membership(pairs: DataFrame, members: DataFrame, sides: dict[str, str], identity: str = "member") -> DataFrame:
    """Which side of each pair holds each member: one join and one aggregation, no arrays.

    ``sides`` maps a flag name to the pair column holding the owner snapshot.
    """
    roles = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("owner")) for n, c in sides.items()])
    owners = pairs.select("snapshot_id", F.explode(roles).alias("r")).select("snapshot_id", "r.side", "r.owner")
    held = owners.where(F.col("owner").isNotNull()).join(
        members.select(F.col("snapshot_id").alias("owner"), identity), "owner"
    )
    return held.groupBy("snapshot_id", identity).agg(
        *[F.bool_or(F.col("side") == n).alias(f"in_{n}") for n in sides]
    )


def presence_changes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """PRESENCE_ADDED and PRESENCE_REMOVED per pair.

    Where either side was cut off, absence proves nothing: all removals of the pair become one
    TRUNCATED_DEPENDENCY_ABSENCE row.
    """
    pairs = pairs.where(F.col("previous_id").isNotNull())
    flags = membership(pairs, members, {"cur": "snapshot_id", "prev": "previous_id"})
    cut = pairs.select("snapshot_id", (F.col("truncated") | F.col("previous_truncated")).alias("cut"))
    changed = flags.where(F.col("in_cur") != F.col("in_prev")).join(cut, "snapshot_id")
    rows = changed.where(F.col("in_cur") | ~F.col("cut")).select(
        "snapshot_id", F.when(F.col("in_cur"), "PRESENCE_ADDED").otherwise("PRESENCE_REMOVED").alias("change"), "member"
    )
    skipped = changed.where(F.col("in_prev") & F.col("cut")).select("snapshot_id").distinct()
    return rows.unionByName(
        skipped.select("snapshot_id", F.lit("TRUNCATED_DEPENDENCY_ABSENCE").alias("change"), F.lit(None).cast("bigint").alias("member"))
    )


def record_diff(pairs: DataFrame, records: DataFrame, identity: str = "record_hash") -> DataFrame:
    """Records added to and removed from consecutive snapshots."""
    flags = membership(
        pairs.where(F.col("previous_id").isNotNull()), records, {"cur": "snapshot_id", "prev": "previous_id"}, identity
    )
    return flags.where(F.col("in_cur") != F.col("in_prev")).select(
        "snapshot_id", identity, F.when(F.col("in_cur"), "ADDED").otherwise("REMOVED").alias("change")
    )


def error_transitions(triples: DataFrame, errors: DataFrame) -> DataFrame:
    """Condition actions of error fingerprints over current, previous and prior snapshots.

    Triples: snapshot_id, previous_id, prior_id, prior_comparable.
    """
    triples = triples.where(F.col("previous_id").isNotNull())
    flags = membership(triples, errors, {"cur": "snapshot_id", "prev": "previous_id", "prior": "prior_id"})
    judged = flags.join(triples.select("snapshot_id", "prior_comparable"), "snapshot_id")
    action = either(
        (F.col("in_cur") & ~F.col("in_prev"), "PENDING"),
        (F.col("in_cur") & F.col("prior_comparable") & ~F.col("in_prior"), "UPSERT"),
        (F.col("in_cur"), "SUPPORT"),
        (F.col("in_prev"), "RESOLVE"),
    )
    return judged.withColumn("action", action).where(F.col("action").isNotNull()).select("snapshot_id", "member", "action")


def status_changes(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Dependencies in both snapshots whose failure, 4xx or 5xx counts differ."""
    fields = ["failures", "status_4xx", "status_5xx"]
    cur = counts.select("snapshot_id", "member", *[F.col(f).alias(f"after_{f}") for f in fields])
    prev = counts.select(F.col("snapshot_id").alias("previous_id"), "member", *[F.col(f).alias(f"before_{f}") for f in fields])
    both = pairs.where(F.col("previous_id").isNotNull()).select("snapshot_id", "previous_id").join(cur, "snapshot_id").join(
        prev, ["previous_id", "member"]
    )
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"before_{f}") != F.col(f"after_{f}"))
    return both.where(differs).drop("previous_id")


COMPARED = ("dom", "scripts", "network", "javascript_errors")


def comparability() -> Column:
    """Reason a snapshot cannot be compared with its predecessor, or null."""
    branches = [
        (F.col("previous_id").isNull(), F.lit("NO_PREDECESSOR")),
        (~F.coalesce("previous_has_state", F.lit(False)), F.lit("PREDECESSOR_HAS_NO_NORMALIZED_STATE")),
    ]
    for name in COMPARED:
        after, before = F.col(f"{name}_version"), F.col(f"previous_{name}_version")
        branches.append((after.isNull() | before.isNull(), F.lit(f"MISSING_{name.upper()}_STATE")))
        branches.append((after != before, F.lit(f"INCOMPATIBLE_{name.upper()}_NORMALIZER")))
    return either(*branches)


def tagged_members(sets: dict[str, DataFrame]) -> DataFrame:
    """The member tables of all components as one: (snapshot_id, member) with the component before a bar."""
    whole = None
    for component, members in sets.items():
        one = members.select("snapshot_id", F.concat(F.lit(f"{component}|"), F.col("member").cast("string")).alias("member"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def state_compare(pairs: DataFrame, sets: dict[str, DataFrame], counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, changes): NOT_COMPARABLE with a reason, or the list of differences.

    ``sets`` maps SCRIPT, NETWORK_DEPENDENCY and JAVASCRIPT_ERROR to (snapshot_id, member) rows.
    """
    judged = pairs.withColumn("reason", comparability())
    usable = judged.where(F.col("reason").isNull())
    dom = usable.where(~F.col("dom_hash").eqNullSafe(F.col("previous_dom_hash"))).select(
        "snapshot_id", F.lit("DOM").alias("component"), F.lit("STRUCTURAL_CHANGE").alias("kind"), F.lit("").alias("stable_key")
    )
    flags = membership(usable, tagged_members(sets), {"cur": "snapshot_id", "prev": "previous_id"})
    changes = dom.unionByName(
        flags.where(F.col("in_cur") != F.col("in_prev")).select(
            "snapshot_id", F.substring_index("member", "|", 1).alias("component"),
            F.when(F.col("in_cur"), "PRESENCE_ADDED").otherwise("PRESENCE_REMOVED").alias("kind"),
            F.expr("substr(member, locate('|', member) + 1)").alias("stable_key"),
        )
    )
    status = status_changes(usable, counts).select(
        "snapshot_id", F.lit("NETWORK_DEPENDENCY").alias("component"), F.lit("STATUS_CHANGE").alias("kind"),
        F.col("member").cast("string").alias("stable_key"),
    )
    verdicts = judged.select(
        "snapshot_id", F.when(F.col("reason").isNull(), "COMPARABLE").otherwise("NOT_COMPARABLE").alias("status"), "reason"
    )
    return verdicts, changes.unionByName(status)


def bounded_changes(changes: DataFrame, n: int = 200) -> DataFrame:
    """First ``n`` changes per snapshot with the full count and whether any were left out."""
    # Counted and ranked from one copy; otherwise each side compares all snapshots again.
    changes = written(changes, "changes")
    totals = changes.groupBy("snapshot_id").agg(F.count("*").alias("change_count"))
    order = [F.col("component"), F.col("kind"), F.col("stable_key")]
    return top_n(changes, ["snapshot_id"], order, n, "position").join(totals, "snapshot_id").withColumn(
        "truncated", F.col("change_count") > n
    )


def value_changed(before: Column, after: Column) -> Column:
    """Differs, and not absent on both sides."""
    return ~before.eqNullSafe(after)


def member_changes(snapshots: DataFrame, sets: dict[str, DataFrame], key: str, wanted: DataFrame | None = None) -> DataFrame:
    """Change events of all components in one pass: (key, at, snapshot_id, component, stable_key, step), step +1 or -1.

    ``wanted`` names the snapshots (by snapshot_id) whose changes are asked for; all of them without it.
    """
    pairs = previous_snapshot(snapshots.select("snapshot_id", key, "at"), [key])
    if wanted is not None:
        ids = wanted.select("snapshot_id").distinct()
        pairs, snapshots = (df.join(ids, "snapshot_id", "left_semi") for df in (pairs, snapshots))
    flags = membership(pairs, tagged_members(sets), {"cur": "snapshot_id", "prev": "previous_id"})
    step = F.when(F.col("in_cur"), 1).otherwise(-1)
    changed = flags.where(F.col("in_cur") != F.coalesce("in_prev", F.lit(False))).withColumn("step", step)
    return changed.join(snapshots.select("snapshot_id", key, "at"), "snapshot_id").select(
        key, "at", "snapshot_id", F.substring_index("member", "|", 1).alias("component"),
        F.expr("substr(member, locate('|', member) + 1)").alias("stable_key"), "step",
    )


def since_lkg(incidents: DataFrame, snapshots: DataFrame, key: str, healthy: Column) -> DataFrame:
    """Snapshots after the last healthy one before an onset and up to the onset: (key, at, snapshot_id, incident_id, lkg_id, ...)."""
    good = snapshots.where(healthy).select(key, "at", "snapshot_id")
    framed = asof_join(incidents, good, [key], "onset", "incident_id", "at", "snapshot_id", ["at", "snapshot_id"], "lkg")
    windows = framed.where(F.col("lkg").isNotNull() & F.col("onset").isNotNull()).select(
        "incident_id", key, "onset", F.col("lkg.at").alias("lkg_at"), F.col("lkg.snapshot_id").alias("lkg_id")
    )
    # Changes share the instants of their snapshots, which are far fewer: these meet the windows, and only what lies inside one meets its changes.
    moments = instant_join(snapshots.select(key, "at", "snapshot_id").distinct(), windows, [key], "at", ("lkg_at", "onset"))
    return moments.where((F.col("at") > F.col("lkg_at")) | (F.col("snapshot_id") > F.col("lkg_id")))


def changed_since_lkg(
    incidents: DataFrame, snapshots: DataFrame, changes: DataFrame, key: str, healthy: Column, moments: DataFrame | None = None
) -> DataFrame:
    """What differs between the last healthy snapshot before an onset and the state at the onset.

    Incidents: incident_id, key, onset.  Changes: those of the snapshots, or at least of ``moments``, which is ``since_lkg`` where a caller
    has it.  Additions and removals of one member cancel as +1 and -1, a sum that needs no order and is combined before the shuffle;
    what remains is the net change.  An incident without a healthy snapshot before it has nothing to be compared with and no rows.
    """
    moments = since_lkg(incidents, snapshots, key, healthy) if moments is None else moments
    inside = changes.join(moments, [key, "at", "snapshot_id"])
    net = inside.groupBy("incident_id", "lkg_id", "component", "stable_key").agg(
        F.sum("step").alias("net"), F.count("*").alias("events"), F.max("at").alias("last_changed_at")
    )
    return net.where("net <> 0").select(
        "incident_id", "lkg_id", "component", "stable_key", F.when(F.col("net") > 0, "ADDED").otherwise("REMOVED").alias("change"), "events", "last_changed_at"
    )
