"""Incident localization, reference selection, hypotheses, evidence packs and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.catalogs import INCIDENT_STATUSES, OPEN_INCIDENT_STATUSES, RELATION_TYPES, SYMPTOM_FAMILIES
from tidemark.functions import times as Z
from tidemark.functions.shape import either
from tidemark.operators.digests import Section, document_digests
from tidemark.operators.lineage import scheduled_cohort
from tidemark.operators.ordered import asof_join, first_per_key, ordinal, running_sum, time_bucket, top_n, window_head
from tidemark.session import written

FAR = "9999-12-31 00:00:00"


def incident_gate(incidents: DataFrame) -> DataFrame:
    """Adds ``rejections``: every bound the incident breaks."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return incidents.withColumn(
        "rejections",
        F.array_compact(
            F.array(
                F.when((text("title") == "") | (F.length("title") > 300), "TITLE"),
                F.when(~F.col("symptom_family").isin(*SYMPTOM_FAMILIES), "FAMILY"),
                F.when(text("description") == "", "DESCRIPTION"),
                F.when(~F.col("status").isin(*INCIDENT_STATUSES), "STATUS"),
                F.when(F.col("ended") < F.col("onset"), "WINDOW"),
            )
        ),
    )


def segment_gate(segments: DataFrame) -> DataFrame:
    """Adds ``rejections`` for symptom segments: four required texts of at most 200 characters."""
    checks = [
        F.when((F.coalesce(F.trim(c), F.lit("")) == "") | (F.length(c) > 200), F.lit(c.upper()))
        for c in ("dimension", "operator", "value", "source")
    ]
    return segments.withColumn("rejections", F.array_compact(F.array(*checks)))


def localize(incidents: DataFrame, runs: DataFrame) -> DataFrame:
    """Last healthy run completed by the onset and first anomaly scheduled from it on, per incident.

    An unknown onset bounds neither side.
    """
    cohort = scheduled_cohort(runs)
    healthy = cohort.where(F.col("status") == "COMPLETE")
    anomalies = cohort.where(F.col("status") != "COMPLETE")
    back = asof_join(
        incidents, healthy, ["site"], "onset", "incident_id", "completed_at", "run_id",
        ["run_id", "completed_at", "scenario_id", "template_id"], "healthy",
    )
    return asof_join(
        back, anomalies, ["site"], "onset", "incident_id", "scheduled_for", "run_id", ["run_id", "scheduled_for"], "anomaly", forward=True
    )


def lkg_select(runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """Newest complete scheduled run per expectation, under equal collector version.

    Expectations: expectation_id, site, collector_version, and scenario_id, template_id that may
    be null.  Runs are first reduced to the newest per (site, version, scenario, template).
    """
    order = [F.col("scheduled_for").desc(), F.coalesce("completed_at", F.lit(FAR).cast("timestamp")).desc(), F.col("run_id").desc()]
    cells = ["site", "collector_version", "scenario_id", "template_id"]
    newest = first_per_key(scheduled_cohort(runs).where(F.col("status") == "COMPLETE"), cells, order).select(
        "site", "collector_version", F.col("scenario_id").alias("run_scenario"), F.col("template_id").alias("run_template"),
        "run_id", "scheduled_for", "completed_at",
    )
    fits = (F.col("scenario_id").isNull() | (F.col("scenario_id") == F.col("run_scenario"))) & (
        F.col("template_id").isNull() | (F.col("template_id") == F.col("run_template"))
    )
    return first_per_key(expectations.join(newest, ["site", "collector_version"]).where(fits), ["expectation_id"], order)


def lkg_freeze(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """References not frozen yet: one per scope, run and incident, where no incident equals no incident."""
    keys = ["scope_key", "run_id", "incident_id"]
    once = selected.dropDuplicates(keys)
    known = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return once.join(known, same, "left_anti")


def observation_gaps(
    sites: DataFrame, urls: DataFrame, scenarios: list[int], runs: DataFrame, start: Column, end: Column
) -> DataFrame:
    """Expected observations without a run: active URLs x scenarios x six-hour windows.

    Sites: site, monitoring_state, enabled_at, zone.  URLs: site, url_id, valid_from, valid_to.
    The grid is unrolled per URL, so it needs no join beyond the site dimension.
    """
    live = urls.join(sites.where(F.col("monitoring_state") == "ON"), "site")
    first = Z.local_floor(start, F.col("zone"), 6)
    steps = F.sequence(first, F.from_utc_timestamp(end, F.col("zone")), F.expr("INTERVAL '6' HOUR"))
    grid = (
        live.withColumn("_local", F.explode(steps))
        .withColumn("scheduled_for", F.to_utc_timestamp("_local", F.col("zone")))
        .withColumn("window_end", F.to_utc_timestamp(F.col("_local") + F.expr("INTERVAL '6' HOUR"), F.col("zone")))
        .where(
            (F.col("scheduled_for") > F.col("enabled_at"))
            & (F.col("scheduled_for") < end)
            & (F.col("valid_from") <= F.col("window_end"))
            & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("scheduled_for")))
        )
        .withColumn("scenario_id", F.explode(F.array(*[F.lit(s).cast("bigint") for s in scenarios])))
    )
    seen = runs.select("site", "url_id", "scenario_id", "scheduled_for")
    return grid.join(seen, ["site", "url_id", "scenario_id", "scheduled_for"], "left_anti").select(
        "site", "url_id", "scenario_id", "scheduled_for"
    )


def hypothesis_labels(
    families: DataFrame, events: DataFrame, relations: DataFrame, gaps: DataFrame, notes: DataFrame
) -> DataFrame:
    """Distinct (incident, family, bucket, label) rows plus one bare row per candidate family.

    Any relation other than SUPPORTS contradicts its target; a CONTRADICTS between two different
    families also supports its source.  Gaps and notes concern every candidate of the incident.
    """
    keys = ["incident_id", "family"]
    candidates = families.select(*keys).unionByName(events.select(*keys)).distinct()
    observed = events.select(
        *keys, F.when(F.col("supports"), "supporting").otherwise("contradicting").alias("bucket"),
        F.concat(F.lit("machine_observed:"), F.col("evidence_id").cast("string")).alias("label"),
    )
    label = F.concat(F.lit("typed_relation:"), "from_family", F.lit("->"), "to_family", F.lit(":"), "relation_type")
    ends = relations.join(candidates.select("incident_id", F.col("family").alias("to_family")), ["incident_id", "to_family"])
    direct = ends.select(
        "incident_id", F.col("to_family").alias("family"),
        F.when(F.col("relation_type") == "SUPPORTS", "supporting").otherwise("contradicting").alias("bucket"), label.alias("label"),
    )
    mirrored = (
        ends.where((F.col("relation_type") == "CONTRADICTS") & (F.col("from_family") != F.col("to_family")))
        .join(candidates.select("incident_id", F.col("family").alias("from_family")), ["incident_id", "from_family"])
        .select("incident_id", F.col("from_family").alias("family"), F.lit("supporting").alias("bucket"), label.alias("label"))
    )
    missing = gaps.select("incident_id", F.concat(F.lit("observation_gap:"), "description").alias("label")).distinct().join(
        candidates, "incident_id"
    ).select(*keys, F.lit("missing").alias("bucket"), "label")
    human = notes.select("incident_id", F.concat(F.lit("human_reported:"), F.col("note_id").cast("string")).alias("label")).distinct().join(
        candidates, "incident_id"
    ).select(*keys, F.lit("human_context").alias("bucket"), "label")
    evidence = observed.unionByName(direct).unionByName(mirrored).unionByName(missing).unionByName(human).distinct()
    bare = candidates.withColumn("bucket", F.lit("candidate")).withColumn("label", F.lit(""))
    return evidence.unionByName(bare)


def hypothesis_candidates(labels: DataFrame) -> DataFrame:
    """Counts per candidate and evidence bucket; the labels themselves stay rows."""
    count = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    return labels.groupBy("incident_id", "family").agg(*[count(b) for b in ("supporting", "contradicting", "missing", "human_context")])


SUPPORT_WEIGHT = 2


def rank_hypotheses(candidates: DataFrame) -> DataFrame:
    """Score, rank, status and confidence; the families of an incident are few by vocabulary."""
    scored = candidates.withColumn("hypothesis_key", F.concat("family", F.lit(":degradation"))).withColumn(
        "score", F.col("supporting") * SUPPORT_WEIGHT - F.col("contradicting")
    )
    order = Window.partitionBy("incident_id").orderBy(F.col("score").desc(), F.col("hypothesis_key"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    s, c = F.col("supporting"), F.col("contradicting")
    status = either(
        ((s == 0) & (c == 0), "UNRESOLVED"), (c > s, "WEAKENED"),
        ((F.col("rank") == 1) & (F.col("score") > 0) & (c == 0), "LEADING"), otherwise="CONTENDER",
    )
    confidence = either((F.col("score") >= 4, "HIGH"), (F.col("score") >= 2, "MEDIUM"), otherwise="LOW")
    return ranked.withColumn("status", status).withColumn("confidence", confidence)


def replace_ranked(ranked: DataFrame, existing: DataFrame) -> DataFrame:
    """What replacing the stored set of each ranked incident does: UPSERT, and DELETE of stale keys.

    One union and one grouping; the keys of an incident are few by vocabulary.
    """
    keys = ["incident_id", "hypothesis_key"]
    both = ranked.select(*keys, "rank").unionByName(existing.select(*keys, F.lit(None).cast("int").alias("rank")))
    merged = both.groupBy(*keys).agg(F.max("rank").alias("rank"))
    touched = merged.withColumn("_top", F.max("rank").over(Window.partitionBy("incident_id"))).where(F.col("_top").isNotNull())
    return touched.select(*keys, "rank", F.when(F.col("rank").isNull(), "DELETE").otherwise("UPSERT").alias("action"))


def evidence_by_hypothesis(hypotheses: DataFrame, evidence: DataFrame, bucket_width: int = 1_000_000) -> DataFrame:
    """Evidence rows numbered in creation order within each hypothesis; none leaves one bare row."""
    keys = ["incident_id", "family"]
    numbered = ordinal(evidence, keys, ["seq"], "position", F.floor(F.col("seq") / bucket_width))
    return hypotheses.join(numbered, keys, "left")


def relations_of(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in the id set: two semi joins instead of an OR join."""
    out = relations.join(ids.withColumnRenamed("event_id", "from_id"), "from_id", "left_semi")
    into = relations.join(ids.withColumnRenamed("event_id", "to_id"), "to_id", "left_semi")
    return out.unionByName(into).distinct()


def append_relations(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid new edges: two different ends, a known type, once per (from, to, type, engine)."""
    keys = ["from_id", "to_id", "relation_type", "engine_version"]
    valid = edges.where((F.col("from_id") != F.col("to_id")) & F.col("relation_type").isin(*RELATION_TYPES))
    return first_per_key(valid, keys, [F.col("edge_id")]).join(existing.select(*keys), keys, "left_anti")


# --- fixed values: evidence pack bounds -------------------------------------------------------
PACK_RUNS, PACK_SNAPSHOTS, PACK_EVENTS, PACK_BYTES = 200, 100, 200, 262_144
PACK_VERSION = "pack-v1"
# Even an empty entry takes its quotes and a comma, so more than PACK_BYTES / PACK_ENTRY of them
# exceed the size of a pack whatever they say; reading one more than that is enough to know it.
PACK_ENTRY = 3


def _entry_bytes() -> Column:
    """What an entry takes in a document at least: its quotes and a comma, or the word null and a comma."""
    return F.coalesce(F.octet_length("entry") + PACK_ENTRY, F.lit(5))


def _oversized(spans: DataFrame, facts: DataFrame, free: int) -> DataFrame:
    """Incidents whose uncut sections alone exceed a pack, by running byte sums looked up at both window ends; nothing is unrolled."""
    bytes_of = F.sum(_entry_bytes()).cast("bigint").alias("_bytes")
    moments = facts.where((F.col("n") == free) & F.col("at").isNotNull()).groupBy("site", "section", "at").agg(bytes_of).withColumn("_id", F.lit(0))
    upto = running_sum(moments, ["site", "section"], ["at"], F.col("_bytes"), "_upto", time_bucket("at"))
    asked = spans.where((F.col("n") == free) & F.col("since").isNotNull() & F.col("window_end").isNotNull()).distinct()
    keys = ["site", "section"]
    begun = asof_join(asked, upto, keys, "since", "span_id", "at", "_id", ["_upto"], "_before", strict=True)
    ended = asof_join(begun, upto, keys, "window_end", "span_id", "at", "_id", ["_upto"], "_after")
    held = F.coalesce(F.col("_after._upto"), F.lit(0)) - F.coalesce(F.col("_before._upto"), F.lit(0))
    # The least of what rows of one id say, so that only what no row of it can hold is told apart here.
    each = ended.groupBy("incident_id", "section").agg(F.min(held).alias("_held"))
    return each.groupBy("incident_id").agg(F.sum("_held").alias("_held")).where(F.col("_held") > PACK_BYTES).select("incident_id")


def _hashed_packs(incidents: DataFrame, facts: DataFrame, sections: list[Section]) -> DataFrame:
    """Packs that are not built in one piece: size and hash of the whole document, the content null."""
    head = F.to_json(F.struct(F.lit(PACK_VERSION).alias("engine_version"), F.col("incident_text").alias("incident")))
    documents = incidents.withColumn("head", head).select(
        F.col("incident_id").alias("doc"), F.col("site").alias("scope"), F.expr("left(head, length(head) - 1)").alias("head"),
        F.col("window_start").alias("since"), F.col("window_end").alias("until"),
    )
    text = F.to_json(F.array("entry"))
    rows = facts.withColumn("_json", text).select(F.col("site").alias("scope"), "section", "at", "id", F.expr("substr(_json, 2, length(_json) - 2)").alias("entry"))
    return document_digests(documents, rows, sections).select(
        F.col("doc").alias("incident_id"), F.lit(None).cast("string").alias("content"), F.col("bytes").alias("content_bytes"), F.col("hash").alias("content_hash")
    )


def evidence_pack(
    incidents: DataFrame, runs: DataFrame, snapshots: DataFrame, events: DataFrame, relations: DataFrame, notes: DataFrame
) -> DataFrame:
    """One deterministic JSON document per incident window, with its size and hash.

    Incidents: incident_id, site, window_start, window_end, plus text.  Each section holds
    (site, at, id, entry); machine sections are cut at their bounds, notes count up to the end.  A document above
    PACK_BYTES is not built as one text (no store takes it): its content is null, its size and hash are those of the whole.
    """
    free = PACK_BYTES // PACK_ENTRY + 1
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    sections = (
        ("scheduled_checkpoints", runs, PACK_RUNS, F.col("window_start")),
        ("public_config_states", snapshots, PACK_SNAPSHOTS, F.col("window_start")),
        ("events", events, PACK_EVENTS, F.col("window_start")),
        ("relations", relations, free, F.col("window_start")),
        ("human_reported_notes", notes, free, epoch),
    )
    # All sections travel as one fact table, so they are numbered and looked up in one pass.
    facts = None
    for name, rows, n, _ in sections:
        part = rows.select("site", "at", "id", "entry", F.lit(name).alias("section"), F.lit(n).cast("bigint").alias("n"))
        facts = part if facts is None else facts.unionByName(part)
    asks = F.array(*[F.struct(F.lit(name).alias("section"), F.lit(n).cast("bigint").alias("n"), since.alias("since")) for name, _, n, since in sections])
    spans = incidents.select("incident_id", "site", "window_end", F.explode(asks).alias("_ask")).select(
        F.concat_ws(":", F.col("incident_id").cast("string"), "_ask.section").alias("span_id"), "incident_id", "site", "window_end", "_ask.*"
    )
    # Read in several places; written once, its lineage is not run again in each.
    early = written(_oversized(spans, facts, free), "oversized-packs")
    spans = spans.join(early, "incident_id", "left_anti")
    heads = window_head(spans, facts, ["site", "section"], "span_id", "since", "window_end", "at", "id", "n")
    rows = heads.join(spans.select("span_id", "incident_id"), "span_id").select("incident_id", "section", "position", "entry")
    sizes = written(rows.groupBy("incident_id").agg(F.sum(_entry_bytes()).alias("_bytes")), "pack-sizes")
    small = sizes.where(F.col("_bytes") <= PACK_BYTES).select("incident_id")
    # Only incidents whose entries fit a pack are gathered; each is then at most PACK_BYTES big.
    gathered = rows.join(small, "incident_id").groupBy("incident_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("position", "entry")))), lambda s: s["entry"]
            ).alias(name)
            for name, *_ in sections
        ]
    )
    empty = F.array().cast("array<string>")
    document = F.to_json(
        F.struct(
            F.lit(PACK_VERSION).alias("engine_version"), F.col("incident_text").alias("incident"),
            *[F.coalesce(name, empty).alias(name) for name, *_ in sections],
        )
    )
    large = sizes.where(F.col("_bytes") > PACK_BYTES).select("incident_id").unionByName(early)
    built = incidents.join(large, "incident_id", "left_anti").join(gathered, "incident_id", "left").select("incident_id", document.alias("content"))
    built = built.withColumn("content_bytes", F.octet_length("content").cast("bigint")).withColumn("content_hash", F.sha2("content", 256))
    bounds = [Section(name, None if n == free else n, since is epoch) for name, _, n, since in sections]
    return built.unionByName(_hashed_packs(incidents.join(large, "incident_id", "left_semi"), facts, bounds))


def persist_pack(packs: DataFrame, existing: DataFrame) -> DataFrame:
    """Packs to add: within the byte bound and not stored yet under the same content."""
    keys = ["incident_id", "content_hash"]
    return packs.where(F.col("content_bytes") <= PACK_BYTES).dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def timeline(events: DataFrame, notes: DataFrame, n: int) -> DataFrame:
    """Per site up to ``n`` newest events, then up to ``n`` newest notes; the two are not merged.

    Both: site, at, id, detail; events also precision and occurred_before.
    """
    newest = [F.col("at").desc(), F.col("id").desc()]
    a = top_n(events, ["site"], newest, n, "position").select(
        "site", F.lit(0).alias("section"), "position", "id", "at", "detail",
        F.when(F.col("precision") == "EXACT", F.col("occurred_before")).alias("occurred_at"),
    )
    b = top_n(notes, ["site"], newest, n, "position").select("site", F.lit(1).alias("section"), "position", "id", "at", "detail")
    return a.unionByName(b, allowMissingColumns=True)


def recent_activity(events: DataFrame, notes: DataFrame, k: int = 5) -> DataFrame:
    """Newest ``k`` entries per site across events and notes."""
    both = events.select("site", "at", "id", "detail", F.lit("machine_observed").alias("provenance")).unionByName(
        notes.select("site", "at", "id", "detail", F.lit("human_reported").alias("provenance"))
    )
    return top_n(both, ["site"], [F.col("at").desc(), F.col("provenance").desc(), F.col("id").desc()], k, "position")


def incident_list(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.col("opened_at").desc(), F.col("incident_id").desc())


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incident_list(incidents.where(F.col("status").isin(*OPEN_INCIDENT_STATUSES)))


def recent_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    return top_n(runs, ["site"], [F.col("completed_at").desc(), F.col("run_id").desc()], k, "position")


def corpus_patterns(records: DataFrame, high_score: float) -> tuple[DataFrame, DataFrame]:
    """(counts, examples) per domain mapping.

    Records: incident_id, domain_mappings, evidence_score, root_cause_status.  The score from
    which evidence counts as high is a parameter.
    """
    mapped = records.withColumn("domain_mapping", F.explode(F.array_distinct("domain_mappings")))
    counts = mapped.groupBy("domain_mapping").agg(
        F.count("*").alias("incident_count"),
        F.count_if(F.col("evidence_score") >= high_score).alias("high_evidence_count"),
        F.count_if(F.col("root_cause_status") == "confirmed").alias("confirmed_root_cause_count"),
    )
    return counts, top_n(mapped, ["domain_mapping"], [F.col("incident_id")], 10, "position").select(
        "domain_mapping", "position", "incident_id"
    )


def eval_passrate(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pass per case: leading family as expected or unspecified, and weakened families equal.

    Expected: incident_id, leading_family (nullable), weakened (array).
    """
    actual = ranked.groupBy("incident_id").agg(
        F.max(F.when(F.col("status") == "LEADING", F.col("family"))).alias("actual_leading"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "WEAKENED", F.col("family")))).alias("actual_weakened"),
    )
    empty = F.array().cast("array<string>")
    leading = F.col("leading_family").isNull() | F.col("leading_family").eqNullSafe(F.col("actual_leading"))
    weakened = F.array_sort(F.coalesce("weakened", empty)) == F.coalesce("actual_weakened", empty)
    return expected.join(actual, "incident_id", "left").withColumn("passed", leading & weakened)


def eval_coverage(cases: DataFrame) -> DataFrame:
    """Case counts by family, type, difficulty and outcome with all leading subtotals."""
    keys = ["family", "eval_type", "difficulty", "outcome"]
    return cases.rollup(*keys).agg(F.count("*").alias("cases"), F.grouping_id().cast("bigint").alias("level"))
