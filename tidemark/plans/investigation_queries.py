"""Incidents, reference runs, hypotheses, packs, timelines, corpus and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shape import big, r6, ts_text
from tidemark.operators import evaluation as V
from tidemark.operators import investigate as I
from tidemark.plans.lake import frame
from tidemark.plans.registry import query
from tidemark.session import written

C = F.col


def _ts(text):
    return F.lit(text).cast("timestamp")


@query("incident_gate", """SELECT B(incident_id) AS incident_id, concat_ws(',', CASE WHEN trim(title) = '' THEN 'TITLE' END, CASE WHEN symptom_family = 'UNKNOWN_FAMILY' THEN 'FAMILY' END,
    CASE WHEN description = '' THEN 'DESCRIPTION' END, CASE WHEN status = 'ARCHIVED' THEN 'STATUS' END, CASE WHEN ended < onset THEN 'WINDOW' END) AS rejections FROM {incidents}""")
def incident_gate(t):
    return I.incident_gate(t.incidents).select("incident_id", F.array_join("rejections", ",").alias("rejections"))


@query("segment_gate", """SELECT B(conv_id) AS conv_id, B(turn) AS turn, concat_ws(',', CASE WHEN length(text) > 200 OR trim(text) = '' THEN 'VALUE' END, CASE WHEN turn % 3 = 2 THEN 'SOURCE' END) AS rejections FROM conversations""")
def segment_gate(t):
    segments = t.conversations.select(
        "conv_id", "turn", C("role").alias("dimension"), F.lit("EQUALS").alias("operator"), C("text").alias("value"),
        F.when(C("turn") % 3 == 2, " ").otherwise("operator").alias("source"),
    )
    return I.segment_gate(segments).select("conv_id", "turn", F.array_join("rejections", ",").alias("rejections"))


SQL_LOCAL = """local AS (SELECT i.incident_id, i.site, i.onset,
    (SELECT max({'t': completed_at, 'r': run_id, 's': scenario_id, 'p': template_id}) FROM {runs} r WHERE r.site = i.site AND observation_kind = 'SCHEDULED' AND status = 'COMPLETE' AND (i.onset IS NULL OR completed_at <= i.onset)) AS h,
    (SELECT min({'t': scheduled_for, 'r': run_id}) FROM {runs} r WHERE r.site = i.site AND observation_kind = 'SCHEDULED' AND status <> 'COMPLETE' AND (i.onset IS NULL OR scheduled_for >= i.onset)) AS a
    FROM {incidents} i)"""


def localized(t):
    return I.localize(t.incidents, t.runs)


@query("localize", "WITH " + SQL_LOCAL + " SELECT B(incident_id) AS incident_id, B(h.r) AS last_healthy_run, TS(h.t) AS last_healthy_at, B(a.r) AS first_anomaly_run, TS(a.t) AS first_anomaly_at FROM local")
def localize(t):
    return localized(t).select(
        "incident_id", C("healthy.run_id").alias("last_healthy_run"), ts_text("healthy.completed_at").alias("last_healthy_at"),
        C("anomaly.run_id").alias("first_anomaly_run"), ts_text("anomaly.scheduled_for").alias("first_anomaly_at"),
    )


SQL_FROZEN = SQL_LOCAL + """, frozen AS (SELECT concat(site, ':', h.s) AS scope_key, h.r AS run_id, CASE WHEN incident_id % 4 <> 0 THEN incident_id END AS incident_id FROM local WHERE h IS NOT NULL)"""


@query("lkg_freeze", "WITH " + SQL_FROZEN + """, known AS (SELECT * FROM frozen WHERE run_id % 3 = 0)
    SELECT DISTINCT scope_key, B(run_id) AS run_id, B(incident_id) AS incident_id FROM frozen WHERE run_id % 3 <> 0""")
def lkg_freeze(t):
    chosen = localized(t).where(C("healthy").isNotNull()).select(
        F.concat_ws(":", C("site").cast("string"), C("healthy.scenario_id").cast("string")).alias("scope_key"), C("healthy.run_id").alias("run_id"),
        F.when(C("incident_id") % 4 != 0, C("incident_id")).alias("incident_id"),
    )
    return I.lkg_freeze(chosen, chosen.where(C("run_id") % 3 == 0))


@query("lkg_select", """SELECT B(e.id) AS expectation_id, B(r.run_id) AS run_id FROM (SELECT c_custkey AS id, c_custkey % 5 AS site, CASE WHEN c_custkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS v,
        CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 END AS sc, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 10 END AS tp FROM customer) e,
    LATERAL (SELECT run_id FROM {runs} r WHERE r.site = e.site AND r.collector_version = e.v AND observation_kind = 'SCHEDULED' AND status = 'COMPLETE' AND (e.sc IS NULL OR e.sc = r.scenario_id)
        AND (e.tp IS NULL OR e.tp = r.template_id) ORDER BY scheduled_for DESC, completed_at DESC, run_id DESC LIMIT 1) r""")
def lkg_select(t):
    k = C("c_custkey")
    wanted = t.customer.select(
        k.alias("expectation_id"), (k % 5).alias("site"), F.when(k % 2 == 0, "v1").otherwise("v2").alias("collector_version"),
        F.when(k % 3 != 0, k % 2).alias("scenario_id"), F.when(k % 7 == 0, k % 10).alias("template_id"),
    )
    return I.lkg_select(t.runs, wanted).select("expectation_id", "run_id")


@query("observation_gaps", """WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 18:00:00', INTERVAL '6' HOUR)) AS scheduled_for)
    SELECT B(u.site) AS site, B(u.url_id) AS url_id, B(sc.s) AS scenario_id, TS(w.scheduled_for) AS scheduled_for FROM {urls} u JOIN {sites} s ON s.site = u.site AND s.monitoring_state = 'ON', w, (VALUES (0), (1)) AS sc(s)
    WHERE w.scheduled_for > s.enabled_at AND u.valid_from <= w.scheduled_for + INTERVAL '6' HOUR AND (u.valid_to IS NULL OR u.valid_to > w.scheduled_for)
      AND NOT EXISTS (SELECT 1 FROM {runs} r WHERE r.site = u.site AND r.url_id = u.url_id AND r.scenario_id = sc.s AND r.scheduled_for = w.scheduled_for)""")
def observation_gaps(t):
    gaps = I.observation_gaps(t.sites, t.urls, [0, 1], t.runs, _ts("2024-01-01 00:00:00"), _ts("2024-01-31 00:00:00"))
    return gaps.select(big("site").alias("site"), "url_id", "scenario_id", ts_text("scheduled_for").alias("scheduled_for"))


SQL_LABELS = """cand AS (SELECT incident_id, family FROM {hyp_families} UNION SELECT incident_id, family FROM {hyp_events}),
    ends AS (SELECT r.*, 'typed_relation:' || from_family || '->' || to_family || ':' || relation_type AS label FROM {hyp_relations} r JOIN cand c ON c.incident_id = r.incident_id AND c.family = r.to_family),
    lab AS (SELECT incident_id, family, CASE WHEN supports THEN 's' ELSE 'c' END AS b, 'machine_observed:' || evidence_id AS label FROM {hyp_events}
      UNION SELECT incident_id, to_family, CASE WHEN relation_type = 'SUPPORTS' THEN 's' ELSE 'c' END, label FROM ends
      UNION SELECT e.incident_id, e.from_family, 's', label FROM ends e JOIN cand c ON c.incident_id = e.incident_id AND c.family = e.from_family WHERE relation_type = 'CONTRADICTS' AND from_family <> to_family
      UNION SELECT c.incident_id, c.family, 'm', description FROM {hyp_gaps} g JOIN cand c USING (incident_id)
      UNION SELECT c.incident_id, c.family, 'h', note_id::VARCHAR FROM {hyp_notes} n JOIN cand c USING (incident_id)),
    cnt AS (SELECT incident_id, family, B(count(*) FILTER (b = 's')) AS supporting, B(count(*) FILTER (b = 'c')) AS contradicting, B(count(*) FILTER (b = 'm')) AS missing, B(count(*) FILTER (b = 'h')) AS human_context
      FROM cand LEFT JOIN lab USING (incident_id, family) GROUP BY 1, 2),
    ranked AS (SELECT *, family || ':degradation' AS hypothesis_key, 2 * supporting - contradicting AS score,
        row_number() OVER (PARTITION BY incident_id ORDER BY 2 * supporting - contradicting DESC, family || ':degradation') AS rank FROM cnt),
    final AS (SELECT *, CASE WHEN supporting = 0 AND contradicting = 0 THEN 'UNRESOLVED' WHEN contradicting > supporting THEN 'WEAKENED' WHEN rank = 1 AND score > 0 AND contradicting = 0 THEN 'LEADING' ELSE 'CONTENDER' END AS status FROM ranked)"""


def labels(t):
    return I.hypothesis_labels(t.hyp_families, t.hyp_events, t.hyp_relations, t.hyp_gaps, t.hyp_notes)


def ranked(t):
    return I.rank_hypotheses(I.hypothesis_candidates(labels(t)))


@query("hypothesis_candidates", "WITH " + SQL_LABELS + " SELECT B(incident_id) AS incident_id, family, supporting, contradicting, missing, human_context FROM cnt")
def hypothesis_candidates(t):
    return I.hypothesis_candidates(labels(t))


@query("rank_hypotheses", "WITH " + SQL_LABELS + """ SELECT B(incident_id) AS incident_id, hypothesis_key, B(score) AS score, B(rank) AS rank, status,
    CASE WHEN score >= 4 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM final""")
def rank_hypotheses(t):
    return ranked(t).select("incident_id", "hypothesis_key", "score", big("rank").alias("rank"), "status", "confidence")


@query("replace_ranked", "WITH " + SQL_LABELS + """ SELECT B(incident_id) AS incident_id, hypothesis_key, B(rank) AS rank, 'UPSERT' AS action FROM final
    UNION ALL SELECT B(e.incident_id), e.k, NULL::BIGINT, 'DELETE' FROM (SELECT DISTINCT o_custkey AS incident_id, CASE o_orderkey % 4 WHEN 0 THEN 'VIDEO' WHEN 1 THEN 'GAM_ADSERVING' WHEN 2 THEN 'SEARCH_DISCOVER' ELSE 'CONSENT_CMP' END || ':degradation' AS k FROM orders) e
    WHERE e.incident_id IN (SELECT incident_id FROM final) AND NOT EXISTS (SELECT 1 FROM final f WHERE f.incident_id = e.incident_id AND f.hypothesis_key = e.k)""")
def replace_ranked(t):
    family = F.element_at(F.array(*[F.lit(f) for f in ("VIDEO", "GAM_ADSERVING", "SEARCH_DISCOVER", "CONSENT_CMP")]), (C("o_orderkey") % 4 + 1).cast("int"))
    stored = t.orders.select(C("o_custkey").alias("incident_id"), F.concat(family, F.lit(":degradation")).alias("hypothesis_key")).distinct()
    return I.replace_ranked(ranked(t), stored).withColumn("rank", big("rank"))


@query("evidence_by_hypothesis", """SELECT B(h.incident_id) AS incident_id, h.family, B(e.evidence_id) AS evidence_id, B(e.position) AS position FROM (SELECT incident_id, family FROM {hyp_families} UNION SELECT incident_id, family FROM {hyp_events}) h
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY incident_id, family ORDER BY evidence_id) AS position FROM {hyp_events}) e ON e.incident_id = h.incident_id AND e.family = h.family""")
def evidence_by_hypothesis(t):
    hypotheses = t.hyp_families.unionByName(t.hyp_events.select("incident_id", "family")).distinct()
    evidence = t.hyp_events.select("incident_id", "family", "evidence_id", C("evidence_id").alias("seq"))
    return I.evidence_by_hypothesis(hypotheses, evidence).select("incident_id", "family", "evidence_id", "position")


@query("relations_of", """SELECT B(edge_id) AS edge_id, B(from_id) AS from_id, B(to_id) AS to_id, relation_type FROM (SELECT DISTINCT * FROM {edges}) WHERE from_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
    OR to_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def relations_of(t):
    ids = t.orders.where(C("o_orderpriority") == "1-URGENT").select(C("o_orderkey").alias("event_id"))
    return I.relations_of(t.edges, ids).select("edge_id", "from_id", "to_id", "relation_type")


@query("append_relations", """WITH v AS (SELECT from_id, to_id, relation_type, engine_version, min(edge_id) AS edge_id FROM {edges} WHERE from_id <> to_id AND relation_type <> 'CAUSES' GROUP BY ALL)
    SELECT B(edge_id) AS edge_id, B(from_id) AS from_id, B(to_id) AS to_id, relation_type, engine_version FROM v
    WHERE NOT EXISTS (SELECT 1 FROM {edges} x WHERE x.at < TIMESTAMP '1997-01-01 00:00:00' AND x.from_id = v.from_id AND x.to_id = v.to_id AND x.relation_type = v.relation_type AND x.engine_version = v.engine_version)""")
def append_relations(t):
    stored = t.edges.where(C("at") < _ts("1997-01-01 00:00:00"))
    return I.append_relations(t.edges, stored).select("edge_id", "from_id", "to_id", "relation_type", "engine_version")


def _sql_section(name: str, table: str, n: int | None = None, since: bool = True) -> str:
    lower, most = "AND f.at >= i.window_start" if since else "", f" LIMIT {n}" if n else ""
    return f"""coalesce((SELECT list(entry ORDER BY at, id) FROM (SELECT entry, f.at, f.id FROM {{{table}}} f WHERE f.site = i.site {lower} AND f.at <= i.window_end ORDER BY f.at, f.id{most})), []) AS {name}"""


SQL_PACK = f"""doc AS (SELECT incident_id, to_json(struct_pack(engine_version := 'pack-v1', incident := incident_text, scheduled_checkpoints := a, public_config_states := b, events := c, relations := d, human_reported_notes := e))::VARCHAR AS content
    FROM (SELECT i.incident_id, i.incident_text, {_sql_section('a', 'pack_runs', 200)}, {_sql_section('b', 'pack_configs', 100)}, {_sql_section('c', 'pack_events', 200)},
        {_sql_section('d', 'pack_relations')}, {_sql_section('e', 'pack_notes', since=False)} FROM {{pack_incidents}} i))"""


def packs(t):
    return I.evidence_pack(t.pack_incidents, t.pack_runs, t.pack_configs, t.pack_events, t.pack_relations, t.pack_notes)


@query("evidence_pack", "WITH " + SQL_PACK + " SELECT B(incident_id) AS incident_id, B(octet_length(encode(content))) AS content_bytes, sha256(content) AS content_hash FROM doc")
def evidence_pack(t):
    return packs(t).drop("content")


@query("persist_pack", "WITH " + SQL_PACK + " SELECT B(incident_id) AS incident_id, sha256(content) AS content_hash FROM doc WHERE NOT contains(content, '\"events\":[]')")
def persist_pack(t):
    # Both sides come from the packs, so their digests are written once; the documents are not.
    built = written(packs(t).withColumn("eventless", F.contains("content", F.lit('"events":[]'))).drop("content"), "packs")
    # Already stored: the packs that hold no events.
    stored = built.where("eventless")
    return I.persist_pack(built, stored).select("incident_id", "content_hash")


@query("timeline", """SELECT B(site) AS site, 0 AS section, B(rn) AS position, B(id) AS id, TS(at) AS at_text, detail, CASE WHEN precision = 'EXACT' THEN TS(occurred_before) END AS occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY at DESC, id DESC) AS rn FROM {machine_events}) WHERE rn <= 100
    UNION ALL SELECT B(site), 1, B(rn), B(id), TS(at), detail, NULL FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY at DESC, id DESC) AS rn FROM {human_notes}) WHERE rn <= 100""")
def timeline(t):
    return I.timeline(t.machine_events, t.human_notes, 100).select(
        big("site").alias("site"), "section", big("position").alias("position"), "id", ts_text("at").alias("at_text"), "detail", ts_text("occurred_at").alias("occurred_at")
    )


@query("recent_activity", """SELECT B(site) AS site, B(rn) AS position, B(id) AS id, provenance FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY at DESC, provenance DESC, id DESC) AS rn FROM
    (SELECT site, at, id, 'machine_observed' AS provenance FROM {machine_events} UNION ALL SELECT site, at, id, 'human_reported' FROM {human_notes})) WHERE rn <= 5""")
def recent_activity(t):
    return I.recent_activity(t.machine_events, t.human_notes, 5).select(big("site").alias("site"), big("position").alias("position"), "id", "provenance")


@query("incident_list", "SELECT B(incident_id) AS incident_id, TS(opened_at) AS opened_at, status FROM {incidents}")
def incident_list(t):
    return I.incident_list(t.incidents).select("incident_id", ts_text("opened_at").alias("opened_at"), "status")


@query("open_incidents", "SELECT B(incident_id) AS incident_id, TS(opened_at) AS opened_at FROM {incidents} WHERE status IN ('OPEN', 'INVESTIGATING')")
def open_incidents(t):
    return I.open_incidents(t.incidents).select("incident_id", ts_text("opened_at").alias("opened_at"))


@query("recent_runs", "SELECT B(site) AS site, B(rn) AS position, B(run_id) AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY completed_at DESC, run_id DESC) AS rn FROM {runs}) WHERE rn <= 5")
def recent_runs(t):
    return I.recent_runs(t.runs).select(big("site").alias("site"), big("position").alias("position"), "run_id")


SQL_MAPPED = """m AS (SELECT c.*, unnest([lang, source]) AS dm FROM {corpus} c)"""


def corpus(t):
    return t.corpus.withColumn("domain_mappings", F.array("lang", "source"))


@query("corpus_patterns", "WITH " + SQL_MAPPED + """ SELECT dm AS domain_mapping, B(count(*)) AS incident_count, B(count(*) FILTER (evidence_score >= 2000)) AS high_evidence_count,
    B(count(*) FILTER (root_cause_status = 'confirmed')) AS confirmed_root_cause_count, (SELECT string_agg(x.incident_id, ',' ORDER BY x.incident_id) FROM (SELECT incident_id FROM m y WHERE y.dm = m.dm ORDER BY incident_id LIMIT 10) x) AS examples FROM m GROUP BY dm""")
def corpus_patterns(t):
    counts, examples = I.corpus_patterns(corpus(t), 2000)
    # At most ten examples per mapping.
    ids = examples.groupBy("domain_mapping").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "incident_id"))), lambda s: s["incident_id"].cast("string")), ",").alias("examples")
    )
    return counts.join(ids, "domain_mapping")


@query("eval_passrate", "WITH " + SQL_LABELS + """, act AS (SELECT incident_id, max(family) FILTER (status = 'LEADING') AS lead, coalesce(list_sort(list(family) FILTER (status = 'WEAKENED')), []) AS weak FROM final GROUP BY 1),
    ex AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'VIDEO' WHEN 1 THEN 'GAM_ADSERVING' END AS lead, CASE WHEN c_custkey % 5 = 0 THEN ['SEARCH_DISCOVER'] ELSE []::VARCHAR[] END AS weak FROM customer)
    SELECT B(ex.id) AS incident_id, (ex.lead IS NULL OR ex.lead IS NOT DISTINCT FROM act.lead) AND ex.weak = coalesce(act.weak, []) AS passed FROM ex LEFT JOIN act ON act.incident_id = ex.id""")
def eval_passrate(t):
    k = C("c_custkey")
    expected = t.customer.select(
        k.alias("incident_id"), F.when(k % 8 == 0, "VIDEO").when(k % 8 == 1, "GAM_ADSERVING").alias("leading_family"),
        F.when(k % 5 == 0, F.array(F.lit("SEARCH_DISCOVER"))).alias("weakened"),
    )
    return I.eval_passrate(expected, ranked(t)).select("incident_id", "passed")


@query("eval_coverage", """SELECT source AS family, lang AS eval_type, difficulty, root_cause_status AS outcome, B(count(*)) AS cases, B(grouping_id(source, lang, difficulty, root_cause_status)) AS level FROM {corpus}
    GROUP BY ROLLUP (source, lang, difficulty, root_cause_status)""")
def eval_coverage(t):
    return I.eval_coverage(t.corpus.select(C("source").alias("family"), C("lang").alias("eval_type"), "difficulty", C("root_cause_status").alias("outcome")))


frame(
    "gold_cases",
    """
    SELECT c_custkey AS case_id, c_mktsegment AS eval_type, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 3 END AS difficulty,
           CASE WHEN c_custkey % 8 IN (0, 1, 2) THEN 'VIDEO' WHEN c_custkey % 8 = 3 THEN 'CONSENT_CMP' WHEN c_custkey % 8 = 4 THEN 'GAM_ADSERVING' END AS first_family,
           CASE WHEN c_custkey % 8 IN (1, 4) THEN 'SEARCH_DISCOVER' END AS second_family
    FROM {customer}
    """,
)
REPLICATES = 100
STEPS = " + ".join(f"(place >= {step!r}::DOUBLE)::INT" for step in V.poisson_steps())


@query("eval_set_metrics", "WITH " + SQL_LABELS + f""",
    gold AS (SELECT case_id, eval_type, difficulty::VARCHAR AS difficulty, list_filter([first_family, second_family], lambda x: x IS NOT NULL) AS accepted FROM {{gold_cases}}),
    answer AS (SELECT case_id, bool_or(list_contains(accepted, family) AND rank = 1) AS one, bool_or(list_contains(accepted, family) AND rank <= 3) AS three, bool_or(status = 'LEADING') AS asserts,
        bool_or(status = 'LEADING' AND NOT list_contains(accepted, family)) AS wrong FROM final JOIN gold ON case_id = incident_id GROUP BY 1),
    judged_cases AS (SELECT case_id, eval_type, difficulty, len(accepted) > 0 AS settled, coalesce(one, false) AS one, coalesce(three, false) AS three, NOT coalesce(asserts, false) AS silent, coalesce(wrong, false) AS wrong
        FROM gold LEFT JOIN answer USING (case_id)),
    drawn AS (SELECT *, H60(concat(':', case_id, ':', r))::DOUBLE / {float(1 << 60)!r}::DOUBLE AS place FROM judged_cases, generate_series(0, {REPLICATES}) AS g(r)),
    weighed AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {STEPS} END AS w FROM drawn),
    sliced AS (SELECT 'all' AS slice, '' AS slice_value, * FROM weighed UNION ALL SELECT 'eval_type', coalesce(eval_type, ''), * FROM weighed UNION ALL SELECT 'difficulty', coalesce(difficulty, ''), * FROM weighed),
    rates AS (SELECT slice, slice_value, r, 'top1_accuracy' AS metric, sum(w) FILTER (settled AND one) AS hits, sum(w) FILTER (settled) AS n FROM sliced GROUP BY 1, 2, 3
      UNION ALL SELECT slice, slice_value, r, 'top3_recall', sum(w) FILTER (settled AND three), sum(w) FILTER (settled) FROM sliced GROUP BY 1, 2, 3
      UNION ALL SELECT slice, slice_value, r, 'false_cause_rate', sum(w) FILTER (wrong), sum(w) FROM sliced GROUP BY 1, 2, 3
      UNION ALL SELECT slice, slice_value, r, 'unresolved_precision', sum(w) FILTER (silent AND NOT settled), sum(w) FILTER (silent) FROM sliced GROUP BY 1, 2, 3
      UNION ALL SELECT slice, slice_value, r, 'unresolved_recall', sum(w) FILTER (silent AND NOT settled), sum(w) FILTER (NOT settled) FROM sliced GROUP BY 1, 2, 3),
    shares AS (SELECT *, CASE WHEN n > 0 THEN coalesce(hits, 0) / n END AS rate FROM rates)
    SELECT slice, slice_value, metric, B(coalesce(max(n) FILTER (r = 0), 0)) AS cases, round(max(rate) FILTER (r = 0), 6) AS value, round(quantile_cont(rate, 0.025) FILTER (r > 0), 6) AS lower,
        round(quantile_cont(rate, 0.975) FILTER (r > 0), 6) AS upper FROM shares GROUP BY 1, 2, 3""")
def eval_set_metrics(t):
    families = F.array_compact(F.array("first_family", "second_family"))
    cases = t.gold_cases.select("case_id", families.alias("accepted"), "eval_type", "difficulty")
    answers = ranked(t).select(C("incident_id").alias("case_id"), "family", "rank", "status")
    found = V.eval_set_metrics(cases, answers, ["eval_type", "difficulty"], REPLICATES)
    return found.select("slice", "slice_value", "metric", "cases", *[r6(c).alias(c) for c in ("value", "lower", "upper")])
