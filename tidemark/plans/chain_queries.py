"""From pairs of runs to event candidates, skip reasons and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogs import FINAL_RUN_STATUSES
from tidemark.functions.shape import big, ts_text
from tidemark.operators import chain as N
from tidemark.operators import events as E
from tidemark.operators import lineage as L
from tidemark.plans.event_queries import STATE, _sql_lifecycle, gained_noindex, linked
from tidemark.plans.lake import frame
from tidemark.plans.registry import query
from tidemark.session import written

C = F.col

# One window in five still waits for runs, another fifth has failed ones, the rest is complete; two months later nothing ran.
frame(
    "chain_runs",
    """
    SELECT run_id, site, scheduled_for, CASE WHEN (site + day(scheduled_for)) % 5 = 0 AND run_id % 2 = 0 THEN 'PENDING'
        WHEN (site + day(scheduled_for)) % 5 = 1 AND run_id % 3 = 0 THEN 'BROWSER_ERROR' ELSE 'COMPLETE' END AS status
    FROM {runs} WHERE observation_kind = 'SCHEDULED'
    """,
)
frame(
    "chain_windows",
    """
    SELECT DISTINCT site, scheduled_for FROM {chain_runs}
    UNION SELECT DISTINCT site, scheduled_for + INTERVAL '60' DAY FROM {chain_runs}
    """,
)
frame(
    "run_slots",
    """
    SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS slot, min(CASE WHEN l_quantity < 40 THEN 1 ELSE 0 END) = 1 AS present, max(l_linenumber) < 7 AS expected
    FROM {lineitem} GROUP BY 1, 2
    """,
)

SQL_CHAIN = """
    cw AS (SELECT w.site, w.scheduled_for, coalesce(open = 0 AND failed = 0, false) AS complete FROM {chain_windows} w LEFT JOIN (SELECT site, scheduled_for,
        count(*) FILTER (status = 'PENDING') AS open, count(*) FILTER (status = 'BROWSER_ERROR') AS failed FROM {chain_runs} GROUP BY 1, 2) USING (site, scheduled_for)),
    ok AS (SELECT * FROM {judged} WHERE skips = ''),
    okw AS (SELECT ok.* FROM ok JOIN cw USING (site, scheduled_for) WHERE complete),
    du AS (SELECT o.run_id, m.member, true AS c FROM ok o JOIN {members} m ON m.snapshot_id = o.run_id UNION ALL SELECT o.run_id, m.member, false FROM ok o JOIN {members} m ON m.snapshot_id = o.previous_id),
    dx AS (SELECT run_id, member, bool_or(c) AS here, bool_or(NOT c) AS was, run_id % 11 = 0 OR any_value(previous_id) % 11 = 0 AS cut FROM du JOIN ok USING (run_id) GROUP BY 1, 2),
    tri AS (SELECT o.run_id, o.previous_id, b.previous_id AS prior_id, q.completed_at AS prior_at,
        coalesce(q.status IN ('COMPLETE', 'PARTIAL') AND q.completed_at < o.prev_at AND q.javascript_errors_version = o.p3, false) AS fit
        FROM ok o LEFT JOIN {linked} b ON b.run_id = o.previous_id AND b.selection_scope = 'EXACT_MONITORED_URL' LEFT JOIN {runstates} q ON q.run_id = b.previous_id),
    eu AS (SELECT o.run_id, e.member, 0 AS side FROM tri o JOIN {errors} e ON e.snapshot_id = o.run_id
      UNION ALL SELECT o.run_id, e.member, 1 FROM tri o JOIN {errors} e ON e.snapshot_id = o.previous_id
      UNION ALL SELECT o.run_id, e.member, 2 FROM tri o JOIN {errors} e ON e.snapshot_id = o.prior_id),
    ef AS (SELECT run_id, member, bool_or(side = 0) AS c, bool_or(side = 1) AS p, bool_or(side = 2) AS q FROM eu GROUP BY 1, 2),
    ea AS (SELECT run_id, member, CASE WHEN c AND NOT p THEN 'PENDING' WHEN c AND fit AND NOT q THEN 'UPSERT' WHEN c THEN 'SUPPORT' ELSE 'RESOLVE' END AS action FROM ef JOIN tri USING (run_id) WHERE c OR p),
    sl AS (SELECT o.run_id, a.slot, a.present, b.present AS before FROM ok o JOIN {run_slots} a ON a.run_id = o.run_id AND a.expected LEFT JOIN {run_slots} b ON b.run_id = o.previous_id AND b.slot = a.slot AND b.expected),
    noi AS (SELECT * FROM ok WHERE coalesce(cm LIKE '%NoIndex%', false) AND NOT coalesce(pm LIKE '%NoIndex%', false)),
    said AS (SELECT run_id, CASE WHEN here THEN 'THIRD_PARTY_DEPENDENCY_ADDED' ELSE 'THIRD_PARTY_DEPENDENCY_REMOVED' END AS code, member::VARCHAR AS subject, 'RECORD' AS action, CASE WHEN here THEN 'LOW' ELSE 'MEDIUM' END AS severity
        FROM dx WHERE here <> was AND (here OR NOT cut)
      UNION ALL SELECT run_id, 'JS_ERROR_STARTED', member::VARCHAR, action, 'MEDIUM' FROM ea
      UNION ALL SELECT run_id, 'NOINDEX_ADDED', 'rendered-page', 'PENDING', 'MEDIUM' FROM noi
      UNION ALL SELECT run_id, 'CANONICAL_CHANGED', 'rendered-page', 'RECORD', 'MEDIUM' FROM ok WHERE pc IS DISTINCT FROM cc
      UNION ALL SELECT run_id, 'GPT_EXPECTED_SLOT_MISSING', slot::VARCHAR, 'PENDING', 'HIGH' FROM sl WHERE NOT present AND before),
    ng AS (SELECT site, scheduled_for, template_id, scenario_id, count(*) FILTER (run_id IN (SELECT run_id FROM noi)) AS a, count(*) AS n FROM okw GROUP BY 1, 2, 3, 4),
    sg AS (SELECT site, scheduled_for, template_id, scenario_id, slot, count(*) FILTER (NOT present) AS a, count(*) FILTER (present) AS h, count(*) FILTER (NOT present AND before) AS tr, count(DISTINCT url_id) AS v,
        min(prev_at) FILTER (NOT present AND before) AS t0, min(prev_at) FILTER (NOT present) AS a0, min(prev_at) FILTER (present) AS h0, max(cur_at) FILTER (NOT present) AS a1, max(cur_at) FILTER (present) AS h1
        FROM sl JOIN okw USING (run_id) GROUP BY 1, 2, 3, 4, 5),
    win AS (SELECT site, scheduled_for, template_id, scenario_id, NULL::BIGINT AS url_id, NULL::BIGINT AS run_id, 'NOINDEX_ADDED' AS code, 'rendered-template' AS subject, 'RECORD' AS action, 'CRITICAL' AS severity,
        min(prev_at) AS since, max(cur_at) AS detected_at, any_value(a) AS affected_count, any_value(n) AS valid_count, any_value(a) AS runs
        FROM noi JOIN ng USING (site, scheduled_for, template_id, scenario_id) WHERE a >= 2 GROUP BY 1, 2, 3, 4
      UNION ALL SELECT site, scheduled_for, template_id, scenario_id, url_id, run_id, 'NOINDEX_ADDED', 'rendered-page', 'RECORD', 'MEDIUM', prev_at, cur_at, 1, 1, 1 FROM noi JOIN ng USING (site, scheduled_for, template_id, scenario_id) WHERE a < 2
      UNION ALL SELECT site, scheduled_for, template_id, scenario_id, NULL, NULL, 'GPT_EXPECTED_SLOT_MISSING', slot::VARCHAR, CASE WHEN a > 0 AND tr >= 2 THEN 'UPSERT' WHEN a > 0 THEN 'SUPPORT' ELSE 'RESOLVE' END,
        CASE WHEN a >= 3 AND a = v THEN 'CRITICAL' ELSE 'HIGH' END, CASE WHEN a > 0 AND tr >= 2 THEN t0 WHEN a > 0 THEN a0 ELSE h0 END, CASE WHEN a > 0 THEN a1 ELSE h1 END, a, v, a
        FROM sg WHERE v >= 2 AND (a >= 2 OR (a = 0 AND h >= 2))),
    cand AS (SELECT 0 AS section, o.site, o.scheduled_for, o.template_id, o.scenario_id, o.url_id, s.run_id, s.code, s.subject, s.action, s.severity, CASE WHEN s.action = 'UPSERT' THEN t.prior_at ELSE o.prev_at END AS since,
        o.cur_at AS detected_at, 1 AS affected_count, 1 AS valid_count, CASE WHEN s.action = 'UPSERT' THEN 2 ELSE 1 END AS runs
        FROM said s JOIN ok o USING (run_id) JOIN tri t USING (run_id)
        WHERE s.action <> 'PENDING' OR NOT EXISTS (SELECT 1 FROM win w WHERE w.site = o.site AND w.scheduled_for = o.scheduled_for AND w.code = s.code)
      UNION ALL SELECT 1, * FROM win)"""


def chain_pairs(t):
    """Routine pairs with both states; whether a run's list of dependencies was cut off belongs to its state."""
    states = t.runstates.withColumn("truncated", C("run_id") % 11 == 0)
    return L.pair_validity(L.with_states(linked(t).drop("status", "completed_at"), states, [*STATE, "truncated"]))


def chain_inputs(t):
    """Pairs with prior run and window, what they hold, and the windows."""
    windows = E.window_status(t.chain_windows, t.chain_runs, FINAL_RUN_STATUSES)
    # Several branches read these; written once, their lineage is not planned and run again in each.
    linked_pairs = written(N.in_windows(chain_pairs(t), windows), "chain-pairs")
    pairs = written(N.with_prior(linked_pairs, t.runstates), "chain-triples")
    held = [frame.withColumnRenamed("snapshot_id", "run_id") for frame in (t.members, t.errors)]
    return pairs, written(N.pair_facts(pairs, *held, t.run_slots), "chain-facts"), windows


def candidates(t):
    pairs, facts, _ = chain_inputs(t)
    return N.event_candidates(N.local_candidates(pairs, facts, gained_noindex()), N.window_candidates(pairs, facts, gained_noindex()))


@query("event_candidates", "WITH" + SQL_CHAIN + """
    SELECT section, B(site) AS site, TS(scheduled_for) AS scheduled_for, B(template_id) AS template_id, B(scenario_id) AS scenario_id, B(url_id) AS url_id, B(run_id) AS run_id, code, subject, action, severity,
        TS(since) AS occurred_after, TS(detected_at) AS detected_at, B(affected_count) AS affected_count, B(valid_count) AS valid_count, B(runs) AS runs FROM cand""")
def event_candidates(t):
    return candidates(t).select(
        "section", big("site").alias("site"), ts_text("scheduled_for").alias("scheduled_for"), big("template_id").alias("template_id"), big("scenario_id").alias("scenario_id"),
        big("url_id").alias("url_id"), big("run_id").alias("run_id"), "code", "subject", "action", "severity", ts_text("occurred_after").alias("occurred_after"),
        ts_text("detected_at").alias("detected_at"), "affected_count", "valid_count", "runs",
    )


@query("event_skips", "WITH" + SQL_CHAIN + """,
    own AS (SELECT run_id, unnest(CASE WHEN previous_id IS NULL THEN ['NO_PREDECESSOR'] ELSE list_filter(string_split(skips, ','), lambda x: x <> '') END) AS reason FROM {judged}
      UNION ALL SELECT DISTINCT run_id, 'TRUNCATED_DEPENDENCY_ABSENCE' FROM dx WHERE was AND NOT here AND cut),
    why AS (SELECT site, scheduled_for, unnest(list_filter([reason, CASE WHEN c1 IS NULL OR p1 IS NULL THEN 'MISSING_SCRIPTS_STATE' END, CASE WHEN c2 <> p2 THEN 'INCOMPATIBLE_NETWORK_NORMALIZER' END,
        CASE WHEN c3 IS NULL OR p3 IS NULL THEN 'MISSING_JAVASCRIPT_ERRORS_STATE' END], lambda x: x IS NOT NULL)) AS reason FROM {judged} JOIN cw USING (site, scheduled_for) WHERE complete AND previous_id IS NOT NULL
      UNION ALL SELECT site, scheduled_for, 'INCOMPLETE_CHECKPOINT_WINDOW' FROM {judged} JOIN cw USING (site, scheduled_for) WHERE NOT complete AND previous_id IS NOT NULL)
    SELECT 0 AS section, NULL::BIGINT AS site, NULL::VARCHAR AS scheduled_for, B(run_id) AS run_id, reason, 1::BIGINT AS runs FROM own
    UNION ALL SELECT 1, B(site), TS(scheduled_for), NULL, reason, B(count(*)) FROM why GROUP BY site, scheduled_for, reason
    UNION ALL SELECT 1, B(site), TS(scheduled_for), NULL, 'EMPTY_CHECKPOINT_WINDOW', 0 FROM cw WHERE (site, scheduled_for) NOT IN (SELECT (site, scheduled_for) FROM {judged} WHERE previous_id IS NOT NULL)""")
def event_skips(t):
    pairs, facts, windows = chain_inputs(t)
    none = F.lit(None)
    own = N.run_skips(pairs, facts).select(
        F.lit(0).alias("section"), none.cast("bigint").alias("site"), none.cast("string").alias("scheduled_for"), big("run_id").alias("run_id"), "reason", F.lit(1).cast("bigint").alias("runs")
    )
    return own.unionByName(N.window_skips(pairs, windows).select(
        F.lit(1).alias("section"), big("site").alias("site"), ts_text("scheduled_for").alias("scheduled_for"), none.cast("bigint").alias("run_id"), "reason", "runs"
    ))


@query("event_episodes", "WITH RECURSIVE" + SQL_CHAIN + """,
    acts AS (SELECT site, code, subject, template_id, scenario_id, coalesce(url_id, -1) AS url_id, detected_at AS at, coalesce(run_id, epoch(scheduled_for)::BIGINT) AS run_id, action, severity, affected_count, valid_count, runs
        FROM cand WHERE action IN ('UPSERT', 'SUPPORT', 'RESOLVE')), """ + _sql_lifecycle("acts", "site, code, subject, template_id, scenario_id, url_id", "at, run_id", "runs") + """
    SELECT B(site) AS site, code, subject, B(template_id) AS template_id, B(scenario_id) AS scenario_id, B(nullif(url_id, -1)) AS url_id, episode, TS(detected_at) AS detected_at, TS(ended_at) AS ended_at, severity, supporting_count,
        affected_count, valid_count, CASE WHEN affected_count >= 2 THEN 2 ELSE 1 END AS blast_radius, CASE WHEN ended_at IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS status FROM ep""")
def event_episodes(t):
    return N.event_episodes(candidates(t)).select(
        big("site").alias("site"), "code", "subject", big("template_id").alias("template_id"), big("scenario_id").alias("scenario_id"), big("url_id").alias("url_id"), "episode",
        ts_text("detected_at").alias("detected_at"), ts_text("ended_at").alias("ended_at"), "severity", "supporting_count", "affected_count", "valid_count", "blast_radius", "status",
    )
