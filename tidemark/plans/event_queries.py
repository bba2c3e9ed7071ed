"""Lineage, change detection, cohorts and condition lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogs import FINAL_RUN_STATUSES
from tidemark.functions import text as T
from tidemark.functions.shape import big, ts_text
from tidemark.operators import events as E
from tidemark.operators import lineage as L
from tidemark.operators.ordered import carry_previous, time_bucket
from tidemark.plans.lake import frame
from tidemark.plans.registry import query

C = F.col

frame(
    "linked",
    """
    WITH f AS (SELECT *, {'at': scheduled_for, 'done': completed_at, 'id': run_id} AS me FROM {runs} WHERE observation_kind = 'SCHEDULED'),
    w AS (SELECT *,
        max(me) OVER (PARTITION BY site, scenario_id, url_id ORDER BY epoch(scheduled_for) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
        max(me) OVER (PARTITION BY site, scenario_id, template_id ORDER BY epoch(scheduled_for) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM f)
    SELECT run_id, site, url_id, template_id, scenario_id, scheduled_for, coalesce(e.id, r.id) AS previous_id,
        CASE WHEN e IS NOT NULL THEN 'EXACT_MONITORED_URL' WHEN r IS NOT NULL THEN 'SAME_TEMPLATE_URL_ROTATION' END AS selection_scope FROM w
    """,
)
frame(
    "judged",
    """
    WITH j AS (SELECT l.*, c.completed_at AS cur_at, p.completed_at AS prev_at, c.status AS cs, p.status AS ps, c.meta_robots AS cm, p.meta_robots AS pm,
        c.canonical AS cc, p.canonical AS pc, c.scripts_version AS c1, p.scripts_version AS p1, c.network_version AS c2, p.network_version AS p2,
        c.javascript_errors_version AS c3, p.javascript_errors_version AS p3
        FROM {linked} l JOIN {runstates} c ON c.run_id = l.run_id LEFT JOIN {runstates} p ON p.run_id = l.previous_id),
    k AS (SELECT *, CASE WHEN selection_scope IS DISTINCT FROM 'EXACT_MONITORED_URL' THEN 'NON_EXACT_URL_LINEAGE'
        WHEN cs NOT IN ('COMPLETE', 'PARTIAL') OR ps NOT IN ('COMPLETE', 'PARTIAL') THEN 'INVALID_CHECKPOINT_STATUS'
        WHEN cur_at <= prev_at THEN 'UNORDERED_OBSERVATION_TIME' END AS reason FROM j)
    SELECT *, coalesce(reason, concat_ws(',', CASE WHEN c1 IS NULL OR p1 IS NULL THEN 'MISSING_SCRIPTS_STATE' END,
        CASE WHEN c2 <> p2 THEN 'INCOMPATIBLE_NETWORK_NORMALIZER' END,
        CASE WHEN c3 IS NULL OR p3 IS NULL THEN 'MISSING_JAVASCRIPT_ERRORS_STATE' END)) AS skips FROM k
    """,
)
frame(
    "pairs",
    """
    SELECT *, lag(snapshot_id) OVER w AS previous_id, lag(truncated) OVER w AS previous_truncated, lag(dom_hash) OVER w AS previous_dom_hash,
        lag(has_state) OVER w AS previous_has_state, lag(dom_version) OVER w AS previous_dom_version, lag(network_version) OVER w AS previous_network_version,
        lag(javascript_errors_version) OVER w AS previous_js_version, lag(at) OVER w AS previous_at, lag(run_status) OVER w AS previous_run_status
    FROM {snapshots} WINDOW w AS (PARTITION BY url_id ORDER BY at, snapshot_id)
    """,
)


def linked(t):
    return L.previous_comparable(t.runs)


STATE = ["status", "completed_at", "scripts_version", "network_version", "javascript_errors_version", "seo_version", "meta_robots", "canonical"]


def judged(t):
    return L.pair_validity(L.with_states(linked(t).drop("status", "completed_at"), t.runstates, STATE))


def usable(t):
    return judged(t).where(F.size("skip_reasons") == 0)


def pairs(t):
    return L.previous_snapshot(t.snapshots, ["url_id"])


@query("scheduled_cohort", "SELECT B(site) AS site, status, B(count(*)) AS runs FROM {runs} WHERE observation_kind = 'SCHEDULED' GROUP BY ALL")
def scheduled_cohort(t):
    return L.scheduled_cohort(t.runs).groupBy(big("site").alias("site"), "status").agg(F.count("*").alias("runs"))


@query("previous_comparable", "SELECT B(run_id) AS run_id, B(previous_id) AS previous_id, selection_scope FROM {linked}")
def previous_comparable(t):
    return linked(t).select("run_id", "previous_id", "selection_scope")


@query(
    "lineage_two_back",
    """SELECT B(a.run_id) AS run_id, B(a.previous_id) AS previous_id, B(CASE WHEN a.selection_scope = 'EXACT_MONITORED_URL' THEN b.previous_id END) AS prior_id
    FROM {linked} a LEFT JOIN {linked} b ON b.run_id = a.previous_id AND b.selection_scope = 'EXACT_MONITORED_URL'""",
)
def lineage_two_back(t):
    return L.lineage_two_back(linked(t)).select("run_id", "previous_id", "prior_id")


@query("pair_validity", "SELECT B(run_id) AS run_id, skips FROM {judged}")
def pair_validity(t):
    return judged(t).select("run_id", F.array_join("skip_reasons", ",").alias("skips"))


@query("value_changed", "SELECT B(run_id) AS run_id, pc AS before, cc AS after FROM {judged} WHERE skips = '' AND pc IS DISTINCT FROM cc")
def value_changed(t):
    changed = usable(t).where(L.value_changed(C("prev_canonical"), C("cur_canonical")))
    return changed.select("run_id", C("prev_canonical").alias("before"), C("cur_canonical").alias("after"))


def gained_noindex():
    return F.array_contains(T.directives(C("cur_meta_robots")), "noindex") & ~F.array_contains(T.directives(C("prev_meta_robots")), "noindex")


def cohort_pairs(t):
    return usable(t).select(
        "site", "scheduled_for", F.concat_ws("@", C("site").cast("string"), ts_text("scheduled_for")).alias("window_id"), "template_id", "scenario_id", "url_id", "run_id",
        gained_noindex().alias("affected"), C("prev_completed_at").alias("previous_at"), C("cur_completed_at").alias("current_at"),
    )


def complete_cohort(t):
    windows = E.window_status(t.wwindows, t.wruns, FINAL_RUN_STATUSES)
    return E.noindex_cohort(E.in_complete_windows(cohort_pairs(t), windows))


SQL_NOINDEX = """WITH v AS (SELECT site, scheduled_for, concat(site, '@', TS(scheduled_for)) AS window_id, template_id, scenario_id, url_id, run_id, prev_at, cur_at,
        coalesce(cm LIKE '%NoIndex%', false) AND NOT coalesce(pm LIKE '%NoIndex%', false) AS affected FROM {judged} WHERE skips = ''),
    g AS (SELECT site, scheduled_for, window_id, template_id, scenario_id, count(*) FILTER (affected) AS a, count(*) AS n, min(prev_at) FILTER (affected) AS oa,
        max(cur_at) FILTER (affected) AS da FROM v GROUP BY 1, 2, 3, 4, 5),
    cohort AS (SELECT window_id, template_id, scenario_id, NULL::BIGINT AS run_id, 'rendered-template' AS subject, 'CRITICAL' AS severity, B(a) AS affected_count,
        B(n) AS valid_count, oa, da FROM g WHERE a >= 2 AND n >= 2
      UNION ALL SELECT v.window_id, v.template_id, v.scenario_id, v.run_id, 'rendered-page', 'MEDIUM', 1, 1, v.prev_at, v.cur_at
        FROM v JOIN g USING (window_id, template_id, scenario_id) WHERE v.affected AND NOT (g.a >= 2 AND g.n >= 2)),
    done AS (SELECT site, scheduled_for FROM {wruns} GROUP BY 1, 2 HAVING count(*) FILTER (status <> 'COMPLETE') = 0)"""


@query("noindex_cohort", SQL_NOINDEX + """ SELECT window_id, B(template_id) AS template_id, B(scenario_id) AS scenario_id, B(run_id) AS run_id, subject, severity,
    affected_count, valid_count, TS(oa) AS occurred_after, TS(da) AS detected_at FROM cohort""")
def noindex_cohort(t):
    return E.noindex_cohort(cohort_pairs(t)).select(
        "window_id", big("template_id").alias("template_id"), big("scenario_id").alias("scenario_id"), "run_id", "subject",
        "severity", "affected_count", "valid_count", ts_text("occurred_after").alias("occurred_after"), ts_text("detected_at").alias("detected_at"),
    )


@query("noindex_pending", SQL_NOINDEX + """ SELECT B(run_id) AS run_id, window_id FROM v WHERE affected AND NOT EXISTS (SELECT 1 FROM done d WHERE d.site = v.site AND d.scheduled_for = v.scheduled_for)""")
def noindex_pending(t):
    code = F.lit("NOINDEX_ADDED").alias("code")
    pending = cohort_pairs(t).where("affected").select("run_id", "window_id", code)
    return E.pending_without_cohort(pending, complete_cohort(t).select("window_id", code)).select("run_id", "window_id")


SQL_PRESENCE = """WITH u AS (SELECT p.snapshot_id, m.member, true AS c, false AS v FROM {pairs} p JOIN {members} m ON m.snapshot_id = p.snapshot_id WHERE p.previous_id IS NOT NULL
      UNION ALL SELECT p.snapshot_id, m.member, false, true FROM {pairs} p JOIN {members} m ON m.snapshot_id = p.previous_id),
    f AS (SELECT snapshot_id, member, bool_or(c) AS in_cur, bool_or(v) AS in_prev FROM u GROUP BY 1, 2),
    x AS (SELECT f.*, p.truncated OR p.previous_truncated AS cut FROM f JOIN {pairs} p USING (snapshot_id) WHERE in_cur <> in_prev)"""


@query("presence_changes", SQL_PRESENCE + """ SELECT B(snapshot_id) AS snapshot_id, CASE WHEN in_cur THEN 'PRESENCE_ADDED' ELSE 'PRESENCE_REMOVED' END AS change, B(member) AS member
    FROM x WHERE in_cur OR NOT cut UNION ALL SELECT DISTINCT B(snapshot_id), 'TRUNCATED_DEPENDENCY_ABSENCE', NULL::BIGINT FROM x WHERE in_prev AND cut""")
def presence_changes(t):
    return L.presence_changes(pairs(t), t.members)


@query("config_record_diff", SQL_PRESENCE + " SELECT B(snapshot_id) AS snapshot_id, B(member) AS member, CASE WHEN in_cur THEN 'ADDED' ELSE 'REMOVED' END AS change FROM x")
def config_record_diff(t):
    return L.record_diff(pairs(t), t.members, "member")


@query(
    "error_transitions",
    """WITH tri AS (SELECT *, lag(previous_id) OVER (PARTITION BY url_id ORDER BY at, snapshot_id) AS prior_id,
        lag(previous_at) OVER (PARTITION BY url_id ORDER BY at, snapshot_id) AS prior_at,
        lag(previous_run_status) OVER (PARTITION BY url_id ORDER BY at, snapshot_id) AS prior_status FROM {pairs}),
    ok AS (SELECT *, coalesce(prior_status <> 'P' AND prior_at < previous_at, false) AS comparable FROM tri WHERE previous_id IS NOT NULL),
    u AS (SELECT o.snapshot_id, e.member, 0 AS side FROM ok o JOIN {errors} e ON e.snapshot_id = o.snapshot_id
      UNION ALL SELECT o.snapshot_id, e.member, 1 FROM ok o JOIN {errors} e ON e.snapshot_id = o.previous_id
      UNION ALL SELECT o.snapshot_id, e.member, 2 FROM ok o JOIN {errors} e ON e.snapshot_id = o.prior_id),
    f AS (SELECT snapshot_id, member, bool_or(side = 0) AS c, bool_or(side = 1) AS p, bool_or(side = 2) AS q FROM u GROUP BY 1, 2)
    SELECT B(snapshot_id) AS snapshot_id, member, CASE WHEN c AND NOT p THEN 'PENDING' WHEN c AND comparable AND NOT q THEN 'UPSERT' WHEN c THEN 'SUPPORT' ELSE 'RESOLVE' END AS action
    FROM f JOIN ok USING (snapshot_id) WHERE c OR p""",
)
def error_transitions(t):
    two = pairs(t).select("snapshot_id", "url_id", "at", "previous_id", "previous_at", "previous_run_status")
    two = two.withColumn("_p", F.struct(C("previous_id").alias("id"), C("previous_at").alias("at"), C("previous_run_status").alias("status")))
    tri = carry_previous(two, ["url_id"], ["at", "snapshot_id"], "_p", "_q", time_bucket("at"))
    comparable = F.coalesce((C("_q.status") != "P") & (C("_q.at") < C("previous_at")), F.lit(False))
    triples = tri.select("snapshot_id", "previous_id", C("_q.id").alias("prior_id"), comparable.alias("prior_comparable"))
    return L.error_transitions(triples, t.errors)


frame(
    "verdicts",
    """
    SELECT *, CASE WHEN previous_id IS NULL THEN 'NO_PREDECESSOR' WHEN NOT previous_has_state THEN 'PREDECESSOR_HAS_NO_NORMALIZED_STATE'
        WHEN dom_version IS NULL OR previous_dom_version IS NULL THEN 'MISSING_DOM_STATE' WHEN network_version <> previous_network_version THEN 'INCOMPATIBLE_NETWORK_NORMALIZER'
        WHEN javascript_errors_version IS NULL OR previous_js_version IS NULL THEN 'MISSING_JAVASCRIPT_ERRORS_STATE' END AS reason FROM {pairs}
    """,
)
frame(
    "statusdiff",
    """
    SELECT p.snapshot_id, p.reason, c.member FROM {verdicts} p JOIN {netcounts} c ON c.snapshot_id = p.snapshot_id
    JOIN {netcounts} v ON v.snapshot_id = p.previous_id AND v.member = c.member
    WHERE (c.failures, c.status_4xx, c.status_5xx) <> (v.failures, v.status_4xx, v.status_5xx)
    """,
)


def _sql_set(component: str, table: str) -> str:
    return f"""SELECT snapshot_id, '{component}' AS component, CASE WHEN bool_or(side = 0) THEN 'PRESENCE_ADDED' ELSE 'PRESENCE_REMOVED' END AS kind, member::VARCHAR AS stable_key
      FROM (SELECT p.snapshot_id, m.member, 0 AS side FROM ok p JOIN {{{table}}} m ON m.snapshot_id = p.snapshot_id
            UNION ALL SELECT p.snapshot_id, m.member, 1 FROM ok p JOIN {{{table}}} m ON m.snapshot_id = p.previous_id)
      GROUP BY snapshot_id, member HAVING count(DISTINCT side) = 1"""


SQL_CHANGES = f"""WITH ok AS (SELECT * FROM {{verdicts}} WHERE reason IS NULL),
    changes AS (SELECT snapshot_id, 'DOM' AS component, 'STRUCTURAL_CHANGE' AS kind, '' AS stable_key FROM ok WHERE dom_hash <> previous_dom_hash
      UNION ALL {_sql_set('SCRIPT', 'members')} UNION ALL {_sql_set('NETWORK_DEPENDENCY', 'netmembers')} UNION ALL {_sql_set('JAVASCRIPT_ERROR', 'errors')}
      UNION ALL SELECT snapshot_id, 'NETWORK_DEPENDENCY', 'STATUS_CHANGE', member::VARCHAR FROM {{statusdiff}} WHERE reason IS NULL)"""


def compared(t):
    return L.state_compare(
        pairs(t), {"SCRIPT": t.members, "NETWORK_DEPENDENCY": t.netmembers, "JAVASCRIPT_ERROR": t.errors}, t.netcounts
    )


@query("state_compare", SQL_CHANGES + """ SELECT B(v.snapshot_id) AS snapshot_id, CASE WHEN v.reason IS NULL THEN 'COMPARABLE' ELSE 'NOT_COMPARABLE' END AS status, v.reason,
    B(coalesce(n, 0)) AS change_count FROM {verdicts} v LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM changes GROUP BY 1) USING (snapshot_id)""")
def state_compare(t):
    verdicts, changes = compared(t)
    counts = changes.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    return verdicts.join(counts, "snapshot_id", "left").select(
        "snapshot_id", "status", "reason", F.coalesce("n", F.lit(0)).alias("change_count")
    )


@query("status_changes", "SELECT B(snapshot_id) AS snapshot_id, B(member) AS member FROM {statusdiff}")
def status_changes(t):
    return L.status_changes(pairs(t), t.netcounts).select("snapshot_id", "member")


@query("bounded_changes", SQL_CHANGES + """ SELECT B(snapshot_id) AS snapshot_id, component, kind, stable_key, B(rn) AS position, B(n) AS change_count, n > 200 AS truncated
    FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY component, kind, stable_key) AS rn, count(*) OVER (PARTITION BY snapshot_id) AS n FROM changes) WHERE rn <= 200""")
def bounded_changes(t):
    return L.bounded_changes(compared(t)[1], 200).select(
        "snapshot_id", "component", "kind", "stable_key", big("position").alias("position"), "change_count", "truncated"
    )


@query(
    "window_status",
    """SELECT B(w.site) AS site, TS(w.scheduled_for) AS scheduled_for, CASE WHEN n IS NULL THEN 'SCHEDULED' WHEN o > 0 AND s > 0 THEN 'RUNNING' WHEN o > 0 THEN 'SCHEDULED'
        WHEN f = n THEN 'FAILED' WHEN f > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS window_status
    FROM {wwindows} w LEFT JOIN (SELECT site, scheduled_for, count(*) AS n, count(*) FILTER (status IN ('PENDING', 'RUNNING')) AS o, count(*) FILTER (status <> 'PENDING') AS s,
        count(*) FILTER (status = 'BROWSER_ERROR') AS f FROM {wruns} GROUP BY 1, 2) USING (site, scheduled_for)""",
)
def window_status(t):
    return E.window_status(t.wwindows, t.wruns, FINAL_RUN_STATUSES).select(
        big("site").alias("site"), ts_text("scheduled_for").alias("scheduled_for"), "window_status"
    )


SQL_SLOTS = """WITH prev AS (SELECT snapshot_id, previous_id FROM {pairs}),
    s AS (SELECT a.*, b.present AS previous_present FROM {slots} a LEFT JOIN prev USING (snapshot_id) LEFT JOIN {slots} b ON b.snapshot_id = prev.previous_id AND b.slot = a.slot),
    g AS (SELECT window_id, template_id, scenario_id, slot, count(*) FILTER (NOT present) AS a, count(*) FILTER (present) AS h,
        count(*) FILTER (NOT present AND previous_present) AS tr, count(DISTINCT url_id) AS v FROM s GROUP BY 1, 2, 3, 4),
    acted AS (SELECT *, CASE WHEN a >= 2 AND v >= 2 THEN CASE WHEN tr >= 2 THEN 'UPSERT' ELSE 'SUPPORT' END WHEN a = 0 AND h >= 2 AND v >= 2 THEN 'RESOLVE' END AS action FROM g)"""


def slot_pairs(t):
    back = pairs(t).select("snapshot_id", "previous_id")
    before = t.slots.select(C("snapshot_id").alias("previous_id"), "slot", C("present").alias("previous_present"))
    return t.slots.join(back, "snapshot_id", "left").join(before, ["previous_id", "slot"], "left")


@query("slot_cohort", SQL_SLOTS + """ SELECT TS(window_id) AS window_id, template_id, B(scenario_id) AS scenario_id, slot, B(a) AS affected_count, B(v) AS valid_count, B(tr) AS transitions, action,
    CASE WHEN action <> 'RESOLVE' AND a >= 3 AND a = v THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM acted WHERE action IS NOT NULL""")
def slot_cohort(t):
    return E.slot_cohort(slot_pairs(t)).select(
        ts_text("window_id").alias("window_id"), "template_id", big("scenario_id").alias("scenario_id"), "slot", "affected_count", "valid_count", "transitions", "action", "severity"
    )


@query("slot_pending", SQL_SLOTS + """ SELECT B(snapshot_id) AS snapshot_id, slot FROM s WHERE NOT present AND previous_present
    AND (window_id, template_id) NOT IN (SELECT (window_id, template_id) FROM acted WHERE action IS NOT NULL)""")
def slot_pending(t):
    base = slot_pairs(t)
    # A window is one month of one country here.
    scope = F.concat_ws(":", ts_text("window_id"), C("template_id").cast("string"))
    code = F.lit("GPT_EXPECTED_SLOT_MISSING").alias("code")
    pending = base.where(~C("present") & C("previous_present")).select("snapshot_id", "slot", scope.alias("window_id"), code)
    cohort = E.slot_cohort(base).select(scope.alias("window_id"), code)
    return E.pending_without_cohort(pending, cohort).select("snapshot_id", "slot")


@query(
    "candidate_union",
    SQL_SLOTS + """, loc AS (SELECT strftime(window_id, '%Y-%m') AS w, slot, min(snapshot_id) AS position FROM s WHERE NOT present GROUP BY 1, 2),
    coh AS (SELECT strftime(window_id, '%Y-%m') AS w, slot, min(template_id) AS position FROM acted WHERE action IS NOT NULL GROUP BY 1, 2)
    SELECT coalesce(l.w, c.w) AS window_month, coalesce(l.slot, c.slot) AS slot, CASE WHEN l.w IS NOT NULL THEN 0 ELSE 1 END AS section, B(coalesce(l.position, c.position)) AS position
    FROM loc l FULL JOIN coh c ON c.w = l.w AND c.slot = l.slot""",
)
def candidate_union(t):
    base = slot_pairs(t)
    month = F.date_format("window_id", "yyyy-MM").alias("window_month")
    local = base.where(~C("present")).select(month, "slot", C("snapshot_id").alias("position"))
    cohort = E.slot_cohort(base).select(month, "slot", C("template_id").alias("position"))
    return E.candidate_union(local, cohort, ["window_month", "slot"])


def _sql_lifecycle(source: str, keys: str, order: str, weight: str = "1") -> str:
    """A plain fold, one row of every key at a time."""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn,
            run_id IS DISTINCT FROM lag(run_id) OVER (PARTITION BY {keys} ORDER BY {order}) AS fresh FROM {source}),
    f AS (SELECT n.*, action = 'UPSERT' AS active, CASE WHEN action = 'UPSERT' THEN 1 ELSE 0 END AS episode, action = 'UPSERT' AS counted, false AS closed FROM n WHERE rn = 1
      UNION ALL SELECT n.*, CASE WHEN f.active THEN NOT (n.fresh AND n.action = 'RESOLVE') ELSE n.action = 'UPSERT' END,
        f.episode + CASE WHEN NOT f.active AND n.action = 'UPSERT' THEN 1 ELSE 0 END,
        CASE WHEN f.active THEN n.fresh AND n.action <> 'RESOLVE' ELSE n.action = 'UPSERT' END, f.active AND n.fresh AND n.action = 'RESOLVE'
        FROM f JOIN n ON n.rn = f.rn + 1 AND {" AND ".join(f"n.{k.strip()} = f.{k.strip()}" for k in keys.split(","))}),
    ep AS (SELECT {keys}, B(episode) AS episode, min(at) FILTER (counted) AS detected_at, max(at) FILTER (closed) AS ended_at,
        ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) FILTER (counted)] AS severity,
        B(sum({weight}) FILTER (counted)) AS supporting_count, B(max(affected_count) FILTER (counted)) AS affected_count,
        B(max(valid_count) FILTER (counted)) AS valid_count FROM f WHERE counted OR closed GROUP BY {keys}, episode)"""


@query("condition_lifecycle", "WITH RECURSIVE " + _sql_lifecycle("{actions}", "condition_key", "at, run_id, seq") + """
    SELECT B(condition_key) AS condition_key, episode, TS(detected_at) AS detected_at, TS(ended_at) AS ended_at, severity, supporting_count, affected_count, valid_count,
        CASE WHEN affected_count >= 2 THEN 2 ELSE 1 END AS blast_radius, CASE WHEN ended_at IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS status FROM ep""")
def condition_lifecycle(t):
    return E.condition_lifecycle(t.actions, ["condition_key"], ["at", "run_id", "seq"]).select(
        "condition_key", "episode", ts_text("detected_at").alias("detected_at"), ts_text("ended_at").alias("ended_at"), "severity", "supporting_count", "affected_count",
        "valid_count", "blast_radius", "status",
    )


@query("exclusive_conditions", """WITH RECURSIVE a AS (SELECT *, 1 AS seq FROM {adsactions} UNION ALL SELECT site, at, run_id, k AS code, 'RESOLVE', severity, affected_count, valid_count, 0
        FROM {adsactions}, (VALUES ('ADS_TXT_MISSING'), ('ADS_TXT_EMPTY_200'), ('ADS_TXT_INVALID')) AS c(k) WHERE action = 'UPSERT' AND k <> code), """
    + _sql_lifecycle("a", "site, code", "at, run_id, seq") + """
    SELECT B(site) AS site, code, episode, TS(detected_at) AS detected_at, TS(ended_at) AS ended_at, supporting_count FROM ep""")
def exclusive_conditions(t):
    return E.exclusive_conditions(t.adsactions, ["site"]).select(
        "site", "code", "episode", ts_text("detected_at").alias("detected_at"), ts_text("ended_at").alias("ended_at"), "supporting_count"
    )


SQL_RELIABLE = """s AS (SELECT *, last_value(CASE WHEN state <> 'OK' THEN {'at': at, 'run_id': run_id} END IGNORE NULLS) OVER (PARTITION BY site ORDER BY at, run_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM {observations}),
    rec AS (SELECT site, open.run_id AS degraded_run, open.at AS degraded_at, min({'at': at, 'run_id': run_id}) AS f FROM s WHERE state = 'OK' AND at > open.at GROUP BY 1, 2, 3)"""


@query("reliability_episodes", "WITH " + SQL_RELIABLE + """ SELECT B(site) AS site, B(degraded_run) AS degraded_run, TS(degraded_at) AS degraded_at, B(f.run_id) AS recovered_run,
    TS(f.at) AS recovered_at FROM rec""")
def reliability_episodes(t):
    return E.reliability_recoveries(t.observations, ["site"]).select(
        big("site").alias("site"), "degraded_run", ts_text("degraded_at").alias("degraded_at"), "recovered_run", ts_text("recovered_at").alias("recovered_at")
    )


@query("reliability_current", "WITH " + SQL_RELIABLE + """, ev AS (SELECT site, at, run_id, CASE state WHEN 'CHALLENGE' THEN 'BROWSER_ACCESS_CHALLENGE_SUSPECTED' ELSE 'BROWSER_SOURCE_DEGRADED' END AS code
        FROM {observations} WHERE state <> 'OK' UNION ALL SELECT site, f.at, f.run_id, 'BROWSER_SOURCE_RECOVERED' FROM rec)
    SELECT B(site) AS site, code, TS(at) AS at, CASE WHEN code = 'BROWSER_SOURCE_RECOVERED' THEN 'HEALTHY' ELSE 'DEGRADED' END AS state FROM ev
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY at DESC, run_id DESC) = 1""")
def reliability_current(t):
    events = E.reliability_events(t.observations, ["site"])
    return E.reliability_current(events, ["site"]).select(big("site").alias("site"), "code", ts_text("at").alias("at"), "state")


@query("health_trigger", """SELECT B(o.run_id) AS event_id, o.state, B(f.src) AS trigger_source FROM {observations} o LEFT JOIN (SELECT event_id, arg_min(source_id, ref_id) AS src
    FROM {refs} WHERE relation <> 'SUPPORTING' GROUP BY 1) f ON f.event_id = o.run_id""")
def health_trigger(t):
    return E.health_trigger(t.observations.withColumnRenamed("run_id", "event_id"), t.refs).select("event_id", "state", "trigger_source")


@query("evidence_integrity", """SELECT B(r.event_id) AS event_id, B(r.ref_id) AS ref_id, CASE WHEN u.run_id IS NULL THEN 'RUN_NOT_FOUND' WHEN o.o_custkey % 5 <> u.site THEN 'SITE_MISMATCH' ELSE 'SCENARIO_MISMATCH' END AS reason
    FROM {refs} r JOIN orders o ON o.o_orderkey = r.event_id LEFT JOIN {runs} u ON u.run_id = r.source_id WHERE u.run_id IS NULL OR o.o_custkey % 5 <> u.site OR o.o_orderkey % 2 <> u.scenario_id""")
def evidence_integrity(t):
    owned = t.orders.select(C("o_orderkey").alias("event_id"), (C("o_custkey") % 5).alias("site"), (C("o_orderkey") % 2).alias("scenario_id"))
    return E.evidence_integrity(owned, t.refs, t.runs).select("event_id", "ref_id", "reason")
