"""Source health, operations, budgets and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogs import DRILLDOWNS_PER_CONNECTION_DAY, DRILLDOWNS_PER_INVESTIGATION
from tidemark.functions.shape import big, r6, ts_text
from tidemark.operators import events as E
from tidemark.operators import health as H
from tidemark.operators import retention as R
from tidemark.plans.event_queries import SQL_RELIABLE
from tidemark.plans.registry import query

C = F.col
NOW_2024, NOW_1998 = "2024-01-30 00:00:00", "1998-01-01 00:00:00"


def _ts(text):
    return F.lit(text).cast("timestamp")


def sql_fresh(ts: str, hours: str, now: str = NOW_2024) -> str:
    return f"CASE WHEN {ts} IS NULL THEN 'UNKNOWN' WHEN epoch(TIMESTAMP '{now}') - epoch({ts}) > {hours} * 3600 THEN 'STALE' ELSE 'HEALTHY' END"


SQL_HOURS = "CASE provider WHEN 'GSC' THEN 12 ELSE 6 END"


@query("source_freshness", f"""SELECT B(site) AS site, source, {sql_fresh('last', '6')} AS state FROM (SELECT e.site, e.source, max(e.retrieved_at) FILTER (e.status = 'COMPLETE') AS last
    FROM {{extracts}} e GROUP BY 1, 2)""")
def source_freshness(t):
    last = t.extracts.groupBy("site", "source").agg(F.max(F.when(C("status") == "COMPLETE", C("retrieved_at"))).alias("last"))
    return last.select(big("site").alias("site"), "source", H.freshness_state(C("last"), _ts(NOW_2024), H.threshold_hours(C("source"))).alias("state"))


SQL_CONN = f"CASE status WHEN 'CONNECTED' THEN {sql_fresh('last_success_at', SQL_HOURS)} WHEN 'DEGRADED' THEN 'DEGRADED' WHEN 'AUTH_EXPIRED' THEN 'ACTION_REQUIRED' ELSE 'BLOCKED' END"


@query("connector_health", f"SELECT B(connection_id) AS connection_id, provider, {SQL_CONN} AS health FROM {{connections}}")
def connector_health(t):
    return H.connector_health(t.connections, _ts(NOW_2024)).select("connection_id", "provider", "health")


@query("latest_per_site", """SELECT B(site) AS site, B(run_id) AS run_id, status FROM {runs} WHERE observation_kind = 'SCHEDULED'
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY completed_at DESC NULLS FIRST, run_id DESC) = 1""")
def latest_per_site(t):
    return H.latest_scheduled_run(t.runs, "completed_at").select(big("site").alias("site"), "run_id", "status")


SQL_USE = """once AS (SELECT scope, resource_kind, usage_key, arg_min(amount, {'a': occurred_at, 'b': entry_id}) AS amount FROM {ledger} GROUP BY 1, 2, 3),
    used AS (SELECT scope, resource_kind, B(sum(amount)) AS used, CASE resource_kind WHEN 'DIAGNOSTIC_RUN' THEN 8 ELSE 4 END AS "limit" FROM once GROUP BY 1, 2)"""


@query("usage_ledger", "WITH " + SQL_USE + """ SELECT scope, resource_kind, used, "limit", used >= "limit" AS breaker_open FROM used""")
def usage_ledger(t):
    return H.usage_ledger(t.ledger)


@query(
    "source_health_matrix",
    "WITH " + SQL_RELIABLE + ", " + SQL_USE + f""",
    ev AS (SELECT site, at, run_id, 'DEGRADED' AS state FROM {{observations}} WHERE state <> 'OK' UNION ALL SELECT site, f.at, f.run_id, 'HEALTHY' FROM rec),
    rel AS (SELECT site, arg_max(state, {{'a': at, 'b': run_id}}) AS state FROM ev GROUP BY 1),
    lw AS (SELECT site, max(window_start) AS window_start FROM {{ledger}} GROUP BY 1),
    br AS (SELECT lw.site, used >= "limit" AS breaker_open FROM lw JOIN used u ON u.scope = concat(lw.site::VARCHAR, '|', lw.window_start::VARCHAR) AND u.resource_kind = 'CHECKPOINT_RUN'),
    run AS (SELECT site, status, completed_at FROM {{runs}} WHERE observation_kind = 'SCHEDULED' QUALIFY row_number() OVER (PARTITION BY site ORDER BY completed_at DESC, run_id DESC) = 1),
    con AS (SELECT site, provider, {SQL_CONN} AS health FROM {{connections}} QUALIFY row_number() OVER (PARTITION BY site, provider ORDER BY connection_id DESC) = 1),
    cfg AS (SELECT site, max(observed_at) AS observed_at FROM {{configs}} WHERE fetch_kind = 'SCHEDULED' AND parse_status IN ('VALID', 'VALID_WITH_WARNINGS') GROUP BY 1),
    sites AS (SELECT DISTINCT site FROM {{configs}})
    SELECT B(s.site) AS site, CASE WHEN rel.state = 'DEGRADED' THEN 'DEGRADED' WHEN br.breaker_open THEN 'BLOCKED' WHEN run.status IS NULL THEN 'UNKNOWN'
        WHEN epoch(TIMESTAMP '{NOW_2024}') - epoch(run.completed_at) > 7 * 3600 THEN 'STALE' WHEN run.status = 'COMPLETE' THEN 'HEALTHY' WHEN run.status = 'PARTIAL' THEN 'DEGRADED' ELSE 'UNAVAILABLE' END AS BROWSER_MONITORING,
        coalesce((SELECT health FROM con WHERE con.site = s.site AND provider = 'GA4'), 'UNKNOWN') AS GA4, coalesce((SELECT health FROM con WHERE con.site = s.site AND provider = 'GSC'), 'UNKNOWN') AS GSC,
        coalesce((SELECT health FROM con WHERE con.site = s.site AND provider = 'GAM'), 'UNKNOWN') AS GAM, {sql_fresh('cfg.observed_at', '18')} AS PUBLIC_CONFIG
    FROM sites s LEFT JOIN rel ON rel.site = s.site LEFT JOIN br ON br.site = s.site LEFT JOIN run ON run.site = s.site LEFT JOIN cfg ON cfg.site = s.site""",
)
def source_health_matrix(t):
    reliability = E.reliability_current(E.reliability_events(t.observations, ["site"]), ["site"])
    latest = t.ledger.groupBy("site").agg(F.max_by("scope", "window_start").alias("scope"))
    usage = H.usage_ledger(t.ledger).where(C("resource_kind") == "CHECKPOINT_RUN").join(latest, "scope")
    sites = t.configs.select("site").distinct()
    return H.source_health_matrix(sites, t.runs, reliability, usage, t.connections, t.configs, _ts(NOW_2024)).withColumn("site", big("site"))


@query(
    "retention_health",
    f"""WITH r AS (SELECT tenant, arg_max({{'s': started_at, 'f': finished_at}}, {{'a': started_at, 'b': run_id}}) AS r FROM {{retention_runs}} GROUP BY 1),
    j AS (SELECT tenant, max(finished_at) AS failed_at FROM {{jobs}} WHERE status = 'FAILED' AND epoch(TIMESTAMP '{NOW_1998}') - epoch(finished_at) <= 172800 GROUP BY 1)
    SELECT B(coalesce(r.tenant, j.tenant)) AS tenant, CASE WHEN r.r IS NOT NULL AND r.r.f IS NULL AND epoch(TIMESTAMP '{NOW_1998}') - epoch(r.r.s) > 21600 THEN 'STALLED'
        WHEN failed_at IS NOT NULL AND (r.r.f IS NULL OR failed_at > r.r.f) THEN 'FAILED' WHEN epoch(TIMESTAMP '{NOW_1998}') - epoch(r.r.f) <= 172800 THEN 'HEALTHY' ELSE 'MISSED' END AS state,
        TS(r.r.s) AS last_started_at, TS(r.r.f) AS last_finished_at FROM r FULL JOIN j ON r.tenant = j.tenant""",
)
def retention_health(t):
    return H.retention_health(t.retention_runs, t.jobs, ["tenant"], _ts(NOW_1998)).select(
        "tenant", "state", ts_text("last_started_at").alias("last_started_at"), ts_text("last_finished_at").alias("last_finished_at")
    )


@query(
    "ops_stats",
    f"""WITH n AS (SELECT *, epoch(TIMESTAMP '{NOW_1998}') AS now, epoch(TIMESTAMP '{NOW_1998}') - epoch(finished_at) <= 90 * 86400 AS recent FROM {{jobs}}),
    a AS (SELECT count(*) FILTER (status = 'PENDING') AS runnable, count(*) FILTER (status = 'RUNNING' AND coalesce(epoch(lock_expires_at) > now, false)) AS leased,
        count(*) FILTER (status = 'RUNNING' AND NOT coalesce(epoch(lock_expires_at) > now, false)) AS stale, count(*) FILTER (status = 'COMPLETE' AND recent) AS completed,
        count(*) FILTER (status = 'FAILED' AND recent) AS failed, sum(greatest(0, floor(epoch(finished_at) - epoch(started_at)))) FILTER (status IN ('COMPLETE', 'FAILED') AND recent) AS total,
        count(started_at) FILTER (status IN ('COMPLETE', 'FAILED') AND recent) AS timed, max(greatest(0, floor(epoch(finished_at) - epoch(started_at)))) FILTER (status IN ('COMPLETE', 'FAILED') AND recent) AS longest,
        max(started_at) FILTER (epoch(started_at) <= now) AS last, any_value(now) AS now FROM n)
    SELECT B(runnable) AS runnable, B(leased) AS leased, B(stale) AS stale_leases, B(completed) AS completed, B(failed) AS failed, round(failed / (completed + failed), 4) AS failure_rate,
        B(floor(total / timed)) AS avg_duration_s, B(longest) AS max_duration_s, B(now - epoch(last)) AS worker_age_s, CASE WHEN now - epoch(last) <= 48 * 3600 THEN 'CURRENT' ELSE 'STALE' END AS worker_state FROM a""",
)
def ops_stats(t):
    return H.ops_stats(t.jobs, _ts(NOW_1998), window_h=90 * 24)


@query("duration_percentiles", """SELECT status, B(count(*)) AS runs, max(duration_s) AS max_s, B(count(*) FILTER (attempts > 1)) AS retried, round(quantile_cont(duration_s, 0.5), 6) AS p50_s,
    round(quantile_cont(duration_s, 0.95), 6) AS p95_s FROM {runs} GROUP BY 1""")
def duration_percentiles(t):
    return H.duration_percentiles(t.runs, 10.0).withColumn("p50_s", r6("p50_s")).withColumn("p95_s", r6("p95_s"))


@query("resource_peaks", """WITH c AS (SELECT snapshot, container, max(l_quantity) AS peak, sum(l_quantity) AS mib, sum(cpu_pct) AS cpu FROM {samples} GROUP BY 1, 2)
    SELECT container, max(peak) AS peak_mib, round(max(cpu), 6) AS peak_cpu FROM c GROUP BY 1
    UNION ALL SELECT '(all)', max(m), round(max(p), 6) FROM (SELECT snapshot, sum(mib) AS m, sum(cpu) AS p FROM c GROUP BY 1)""")
def resource_peaks(t):
    return H.resource_peaks(t.samples).withColumn("peak_cpu", r6("peak_cpu"))


@query("open_incident_count", "SELECT tenant, B(count(*)) AS open_incidents FROM {incidents} WHERE status IN ('OPEN', 'INVESTIGATING') GROUP BY 1")
def open_incident_count(t):
    return H.open_incident_count(t.incidents)


@query("drilldown_budget", f"""WITH RECURSIVE once AS (SELECT connection_id, investigation_id, request_key, min(seq) AS seq, arg_min(day, seq) AS day FROM {{requests}} GROUP BY 1, 2, 3),
    n AS (SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY seq) AS rn FROM once),
    f AS (SELECT n.*, 'ACCEPTED' AS verdict, [{{'i': investigation_id, 'd': day}}] AS used FROM n WHERE rn = 1
      UNION ALL SELECT connection_id, investigation_id, request_key, seq, day, rn, verdict, CASE WHEN verdict = 'ACCEPTED' THEN list_append(used, {{'i': investigation_id, 'd': day}}) ELSE used END
        FROM (SELECT n.*, f.used, CASE WHEN len(list_filter(f.used, lambda x: x.i = n.investigation_id)) >= {DRILLDOWNS_PER_INVESTIGATION} THEN 'INVESTIGATION_BUDGET_EXCEEDED'
            WHEN len(list_filter(f.used, lambda x: x.d = n.day)) >= {DRILLDOWNS_PER_CONNECTION_DAY} THEN 'DAILY_BUDGET_EXCEEDED' ELSE 'ACCEPTED' END AS verdict
          FROM f JOIN n ON n.connection_id = f.connection_id AND n.rn = f.rn + 1))
    SELECT connection_id, investigation_id, request_key, seq, day, verdict FROM f""")
def drilldown_budget(t):
    return H.drilldown_budget(t.requests)


@query("diagnostic_results", """SELECT B(r.site) AS site, B(r.run_id) AS run_id, B(a.artifact_id) AS artifact_id, a.artifact_type FROM (SELECT * FROM {runs} WHERE observation_kind = 'DIAGNOSTIC'
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY completed_at DESC, run_id DESC) = 1) r LEFT JOIN {artifacts} a ON a.run_id = r.run_id""")
def diagnostic_results(t):
    return H.diagnostic_results(t.runs, t.artifacts).select(big("site").alias("site"), "run_id", "artifact_id", "artifact_type")


SQL_ELIGIBLE = f"""eligible AS (SELECT * FROM {{artifacts}} WHERE retention_class = 'RAW_MEDIUM' AND artifact_type <> 'HAR_LOG'
    AND created_at <= TIMESTAMP '{NOW_1998}' - INTERVAL '1' DAY * CASE artifact_type WHEN 'RAW_DOM' THEN 30 ELSE 90 END),
    held AS (SELECT DISTINCT artifact_id FROM {{holds}} WHERE released_at IS NULL)"""


@query("retention_eligible", "WITH " + SQL_ELIGIBLE + " SELECT B(artifact_id) AS artifact_id, artifact_type FROM eligible")
def retention_eligible(t):
    return R.retention_eligible(t.artifacts, _ts(NOW_1998)).select("artifact_id", "artifact_type")


@query("hold_filter", "WITH " + SQL_ELIGIBLE + " SELECT B(artifact_id) AS artifact_id, artifact_id IN (SELECT artifact_id FROM held) AS is_held FROM eligible")
def hold_filter(t):
    free, held = R.hold_filter(R.retention_eligible(t.artifacts, _ts(NOW_1998)), t.holds)
    return free.select("artifact_id", F.lit(False).alias("is_held")).unionByName(held.select("artifact_id", F.lit(True).alias("is_held")))


@query("retention_order", "WITH " + SQL_ELIGIBLE + " SELECT B(artifact_id) AS artifact_id, TS(created_at) AS created_at FROM eligible WHERE artifact_id NOT IN (SELECT artifact_id FROM held)")
def retention_order(t):
    free, _ = R.hold_filter(R.retention_eligible(t.artifacts, _ts(NOW_1998)), t.holds)
    return R.retention_order(free).select("artifact_id", ts_text("created_at").alias("created_at"))


@query("retention_audit", "WITH " + SQL_ELIGIBLE + """ SELECT artifact_type, B(count(*)) AS eligible, B(count(h.artifact_id)) AS held, B(count(*) - count(h.artifact_id)) AS deletable
    FROM eligible e LEFT JOIN held h ON h.artifact_id = e.artifact_id GROUP BY 1""")
def retention_audit(t):
    return R.retention_audit(t.artifacts, t.holds, _ts(NOW_1998))
