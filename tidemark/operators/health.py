"""Source health, operational signals and budgets.  ``now`` is always given, never the clock."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.catalogs import (
    BROWSER_STALE_HOURS,
    DRILLDOWNS_PER_CONNECTION_DAY,
    DRILLDOWNS_PER_INVESTIGATION,
    FRESHNESS_HOURS,
    HEALTHY_CONFIG_STATUSES,
    OPEN_INCIDENT_STATUSES,
    RESOURCE_LIMITS,
)
from tidemark.functions.numbers import mem_to_mib
from tidemark.functions.shape import either
from tidemark.operators.ordered import exact_percentiles, first_per_key, ordinal, top_n

HOUR_S = 3600


def _age_s(now: Column, moment: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(moment)) / F.lit(1e6)


def freshness_state(last_success: Column, now: Column, hours: Column) -> Column:
    """UNKNOWN without a success, STALE past the threshold; the boundary itself is HEALTHY."""
    return either(
        (last_success.isNull(), "UNKNOWN"), (_age_s(now, last_success) > hours * HOUR_S, "STALE"), otherwise="HEALTHY"
    )


def threshold_hours(source: Column) -> Column:
    return either(*[(source == name, F.lit(hours)) for name, hours in FRESHNESS_HOURS.items()])


# --- fixed values: connection status to health ---------------------------------------------
CONNECTION_HEALTH = {
    "CONNECTED": "HEALTHY",
    "DEGRADED": "DEGRADED",
    "AUTH_EXPIRED": "ACTION_REQUIRED",
    "PERMISSION_ERROR": "BLOCKED",
}


def connector_health(connections: DataFrame, now: Column) -> DataFrame:
    """Explicit connection states win; freshness only refines an otherwise healthy one."""
    mapped = either(*[(F.col("status") == k, v) for k, v in CONNECTION_HEALTH.items()], otherwise="UNKNOWN")
    fresh = freshness_state(F.col("last_success_at"), now, threshold_hours(F.upper("provider")))
    return connections.withColumn("health", F.when(mapped == "HEALTHY", fresh).otherwise(mapped))


def latest_scheduled_run(runs: DataFrame, order: str = "started_at") -> DataFrame:
    """Latest scheduled run per site that really observed something; null starts come first."""
    real = runs.where((F.col("observation_kind") == "SCHEDULED") & (F.col("status") != "SKIPPED"))
    return first_per_key(real, ["site"], [F.col(order).desc_nulls_first(), F.col("run_id").desc()])


def latest_healthy_config(snapshots: DataFrame) -> DataFrame:
    good = snapshots.where(
        (F.col("fetch_kind") == "SCHEDULED") & F.col("parse_status").isin(*HEALTHY_CONFIG_STATUSES)
    )
    return good.groupBy("site").agg(F.max("observed_at").alias("observed_at"))


def usage_ledger(ledger: DataFrame) -> DataFrame:
    """Used amount, limit and breaker per scope and kind; a usage key counts once, first entry wins."""
    once = ledger.groupBy("scope", "resource_kind", "usage_key").agg(
        F.min_by("amount", F.struct("occurred_at", "entry_id")).alias("amount")
    )
    limit = either(*[(F.col("resource_kind") == k, F.lit(v)) for k, v in RESOURCE_LIMITS.items()])
    return once.groupBy("scope", "resource_kind").agg(F.sum("amount").alias("used")).withColumn("limit", limit).withColumn(
        "breaker_open", F.col("used") >= F.col("limit")
    )


def source_health_matrix(
    sites: DataFrame, runs: DataFrame, reliability: DataFrame, usage: DataFrame, connections: DataFrame,
    snapshots: DataFrame, now: Column,
) -> DataFrame:
    """Five source states per site.

    Browser precedence: open degradation, then open breaker of the latest window, then the latest run.
    """
    latest = latest_scheduled_run(runs, "completed_at").select("site", F.col("status").alias("run_status"), "completed_at")
    run_state = either(
        (F.col("run_status").isNull() | F.col("completed_at").isNull(), "UNKNOWN"),
        (_age_s(now, F.col("completed_at")) > BROWSER_STALE_HOURS * HOUR_S, "STALE"),
        (F.col("run_status") == "COMPLETE", "HEALTHY"),
        (F.col("run_status") == "PARTIAL", "DEGRADED"),
        otherwise="UNAVAILABLE",
    )
    # One connection per site and source decides: the newest.
    chosen = first_per_key(connections, ["site", "provider"], [F.col("connection_id").desc()])
    by_source = connector_health(chosen, now).groupBy("site").agg(
        *[F.max(F.when(F.upper("provider") == s, F.col("health"))).alias(s) for s in ("GA4", "GSC", "GAM")]
    )
    browser = either(
        (F.col("reliability_state") == "DEGRADED", "DEGRADED"),
        (F.coalesce("breaker_open", F.lit(False)), "BLOCKED"),
        otherwise=run_state,
    )
    return (
        sites.join(latest, "site", "left")
        .join(reliability.select("site", F.col("state").alias("reliability_state")), "site", "left")
        .join(usage.select("site", "breaker_open"), "site", "left")
        .join(by_source, "site", "left")
        .join(latest_healthy_config(snapshots), "site", "left")
        .select(
            "site", browser.alias("BROWSER_MONITORING"),
            *[F.coalesce(s, F.lit("UNKNOWN")).alias(s) for s in ("GA4", "GSC", "GAM")],
            freshness_state(F.col("observed_at"), now, F.lit(FRESHNESS_HOURS["PUBLIC_CONFIG"])).alias("PUBLIC_CONFIG"),
        )
    )


EXPECTED_DAYS, STALL_HOURS = 2, 6


def retention_health(runs: DataFrame, jobs: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """STALLED, FAILED, HEALTHY or MISSED from the newest run and the newest recent failure."""
    newest = runs.groupBy(*keys).agg(
        F.max_by(F.struct("run_id", "started_at", "finished_at"), F.struct("started_at", "run_id")).alias("r")
    )
    failed = jobs.where(
        (F.col("status") == "FAILED") & (_age_s(now, F.col("finished_at")) <= EXPECTED_DAYS * 86_400)
    ).groupBy(*keys).agg(F.max("finished_at").alias("failed_at"))
    done, started = F.col("r.finished_at"), F.col("r.started_at")
    state = either(
        (F.col("r").isNotNull() & done.isNull() & (_age_s(now, started) > STALL_HOURS * HOUR_S), "STALLED"),
        (F.col("failed_at").isNotNull() & (done.isNull() | (F.col("failed_at") > done)), "FAILED"),
        (_age_s(now, done) <= EXPECTED_DAYS * 86_400, "HEALTHY"),
        otherwise="MISSED",
    )
    return newest.join(failed, keys, "full_outer").select(
        *keys, state.alias("state"), started.alias("last_started_at"), done.alias("last_finished_at")
    )


def operational_state(moment: Column, now: Column, max_age_h: int) -> Column:
    age = _age_s(now, moment)
    return either((moment.isNull(), "UNKNOWN"), (age < -300, "UNKNOWN"), (age <= max_age_h * HOUR_S, "CURRENT"), otherwise="STALE")


def ops_stats(jobs: DataFrame, now: Column, window_h: int = 24, max_idle_h: int = 48) -> DataFrame:
    """Queue depth, leases, failure rate and durations in one pass over the job log."""
    status, finished = F.col("status"), F.col("finished_at")
    recent = _age_s(now, finished) <= window_h * HOUR_S
    complete, failed = (status == "COMPLETE") & recent, (status == "FAILED") & recent
    spent = F.when(
        (complete | failed) & F.col("started_at").isNotNull(),
        F.greatest(F.lit(0), F.floor((F.unix_micros(finished) - F.unix_micros("started_at")) / 1e6)).cast("bigint"),
    )
    live = F.col("lock_expires_at") > now
    row = jobs.agg(
        F.count_if(status.isin("PENDING", "RETRY")).alias("runnable"),
        F.count_if((status == "RUNNING") & F.coalesce(live, F.lit(False))).alias("leased"),
        F.count_if((status == "RUNNING") & ~F.coalesce(live, F.lit(False))).alias("stale_leases"),
        F.count_if(complete).alias("completed"),
        F.count_if(failed).alias("failed"),
        F.sum(spent).alias("_total"), F.count(spent).alias("_timed"), F.max(spent).alias("max_duration_s"),
        F.max(F.when(F.col("started_at") <= now, F.col("started_at"))).alias("last_started"),
    )
    finished_jobs = F.col("completed") + F.col("failed")
    return row.select(
        "runnable", "leased", "stale_leases", "completed", "failed",
        F.when(finished_jobs > 0, F.round(F.col("failed") / finished_jobs, 4)).alias("failure_rate"),
        F.when(F.col("_timed") > 0, F.floor(F.col("_total") / F.col("_timed"))).alias("avg_duration_s"),
        "max_duration_s",
        F.when(F.col("last_started").isNotNull(), F.greatest(F.lit(0), F.floor(_age_s(now, F.col("last_started"))))).cast("bigint").alias("worker_age_s"),
        operational_state(F.col("last_started"), now, max_idle_h).alias("worker_state"),
    )


def duration_percentiles(runs: DataFrame, width_s: float = 1.0) -> DataFrame:
    """Count, p50, p95, maximum and retried attempts per run status."""
    sizes = runs.groupBy("status").agg(
        F.count("*").alias("runs"), F.max("duration_s").alias("max_s"), F.count_if(F.col("attempts") > 1).alias("retried")
    )
    points = exact_percentiles(runs, ["status"], "duration_s", {"p50_s": 0.5, "p95_s": 0.95}, width_s)
    return sizes.join(points.drop("values"), "status", "left")


def resource_peaks(samples: DataFrame) -> DataFrame:
    """Memory peak per container, and the peak over snapshots of the sum of all containers.

    Samples: snapshot, container, memory text, cpu_pct.
    """
    read = samples.withColumn("mib", mem_to_mib(F.col("memory")))
    # Containers are few per snapshot; the first step already folds repeated samples.
    cells = read.groupBy("snapshot", "container").agg(F.max("mib").alias("peak"), F.sum("mib").alias("mib"), F.sum("cpu_pct").alias("cpu"))
    per = cells.groupBy("container").agg(F.max("peak").alias("peak_mib"), F.max("cpu").alias("peak_cpu"))
    whole = cells.groupBy("snapshot").agg(F.sum("mib").alias("mib"), F.sum("cpu").alias("cpu")).agg(
        F.max("mib").alias("peak_mib"), F.max("cpu").alias("peak_cpu")
    )
    return per.unionByName(whole.withColumn("container", F.lit("(all)")))


def open_incident_count(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("status").isin(*OPEN_INCIDENT_STATUSES)).groupBy("tenant").agg(F.count("*").alias("open_incidents"))


def drilldown_budget(requests: DataFrame, bucket_width: int = 1_000_000) -> DataFrame:
    """Accept or refuse each distinct request in arrival order under both budgets.

    Requests: connection_id, investigation_id, request_key, seq, day; seq grows with the day.  A
    refused request uses no budget, so acceptance is a fold over a connection.  What can be
    accepted is cut down first, exactly: a fifth request of one investigation on one day never
    passes, and before the d-th day of a connection at most 2(d - 1) investigations can be used
    up, each holding back at most four requests of that day, so only the first 8 + 8(d - 1) of
    them can matter.  The fold then reads a number of rows per connection that depends on its
    days alone; all other requests are refused and get their reason by a join.
    """
    per_inv, per_day = DRILLDOWNS_PER_INVESTIGATION, DRILLDOWNS_PER_CONNECTION_DAY
    own, of_day = ["connection_id", "investigation_id"], ["connection_id", "day"]
    once = requests.groupBy(*own, "request_key").agg(F.min(F.struct("seq", "day")).alias("first")).select(
        *own, "request_key", F.col("first.seq").alias("seq"), F.col("first.day").alias("day")
    )
    few = top_n(once, [*own, "day"], [F.col("seq")], per_inv).drop("_rn")
    days = once.select(*of_day).distinct().withColumn("_d", F.row_number().over(Window.partitionBy("connection_id").orderBy("day")))
    placed = ordinal(few, of_day, ["seq"], "_no", F.floor(F.col("seq") / bucket_width)).join(days, of_day)
    few = placed.where(F.col("_no") <= per_day + per_day * (F.col("_d") - 1)).select(*once.columns)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        used: dict = {}
        days: dict = {}
        keep = []
        for investigation, day in zip(rows["investigation_id"], rows["day"]):
            fits = used.get(investigation, 0) < per_inv and days.get(day, 0) < per_day
            keep.append(fits)
            if fits:
                used[investigation] = used.get(investigation, 0) + 1
                days[day] = days.get(day, 0) + 1
        return rows[keep]

    accepted = few.groupBy("connection_id").applyInPandas(fold, few.schema)
    spent = accepted.groupBy(*own).agg(F.max("seq").alias("last_seq"), F.count("*").alias("passed"))
    verdict = either(
        (F.col("_ok"), "ACCEPTED"),
        ((F.col("passed") >= per_inv) & (F.col("last_seq") < F.col("seq")), "INVESTIGATION_BUDGET_EXCEEDED"),
        otherwise="DAILY_BUDGET_EXCEEDED",
    )
    marked = once.join(accepted.select(*own, "request_key", F.lit(True).alias("_ok")), [*own, "request_key"], "left")
    return marked.join(spent, own, "left").withColumn("verdict", verdict).drop("_ok", "last_seq", "passed")


def diagnostic_results(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Latest diagnostic run per site, one row per artifact (one row with nulls when there is none)."""
    latest = first_per_key(
        runs.where(F.col("observation_kind") == "DIAGNOSTIC"), ["site"], [F.col("completed_at").desc_nulls_first(), F.col("run_id").desc()]
    )
    return latest.join(artifacts, "run_id", "left")
