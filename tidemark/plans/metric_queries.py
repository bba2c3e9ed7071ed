"""Metric selection, alignment, ratios, lineage and movement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import catalogs
from tidemark.functions.shape import big, joined, r6, ts_text
from tidemark.operators import metrics as M
from tidemark.plans.lake import frame
from tidemark.plans.registry import query

START, END = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


frame(
    "roles",
    """
    SELECT * FROM (VALUES
      ('derived.requests_per_view_v1', 'NUMERATOR', 'gam.ad_requests'),
      ('derived.requests_per_view_v1', 'DENOMINATOR', 'ga4.screen_page_views'),
      ('derived.impressions_per_view_v1', 'NUMERATOR', 'gam.ad_server_impressions'),
      ('derived.impressions_per_view_v1', 'DENOMINATOR', 'ga4.screen_page_views')
    ) AS t(ratio_code, role, metric_code)
    """,
)
# SQL twins only: the flagship and what hangs on it.
SQL_BEST = """
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period_start, period_end
        ORDER BY CASE freshness WHEN 'MATURE' THEN 2 WHEN 'PRELIMINARY' THEN 1 ELSE 0 END DESC,
        retrieved_at DESC, point_id DESC) AS rn FROM {points}) WHERE rn = 1)"""
SQL_RATIO = SQL_BEST.replace("SELECT *, row_number()", "SELECT p.*, row_number()").replace("PARTITION BY series_id", "PARTITION BY p.series_id").replace("retrieved_at DESC", "p.retrieved_at DESC").replace(
    "FROM {points})", """FROM {points} p JOIN {series} s ON s.series_id = p.series_id AND s.site = p.site JOIN {extracts} e ON e.extract_id = p.extract_id AND e.site = p.site
        WHERE s.granularity = 'HOUR' AND e.status = 'COMPLETE')""") + """,
    tagged AS (SELECT b.*, r.ratio_code, r.role FROM best b JOIN {roles} r USING (metric_code)),
    agg AS (SELECT site, ratio_code, period_start, period_end,
        sum(CASE WHEN role = 'NUMERATOR' THEN value END) AS numerator,
        sum(CASE WHEN role = 'DENOMINATOR' THEN value END) AS denominator,
        count(*) FILTER (role = 'NUMERATOR') AS numerator_points, count(*) FILTER (role = 'DENOMINATOR') AS denominator_points,
        count(DISTINCT freshness) AS kinds, min(freshness) AS only_fresh,
        array_to_string(list_sort(list_distinct(flatten(list(list_filter([
            CASE WHEN sample_status = 'LIMITED' THEN 'SOURCE_POINT_LIMITED' END, lim_a, lim_b], lambda x: x IS NOT NULL))))), ',') AS limitations,
        sha256(concat_ws('|', count(*)::VARCHAR, bit_xor(H60(role || ':' || point_id))::VARCHAR,
            bit_xor(CAST('0x' || substr(md5(role || ':' || point_id), 16, 15) AS BIGINT))::VARCHAR)) AS input_fingerprint
        FROM tagged GROUP BY 1, 2, 3, 4),
    ratio AS (SELECT *, CASE WHEN numerator_points = 0 THEN 'MISSING_NUMERATOR' WHEN denominator_points = 0 THEN 'MISSING_DENOMINATOR'
        WHEN kinds <> 1 THEN 'INCOMPATIBLE_FRESHNESS' WHEN denominator <= 0 THEN 'ZERO_DENOMINATOR' ELSE 'OK' END AS alignment FROM agg),
    keyed AS (SELECT *, CASE WHEN alignment = 'OK' THEN numerator / denominator END AS value,
        CASE WHEN alignment = 'OK' THEN only_fresh END AS freshness,
        CASE WHEN alignment = 'OK' THEN sha256(concat_ws('|', site::VARCHAR, ratio_code, 'cross-source-v1', TS(period_start), TS(period_end),
            input_fingerprint)) END AS derivation_key FROM ratio)"""


def eligible(t):
    """What ratios may be derived from: hourly points of complete extracts."""
    return M.source_points(t.points, t.series, t.extracts)


def _ratios(t):
    return M.ratio_derive(eligible(t), catalogs.ratio_roles(t.spark))


@query(
    "ratio_derive",
    "WITH" + SQL_RATIO + """
    SELECT B(site) AS site, ratio_code, TS(period_start) AS period_start, TS(period_end) AS period_end, round(numerator, 6) AS numerator,
        round(denominator, 6) AS denominator, round(value, 6) AS value, alignment, freshness, limitations, input_fingerprint, derivation_key
    FROM keyed""",
)
def ratio_derive(t):
    return _ratios(t).select(
        big("site").alias("site"), "ratio_code", ts_text("period_start").alias("period_start"), ts_text("period_end").alias("period_end"),
        r6("numerator").alias("numerator"), r6("denominator").alias("denominator"), r6("value").alias("value"), "alignment", "freshness",
        joined("limitations").alias("limitations"), "input_fingerprint", "derivation_key",
    )


@query(
    "source_points",
    f"""SELECT B(p.point_id) AS point_id, B(p.site) AS site, p.series_id, p.source, round(p.value, 6) AS value FROM {{points}} p
    JOIN {{series}} s ON s.series_id = p.series_id AND s.site = p.site JOIN {{extracts}} e ON e.extract_id = p.extract_id AND e.site = p.site
    WHERE s.granularity = 'HOUR' AND e.status = 'COMPLETE' AND p.period_start >= TIMESTAMP '{START}' AND p.period_end <= TIMESTAMP '{END}'""",
)
def source_points(t):
    return M.source_points(t.points, t.series, t.extracts, _ts(START), _ts(END)).select(
        "point_id", big("site").alias("site"), "series_id", "source", r6("value").alias("value")
    )


@query(
    "match_definition",
    """SELECT ratio_code, role, B(site) AS site, B(count(*)) AS points, round(sum(value), 4) AS total
    FROM {points} JOIN {roles} USING (metric_code) GROUP BY ALL""",
)
def match_definition(t):
    tagged = M.match_definition(t.points, catalogs.ratio_roles(t.spark))
    return tagged.groupBy("ratio_code", "role", big("site").alias("site")).agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "point_series_extract",
    """SELECT s.granularity, s.unit, e.status AS extract_status, p.source, B(count(*)) AS points FROM {points} p
    JOIN {series} s ON s.series_id = p.series_id AND s.site = p.site JOIN {extracts} e ON e.extract_id = p.extract_id AND e.site = p.site
    GROUP BY ALL""",
)
def point_series_extract(t):
    return M.point_series_extract(t.points, t.series, t.extracts).groupBy("granularity", "unit", "extract_status", "source").agg(
        F.count("*").alias("points")
    )


@query("best_current", "WITH" + SQL_BEST + " SELECT series_id, TS(period_start) AS period_start, B(point_id) AS point_id, freshness FROM best")
def best_current(t):
    return M.best_current(t.points).select("series_id", ts_text("period_start").alias("period_start"), "point_id", "freshness")


@query(
    "interval_align",
    "WITH" + SQL_BEST + """,
    n AS (SELECT site, period_start, period_end, sum(value) AS v, min(freshness) AS lo, max(freshness) AS hi FROM best
          WHERE metric_code = 'gam.ad_requests' GROUP BY ALL),
    d AS (SELECT site, period_start, period_end, sum(value) AS v, min(freshness) AS lo, max(freshness) AS hi FROM best
          WHERE metric_code = 'ga4.screen_page_views' GROUP BY ALL)
    SELECT B(site) AS site, TS(period_start) AS period_start, round(n.v, 6) AS numerator, round(d.v, 6) AS denominator,
        CASE WHEN n.v IS NULL THEN 'MISSING_NUMERATOR' WHEN d.v IS NULL THEN 'MISSING_DENOMINATOR'
             WHEN least(n.lo, d.lo) <> greatest(n.hi, d.hi) THEN 'INCOMPATIBLE_FRESHNESS' WHEN d.v <= 0 THEN 'ZERO_DENOMINATOR' ELSE 'OK' END AS alignment
    FROM n FULL JOIN d USING (site, period_start, period_end)""",
)
def interval_align(t):
    best = M.best_current(t.points.where(F.col("metric_code").isin("gam.ad_requests", "ga4.screen_page_views")))
    side = lambda code: M.interval_sums(best.where(F.col("metric_code") == code))
    return M.interval_align(side("gam.ad_requests"), side("ga4.screen_page_views")).select(
        big("site").alias("site"), ts_text("period_start").alias("period_start"), r6("numerator").alias("numerator"),
        r6("denominator").alias("denominator"), "alignment",
    )


@query("skip_counts", "WITH" + SQL_RATIO + " SELECT ratio_code, alignment AS reason, B(count(*)) AS skipped FROM ratio WHERE alignment <> 'OK' GROUP BY ALL")
def skip_counts(t):
    return M.skip_counts(_ratios(t)).withColumnRenamed("count", "skipped")


@query(
    "limitation_union",
    """SELECT B(site) AS site, TS(date_trunc('day', period_start)) AS day, coalesce(array_to_string(list_sort(list_distinct(
        list(lim) FILTER (lim IS NOT NULL))), ','), '') AS limitations
    FROM (SELECT site, period_start, lim_a AS lim FROM {points} UNION ALL SELECT site, period_start, lim_b FROM {points}) GROUP BY ALL""",
)
def limitation_union(t):
    return t.points.groupBy(big("site").alias("site"), ts_text(F.date_trunc("day", "period_start")).alias("day")).agg(
        joined(M.limitation_union("limitations")).alias("limitations")
    )


@query(
    "derivation_key",
    "WITH" + SQL_RATIO + " SELECT derivation_key, input_fingerprint, B(numerator_points + denominator_points) AS inputs FROM keyed WHERE alignment = 'OK'",
)
def derivation_key(t):
    return _ratios(t).where("alignment = 'OK'").select(
        "derivation_key", "input_fingerprint", (F.col("numerator_points") + F.col("denominator_points")).alias("inputs")
    )


@query(
    "lineage_recheck",
    "WITH" + SQL_RATIO + """,
    edge AS (SELECT g.*, k.derivation_key FROM tagged g JOIN keyed k USING (site, ratio_code, period_start, period_end) WHERE k.alignment = 'OK')
    SELECT e.derivation_key, e.ratio_code, e.role, B(e.point_id) AS point_id,
        CASE WHEN e.point_id % 97 = 0 THEN 'INPUT_VANISHED' WHEN right(e.extract_id, 1) = '7' THEN 'EXTRACT_NOT_COMPLETE' ELSE 'SEMANTICS_CHANGED' END AS reason
    FROM edge e WHERE e.point_id % 97 = 0 OR right(e.extract_id, 1) = '7' OR right(e.series_id, 1) = '8'""",
)
def lineage_recheck(t):
    roles = catalogs.ratio_roles(t.spark)
    edges = M.ratio_inputs(eligible(t), roles, _ratios(t))
    # What has changed since the ratios were derived: points were withdrawn, extracts of some days turned partial, series became daily.
    stored = t.points.where(F.col("point_id") % 97 != 0)
    extracts = t.extracts.withColumn("status", F.when(F.substring("extract_id", -1, 1) == "7", "PARTIAL").otherwise(F.col("status")))
    series = t.series.withColumn("granularity", F.when(F.substring("series_id", -1, 1) == "8", "DAY").otherwise(F.col("granularity")))
    return M.lineage_recheck(edges, stored, series, extracts, roles)


frame(
    "raw_values",
    """
    SELECT event_id AS point_id, CASE event_id % 3 WHEN 0 THEN 'GA4' WHEN 1 THEN 'GSC' ELSE 'GAM' END AS source,
           CASE WHEN event_id % 4 = 0 THEN 'RATIO' ELSE 'COUNT' END AS unit,
           CASE WHEN event_id % 4 = 0 THEN 'ctr' ELSE 'clicks' END AS metric_api,
           CASE WHEN event_id % 2 = 0 THEN 'intValue' ELSE 'doubleValue' END AS value_kind,
           CASE WHEN event_id % 31 = 0 THEN 'n/a' WHEN event_id % 37 = 0 THEN '-1' WHEN event_id % 41 = 0 THEN '2e18'
                WHEN event_id % 43 = 0 THEN '5000000' WHEN event_id % 6 = 0 THEN '0.25'
                WHEN event_id % 5 = 0 THEN '12.5' ELSE CAST(user_id AS STRING) END AS raw_value
    FROM {events}
    """,
)


@query(
    "metric_value_gate",
    """SELECT source, unit, coalesce(reason, 'ACCEPTED') AS outcome, B(count(*)) AS points, round(sum(CASE WHEN reason IS NULL THEN number END), 4) AS total
    FROM (SELECT *, CASE WHEN number IS NULL THEN 'NOT_NUMERIC' WHEN number < 0 THEN 'NEGATIVE'
        WHEN source = 'GA4' AND unit = 'RATIO' AND number > 1e6 THEN 'RATIO_TOO_LARGE'
        WHEN (source <> 'GA4' OR unit = 'COUNT') AND number > 1e18 THEN 'TOO_LARGE'
        WHEN source = 'GSC' AND metric_api = 'ctr' AND number > 1 THEN 'CTR_ABOVE_ONE'
        WHEN source = 'GSC' AND unit = 'COUNT' AND number <> floor(number) THEN 'COUNT_NOT_INTEGRAL'
        WHEN source = 'GAM' AND unit = 'COUNT' AND value_kind <> 'intValue' THEN 'COUNT_NOT_INTEGER_TYPED' END AS reason
      FROM (SELECT *, try_cast(raw_value AS DOUBLE) AS number FROM {raw_values})) GROUP BY ALL""",
)
def metric_value_gate(t):
    gated = M.metric_value_gate(t.raw_values)
    return gated.groupBy("source", "unit", F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("outcome")).agg(
        F.count("*").alias("points"), F.round(F.sum(F.when(F.col("reject_reason").isNull(), F.col("number"))), 4).alias("total")
    )


# Hourly value of one metric per site, with the freshness of the whole interval.
SQL_HOURS = """
    hours AS (SELECT site, metric_code, period_start, period_end, sum(value) AS value, min(freshness) AS freshness FROM {points} GROUP BY ALL),
    pairs AS (SELECT *, lag(value) OVER w AS pv, lag(period_start) OVER w AS ps, lag(period_end) OVER w AS pe, lag(freshness) OVER w AS pf
        FROM hours WINDOW w AS (PARTITION BY site, metric_code ORDER BY period_start)),
    moved AS (SELECT *, CASE WHEN pv <> 0 THEN (value - pv) / pv END AS change FROM pairs WHERE pe <= period_start)"""


def _hours(t):
    return t.points.groupBy("site", "metric_code", "period_start", "period_end").agg(
        F.sum("value").alias("value"), F.min("freshness").alias("freshness")
    )


@query(
    "fractional_change",
    "WITH" + SQL_HOURS + " SELECT B(site) AS site, metric_code, TS(ps) AS previous_start, TS(period_start) AS period_start, round(change, 4) AS change FROM moved",
)
def fractional_change(t):
    return M.fractional_change(_hours(t), ["site", "metric_code"]).select(
        big("site").alias("site"), "metric_code", ts_text("previous_start").alias("previous_start"),
        ts_text("period_start").alias("period_start"), F.round("change", 4).alias("change"),
    )


@query(
    "divergence",
    "WITH" + SQL_HOURS + """,
    m AS (SELECT *, CASE WHEN change IS NULL THEN 'UNDEFINED' WHEN change > 0.05 THEN 'UP' WHEN change < -0.05 THEN 'DOWN' ELSE 'STABLE' END AS mv FROM moved)
    SELECT B(site) AS site, TS(period_start) AS period_start, a.mv AS left_movement, b.mv AS right_movement,
        a.mv <> 'UNDEFINED' AND b.mv <> 'UNDEFINED' AND a.mv <> b.mv AS diverged
    FROM (SELECT * FROM m WHERE metric_code = 'gam.ad_requests') a JOIN (SELECT * FROM m WHERE metric_code = 'ga4.screen_page_views') b
    USING (site, ps, pe, pf, period_start, period_end, freshness)""",
)
def divergence(t):
    hours = _hours(t)
    side = lambda code: hours.where(F.col("metric_code") == code).drop("metric_code")
    return M.divergence(side("gam.ad_requests"), side("ga4.screen_page_views"), ["site"]).select(
        big("site").alias("site"), ts_text("period_start").alias("period_start"), "left_movement", "right_movement", "diverged"
    )


@query(
    "series_head",
    """SELECT series_id, B(rn) AS position, B(point_id) AS point_id FROM (SELECT *, row_number() OVER
    (PARTITION BY series_id ORDER BY period_start, point_id) AS rn FROM {points}) WHERE rn <= 200""",
)
def series_head(t):
    return M.series_head(t.points, 200).select("series_id", big("position").alias("position"), "point_id")


@query(
    "dual_source_sites",
    """SELECT B(site) AS site FROM {connections} WHERE NOT archived AND provider IN ('GA4', 'GAM')
    GROUP BY 1 HAVING count(DISTINCT provider) = 2""",
)
def dual_source_sites(t):
    return M.dual_source_sites(t.connections).select(big("site").alias("site"))


@query(
    "monetization_visible",
    """WITH rule AS (SELECT site, max(CASE visibility WHEN 'ABSOLUTE' THEN 2 WHEN 'RELATIVE_ONLY' THEN 1 ELSE 0 END) AS level
        FROM {connections} WHERE provider = 'GAM' AND NOT archived GROUP BY 1)
    SELECT p.series_id, B(p.point_id) AS point_id FROM {points} p
      JOIN {series} s ON s.series_id = p.series_id AND s.site = p.site JOIN rule r ON r.site = s.site
      WHERE s.source = 'GAM' AND r.level > 0 AND (r.level = 2 OR s.unit <> 'CURRENCY')""",
)
def monetization_visible(t):
    return M.monetization_visible(t.connections, t.series, t.points).select("series_id", "point_id")
