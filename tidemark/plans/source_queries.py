"""Report readers, catalogs and append-only sinks.

The driver tables hold no provider JSON, so the readers' input is derived from `events` with
Spark: rows become JSON reports of at most a few hundred rows each (the group key contains the
row number divided by the report size, so no report can grow with the data).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shape import ts_text
from tidemark.plans.registry import query
from tidemark.sources import definitions as D
from tidemark.sources import reports as P
from tidemark.sources import sinks as S

C = F.col
SIZE = 400


def _values(*columns):
    return F.array(*[F.struct(c.cast("string").alias("value")) for c in columns])


def _header(names):
    return F.array(*[F.struct(F.lit(n).alias("name")) for n in names])


def ga4_reports(t):
    """Bad headers in chunk 3 of 7, a missing metric in chunk 5 of 11, a NaN in chunk 6 of 13."""
    e = t.events.withColumn("g", F.expr(f"event_id div {SIZE}")).withColumn("site", C("user_id") % 5)
    local = C("event_id") % SIZE
    dims = _values(F.date_format("ts", "yyyyMMddHH"), F.when(C("user_id") % 2 == 0, "desktop").otherwise("mobile"), C("event_type"))
    third = F.when((C("g") % 13 == 6) & (local < 50), F.lit("NaN")).otherwise((C("event_id") % 100).cast("string"))
    metrics = _values(C("event_id") % 10, C("user_id"), third, C("value"))
    metrics = F.when((C("g") % 11 == 5) & (local < 50), F.slice(metrics, 1, 3)).otherwise(metrics)
    rows = e.withColumn("row", F.struct(dims.alias("dimensionValues"), metrics.alias("metricValues")))
    grouped = rows.groupBy("site", "g").agg(F.collect_list("row").alias("rows"))
    names, wrong = ("dateHour", "deviceCategory", "sessionDefaultChannelGroup"), ("dateHour", "sessionDefaultChannelGroup", "deviceCategory")
    sampling = F.array(F.create_map(F.lit("samplesReadCount"), F.lit("10")))
    body = F.struct(
        F.when(C("g") % 7 == 3, _header(wrong)).otherwise(_header(names)).alias("dimensionHeaders"),
        _header(("activeUsers", "sessions", "screenPageViews", "engagedSessions")).alias("metricHeaders"), "rows",
        (C("g") % 4 == 0).alias("dataLossFromOtherRow"),
        F.struct(
            F.lit("Europe/Bucharest").alias("timeZone"), (C("g") % 3 == 0).alias("subjectToThresholding"),
            F.when(C("g") % 5 == 0, sampling).alias("samplingMetadatas"),
        ).alias("metadata"),
    )
    key = F.concat_ws(":", C("site").cast("string"), C("g").cast("string"))
    return grouped.select(key.alias("report_id"), F.lit("GA4_TRAFFIC_HOURLY_V1").alias("definition"), F.to_json(body).alias("payload"))


SQL_GA4 = f"""e AS (SELECT *, event_id // {SIZE} AS g, user_id % 5 AS site, event_id % {SIZE} AS loc FROM events),
    rep AS (SELECT site, g, CASE WHEN g % 7 = 3 THEN 'DIMENSION_HEADERS' WHEN g % 11 = 5 AND min(loc) < 50 THEN 'CARDINALITY' WHEN g % 13 = 6 AND min(loc) < 50 THEN 'METRIC_VALUE' END AS reason FROM e GROUP BY 1, 2)"""


@query("ga4_points", "WITH " + SQL_GA4 + """ SELECT concat(e.site, ':', e.g) AS report_id, m.code AS metric_code, 'COUNT' AS unit,
    'devicecategory=' || CASE WHEN user_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END || '|sessiondefaultchannelgroup=' || event_type AS dimension_text,
    TS(date_trunc('hour', ts) - INTERVAL '2' HOUR) AS period_start, TS(date_trunc('hour', ts) - INTERVAL '1' HOUR) AS period_end,
    CASE m.i WHEN 1 THEN (event_id % 10)::DOUBLE WHEN 2 THEN user_id::DOUBLE WHEN 3 THEN (event_id % 100)::DOUBLE ELSE value END AS value
    FROM e JOIN rep USING (site, g), (VALUES (1, 'ga4.active_users'), (2, 'ga4.sessions'), (3, 'ga4.screen_page_views'), (4, 'ga4.engaged_sessions')) AS m(i, code) WHERE rep.reason IS NULL""")
def ga4_points(t):
    points, _ = P.ga4_points(ga4_reports(t), D.extract_catalog(t.spark))
    return points.select(
        "report_id", "metric_code", "unit", "dimension_text", ts_text("period_start").alias("period_start"), ts_text("period_end").alias("period_end"), "value"
    )


@query("ga4_rejected", "WITH " + SQL_GA4 + " SELECT concat(site, ':', g) AS report_id, reason FROM rep WHERE reason IS NOT NULL")
def ga4_rejected(t):
    return P.ga4_points(ga4_reports(t), D.extract_catalog(t.spark))[1]


def gsc_reports(t):
    """Hourly reports in even chunks, daily ones in odd; a foreign offset in chunk 3 of 7, a ratio above one in 5 of 11."""
    e = t.events.withColumn("g", F.expr(f"event_id div {SIZE}")).withColumn("site", C("user_id") % 5)
    hourly, device = C("g") % 2 == 0, F.when(C("user_id") % 2 == 0, "DESKTOP").otherwise("MOBILE")
    offset = F.when(C("g") % 7 == 3, "-05:00").otherwise("-08:00")
    stamp = F.when(hourly, F.concat(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), offset)).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    row = F.struct(
        F.array(stamp, device).alias("keys"), (C("event_id") % 50).alias("clicks"), (C("event_id") % 50 + C("user_id") + 1).alias("impressions"),
        F.when(C("g") % 11 == 5, F.lit(1.5)).otherwise((C("event_id") % 10) / 10.0).alias("ctr"), C("value").alias("position"),
    )
    grouped = e.withColumn("row", row).groupBy("site", "g").agg(F.collect_list("row").alias("rows"))
    body = F.struct(
        "rows", F.lit("auto").alias("responseAggregationType"),
        F.struct(
            F.when(~hourly & (C("g") % 3 == 0), "2024-01-20").alias("first_incomplete_date"),
            F.when(hourly & (C("g") % 3 == 0), "2024-01-20T00:00:00-08:00").alias("first_incomplete_hour"),
        ).alias("metadata"),
        F.struct((C("g") % 4 == 0).alias("capReached")).alias("pagination"),
    )
    key = F.concat_ws(":", C("site").cast("string"), C("g").cast("string"))
    code = F.when(hourly, "GSC_SEARCH_HOURLY_V1").otherwise("GSC_SEARCH_FRESH_DAILY_V1")
    return grouped.select(key.alias("report_id"), code.alias("definition"), F.to_json(body).alias("payload"))


@query("gsc_points", f"""WITH e AS (SELECT *, event_id // {SIZE} AS g, user_id % 5 AS site, CASE WHEN event_id // {SIZE} % 2 = 0 THEN date_trunc('hour', ts) ELSE date_trunc('day', ts) END AS wall FROM events)
    SELECT concat(site, ':', g) AS report_id, m.code AS metric_code, m.unit, 'device=' || CASE WHEN user_id % 2 = 0 THEN 'DESKTOP' ELSE 'MOBILE' END AS dimension_text,
    TS(wall + INTERVAL '8' HOUR) AS period_start, TS(wall + INTERVAL '8' HOUR + CASE WHEN g % 2 = 0 THEN INTERVAL '1' HOUR ELSE INTERVAL '1' DAY END) AS period_end,
    CASE m.i WHEN 1 THEN (event_id % 50)::DOUBLE WHEN 2 THEN (event_id % 50 + user_id + 1)::DOUBLE WHEN 3 THEN (event_id % 10) / 10.0 ELSE value END AS value,
    CASE WHEN m.i = 3 THEN (event_id % 50)::DOUBLE END AS numerator, CASE WHEN m.i = 3 THEN (event_id % 50 + user_id + 1)::DOUBLE END AS denominator,
    CASE WHEN g % 3 = 0 AND wall >= TIMESTAMP '2024-01-20 00:00:00' THEN 'PRELIMINARY' ELSE 'MATURE' END AS freshness
    FROM e, (VALUES (1, 'gsc.web.clicks', 'COUNT'), (2, 'gsc.web.impressions', 'COUNT'), (3, 'gsc.web.ctr', 'RATIO'), (4, 'gsc.web.position', 'NUMBER')) AS m(i, code, unit)
    WHERE NOT (g % 7 = 3 AND g % 2 = 0) AND g % 11 <> 5""")
def gsc_points(t):
    points, _ = P.gsc_points(gsc_reports(t), D.extract_catalog(t.spark))
    return points.select(
        "report_id", "metric_code", "unit", "dimension_text", ts_text("period_start").alias("period_start"), ts_text("period_end").alias("period_end"), "value",
        "numerator", "denominator", "freshness",
    )


PAGE = 200


def gam_pages(t):
    """One result per site and week.  Site 3 declares a row too many, site 2 types a count as double in its second week."""
    e = t.events.withColumn("site", C("user_id") % 5).withColumn("w", F.expr("(day(ts) - 1) div 7"))
    typed = F.when(
        (C("site") == 2) & (C("w") == 1), F.struct(F.lit(None).cast("string").alias("intValue"), C("value").alias("doubleValue"))
    ).otherwise(F.struct((C("event_id") % 100).cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")))
    whole = lambda c: F.struct(c.cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue"))
    text = lambda c: F.struct(c.cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue"))
    number = lambda c: F.struct(F.lit(None).cast("string").alias("stringValue"), c.cast("string").alias("intValue"))
    row = F.struct(
        F.array(text(F.date_format("ts", "yyyy-MM-dd")), number(F.hour("ts")), number(C("user_id") % 10), text(C("event_type")), text(F.lit("BANNER"))).alias("dimensionValues"),
        F.array(F.struct(F.array(typed, whole(C("event_id") % 7), whole(C("user_id"))).alias("primaryValues"))).alias("metricValueGroups"),
    )
    keyed = e.withColumn("row", row).withColumn("chunk", F.expr(f"event_id div {PAGE}"))
    pages = keyed.groupBy("site", "w", "chunk").agg(F.collect_list("row").alias("rows"))
    totals = keyed.groupBy("site", "w").agg(F.count("*").alias("total"), F.max("chunk").alias("last"))
    date = lambda d: F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), (C("w") * 7).cast("int"))
    body = F.struct(
        "rows", F.concat(F.date_format(F.date_add(start, 7), "yyyy-MM-dd"), F.lit("T10:00:00Z")).alias("runTime"), (C("total") + F.when(C("site") == 3, 1).otherwise(0)).alias("totalRowCount"),
        F.when(C("chunk") < C("last"), F.concat(F.lit("p"), C("chunk").cast("string"))).alias("nextPageToken"),
        F.array(F.struct(date(start).alias("startDate"), date(F.date_add(start, 6)).alias("endDate"))).alias("dateRanges"),
    )
    return pages.join(totals, ["site", "w"]).select(
        F.concat_ws(":", C("site").cast("string"), C("w").cast("string")).alias("result_id"), C("chunk").alias("page_no"),
        F.lit("GAM_INVENTORY_HEALTH_V1").alias("definition"), F.lit("LAST_7_DAYS").alias("profile"), C("site").cast("string").alias("network_code"), F.to_json(body).alias("payload"),
    )


def networks(t):
    return t.events.select((C("user_id") % 5).cast("string").alias("network_code")).distinct().withColumn("zone", F.lit("America/New_York")).withColumn("currency_code", F.lit("EUR"))


def gam(t):
    return P.gam_points(gam_pages(t), networks(t), D.extract_catalog(t.spark))


SQL_GAM = "e AS (SELECT *, user_id % 5 AS site, (day(ts) - 1) // 7 AS w FROM events)"


@query("gam_points", "WITH " + SQL_GAM + """ SELECT concat(site, ':', w) AS result_id, m.code AS metric_code, 'COUNT' AS unit,
    array_to_string(list_sort(['ad_unit_id=' || (user_id % 10) || '|device_category_name=' || event_type || '|inventory_format_name=BANNER', 'network_code=' || site, 'currency_code=EUR']), '|') AS dimension_text,
    TS(date_trunc('hour', ts) + INTERVAL '5' HOUR) AS period_start, TS(date_trunc('hour', ts) + INTERVAL '6' HOUR) AS period_end, false AS ambiguous,
    CASE m.i WHEN 1 THEN event_id % 100 WHEN 2 THEN event_id % 7 ELSE user_id END::DOUBLE AS value, CASE WHEN (day(ts) - 1) % 7 = 6 THEN 'PRELIMINARY' ELSE 'MATURE' END AS freshness
    FROM e, (VALUES (1, 'gam.ad_requests'), (2, 'gam.ad_server_impressions'), (3, 'gam.ad_server_responses_served')) AS m(i, code) WHERE site <> 3 AND NOT (site = 2 AND w = 1)""")
def gam_points(t):
    return gam(t)[0].select(
        "result_id", "metric_code", "unit", "dimension_text", ts_text("period_start").alias("period_start"), ts_text("period_end").alias("period_end"), "ambiguous", "value", "freshness"
    )


@query("gam_rejected", "WITH " + SQL_GAM + " SELECT DISTINCT concat(site, ':', w) AS result_id, CASE WHEN site = 3 THEN 'PARTIAL_RESULT' ELSE 'ROW_VALUE' END AS reason FROM e WHERE site = 3 OR (site = 2 AND w = 1)")
def gam_rejected(t):
    return gam(t)[1]


@query("drilldown_points", f"""WITH e AS (SELECT *, event_id // {SIZE} AS g, user_id % 5 AS site FROM events)
    SELECT concat(site, ':', g) AS report_id, m.code AS metric_code, 'country=' || (user_id % 7) || '|devicecategory=' || event_type AS dimension_text,
    TS(date_trunc('day', ts) + INTERVAL '8' HOUR) AS period_start, TS(date_trunc('day', ts) + INTERVAL '32' HOUR) AS period_end, CASE m.i WHEN 1 THEN event_id % 10 WHEN 2 THEN user_id ELSE event_id % 100 END::DOUBLE AS value
    FROM e, (VALUES (1, 'ga4.active_users'), (2, 'ga4.sessions'), (3, 'ga4.screen_page_views')) AS m(i, code)""")
def drilldown_points(t):
    e = t.events.withColumn("g", F.expr(f"event_id div {SIZE}")).withColumn("site", C("user_id") % 5)
    row = F.struct(
        _values(F.date_format("ts", "yyyyMMdd"), C("user_id") % 7, C("event_type")).alias("dimensionValues"),
        _values(C("event_id") % 10, C("user_id"), C("event_id") % 100).alias("metricValues"),
    )
    grouped = e.withColumn("row", row).groupBy("site", "g").agg(F.collect_list("row").alias("rows"))
    body = F.struct(
        _header(("date", "country", "deviceCategory")).alias("dimensionHeaders"), _header(("activeUsers", "sessions", "screenPageViews")).alias("metricHeaders"), "rows",
        F.struct(F.lit("America/Los_Angeles").alias("timeZone")).alias("metadata"),
    )
    reports = grouped.select(
        F.concat_ws(":", C("site").cast("string"), C("g").cast("string")).alias("report_id"), F.lit("GA4_INCIDENT_TRAFFIC_COUNTRY_DEVICE_V1").alias("definition"), F.to_json(body).alias("payload")
    )
    catalog = D.drilldown_catalog(t.spark).drop("code", "window_mode", "required_parameters")
    return P.ga4_points(reports, catalog)[0].select(
        "report_id", "metric_code", "dimension_text", ts_text("period_start").alias("period_start"), ts_text("period_end").alias("period_end"), "value"
    )


SQL_CATALOG = ", ".join(f"('{s}', '{c}', '{g}', {len(d)}, {len(m)})" for s, c, _, g, _, d, m in D.EXTRACTS)


@query("extract_catalog", f"""SELECT d.source, d.definition, d.granularity, d.dimensions, d.metrics, B(count(p.point_id)) AS points FROM (VALUES {SQL_CATALOG}) AS d(source, definition, granularity, dimensions, metrics)
    LEFT JOIN {{points}} p ON p.extract_type = d.definition GROUP BY ALL""")
def extract_catalog(t):
    seen = t.points.groupBy(C("extract_type").alias("definition")).agg(F.count("*").alias("points"))
    return D.extract_catalog(t.spark).join(seen, "definition", "left").select(
        "source", "definition", "granularity", F.size("dimensions").alias("dimensions"), F.size("metrics").alias("metrics"), F.coalesce("points", F.lit(0)).alias("points")
    )


@query("inspection_rows", """SELECT B(page_id) AS page_id, 'PASS' AS verdict, CASE WHEN page_id % 2 = 0 THEN 'Indexed' END AS "coverageState", url AS "userCanonical" FROM pages WHERE page_id % 9 <> 0""")
def inspection_rows(t):
    body = F.struct(F.struct(F.struct(
        F.when(C("page_id") % 9 != 0, "PASS").alias("verdict"), F.when(C("page_id") % 2 == 0, "Indexed").alias("coverageState"), C("url").alias("userCanonical"), F.lit("dropped").alias("sitemap"),
    ).alias("indexStatusResult")).alias("inspectionResult"))
    documents = t.pages.select("page_id", F.to_json(body).alias("payload"))
    return P.inspection_rows(documents)[0].select("page_id", "verdict", "coverageState", "userCanonical")


@query("extract_limitations", f"""SELECT 'GA4' AS source, concat(user_id % 5, ':', event_id // {SIZE}) AS report_id, concat_ws(',', CASE WHEN g % 4 = 0 THEN 'OTHER_ROW_DATA_LOSS' END, CASE WHEN g % 5 = 0 THEN 'SAMPLING_APPLIED' END,
        CASE WHEN g % 3 = 0 THEN 'THRESHOLDING_APPLIED' END) AS limitations, CASE WHEN g % 4 = 0 OR g % 5 = 0 OR g % 3 = 0 THEN 'LIMITED' ELSE 'COMPLETE' END AS sample_status FROM (SELECT DISTINCT user_id % 5 AS user_id, event_id // {SIZE} * {SIZE} AS event_id, event_id // {SIZE} AS g FROM events)
    UNION ALL SELECT 'GSC', concat(user_id % 5, ':', event_id // {SIZE}), concat_ws(',', CASE WHEN g % 3 = 0 THEN 'INCOMPLETE_DATA' END, CASE WHEN g % 4 = 0 THEN 'ROW_LIMIT_REACHED' END, 'TOP_ROWS_ONLY'), 'LIMITED'
        FROM (SELECT DISTINCT user_id % 5 AS user_id, event_id // {SIZE} * {SIZE} AS event_id, event_id // {SIZE} AS g FROM events)
    UNION ALL SELECT 'GAM', concat(site, ':', w), CASE WHEN young THEN 'RECENT_DATA_PRELIMINARY' ELSE '' END, CASE WHEN young THEN 'LIMITED' ELSE 'COMPLETE' END
        FROM (SELECT user_id % 5 AS site, (day(ts) - 1) // 7 AS w, bool_or((day(ts) - 1) % 7 = 6) AS young FROM events GROUP BY 1, 2) WHERE site <> 3 AND NOT (site = 2 AND w = 1)""")
def extract_limitations(t):
    points, _ = gam(t)
    parts = (
        P.ga4_limitations(ga4_reports(t)).withColumn("source", F.lit("GA4")),
        P.gsc_limitations(gsc_reports(t)).withColumn("source", F.lit("GSC")),
        P.gam_limitations(points.select("result_id").distinct(), points).withColumnRenamed("result_id", "report_id").withColumn("source", F.lit("GAM")),
    )
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("source", "report_id", F.array_join("limitations", ",").alias("limitations"), P.sample_status(C("limitations")).alias("sample_status"))


CODES = [d[0] for d in D.DRILLDOWNS]
SQL_PICK = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES))


@query("drilldown_gate", f"""SELECT B(request_id) AS request_id, CASE WHEN pick = 12 THEN 'DRILLDOWN_NOT_ALLOWED' WHEN pick = 5 AND user_id % 3 = 0 THEN 'DRILLDOWN_PARAMETERS_INVALID' WHEN pick = 5 AND user_id % 3 = 1 THEN 'DRILLDOWN_PARAMETERS_INVALID'
    WHEN pick < 7 AND (date_diff('day', start_date, end_date) + 1 > 7 OR end_date > DATE '2024-01-25') THEN 'DRILLDOWN_WINDOW_INVALID' WHEN pick >= 7 AND user_id % 4 = 0 THEN 'DRILLDOWN_WINDOW_INVALID' END AS rejection FROM {{drill_requests}}""")
def drilldown_gate(t):
    code = F.coalesce(*[F.when(C("pick") == i, F.lit(c)) for i, c in enumerate(CODES)], F.lit("free_form"))
    page = F.when(C("user_id") % 3 == 0, "ftp://x.example.com/").otherwise("https://x.example.com/a")
    params = F.when((C("pick") == 5) & (C("user_id") % 3 != 1), F.create_map(F.lit("page"), page))
    rolling = C("pick") >= 7
    asked = t.drill_requests.select(
        "request_id", code.alias("code"), params.alias("parameters"), F.when(~rolling, C("start_date")).alias("start_date"), F.when(~rolling, C("end_date")).alias("end_date"),
        F.when(rolling, F.when(C("user_id") % 4 == 0, "LAST_90_DAYS").otherwise("TODAY")).alias("profile"),
    )
    return P.drilldown_gate(asked, D.drilldown_catalog(t.spark), F.lit("2024-01-25").cast("date")).select("request_id", "rejection")


@query("append_points", """SELECT B(min(point_id)) AS point_id, series_id, TS(period_start) AS period_start, extract_id FROM {points} p
    WHERE extract_id NOT IN (SELECT extract_id FROM {extracts} WHERE status = 'COMPLETE' AND retrieved_at < TIMESTAMP '2024-01-10 00:00:00')
      AND (series_id, period_start, extract_id) NOT IN (SELECT (series_id, period_start, extract_id) FROM {points} WHERE retrieved_at < TIMESTAMP '2024-01-15 12:00:00') GROUP BY series_id, period_start, extract_id""")
def append_points(t):
    ts = lambda text: F.lit(text).cast("timestamp")
    stored = t.points.where(C("retrieved_at") < ts("2024-01-15 12:00:00"))
    known = t.extracts.where(C("retrieved_at") < ts("2024-01-10 00:00:00"))
    return S.append_points(t.points, stored, known).select("point_id", "series_id", ts_text("period_start").alias("period_start"), "extract_id")


@query("upsert_series", """SELECT sha256(concat_ws('|', site::VARCHAR, source, metric_code, semantics_version, series_id)) AS series_key, B(min(point_id)) AS point_id FROM {points}
    GROUP BY site, source, metric_code, semantics_version, series_id HAVING min(retrieved_at) >= TIMESTAMP '2024-01-01 02:00:00'""")
def upsert_series(t):
    keyed = t.points.withColumn("series_key", S.series_key("site", "source", "metric_code", "semantics_version", "series_id"))
    stored = keyed.where(C("retrieved_at") < F.lit("2024-01-01 02:00:00").cast("timestamp")).select("series_key").distinct()
    return S.upsert_series(keyed, stored).select("series_key", "point_id")


@query("extract_conflicts", """SELECT B(connection_id) AS connection_id, run_key, B(count(*)) AS extracts FROM {extract_log} GROUP BY 1, 2 HAVING count(DISTINCT (definition, query, freshness)) > 1""")
def extract_conflicts(t):
    return S.extract_conflicts(t.extract_log)


@query("entity_upsert", """SELECT B(site) AS site, kind, stable_key, TS(min(at)) AS first_seen, TS(max(at)) AS last_seen FROM {entity_obs} GROUP BY 1, 2, 3""")
def entity_upsert(t):
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp")
    stored = t.entity_obs.where(C("at") < cut).groupBy("site", "kind", "stable_key").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return S.entity_upsert(t.entity_obs.where(C("at") >= cut), stored).select(
        "site", "kind", "stable_key", ts_text("first_seen").alias("first_seen"), ts_text("last_seen").alias("last_seen")
    )


@query("snapshot_append", """SELECT sha256(concat_ws('|', site::VARCHAR, config_type, 'SCHEDULED', source_key)) AS observation_key, B(min(snapshot_id)) AS snapshot_id FROM {config_obs} GROUP BY site, config_type, source_key
    HAVING min(at) >= TIMESTAMP '1998-01-01 00:00:00'""")
def snapshot_append(t):
    keyed = t.config_obs.withColumn("observation_key", S.observation_key("site", "config_type", F.lit("SCHEDULED"), "source_key"))
    stored = keyed.where(C("at") < F.lit("1998-01-01 00:00:00").cast("timestamp"))
    return S.snapshot_append(keyed, stored).select("observation_key", "snapshot_id")
