"""Provider reports (JSON text) to long metric points.

Every reader returns (points, rejected): a report is taken whole or not at all, with the first
reason that rules it out.  Definitions are a literal catalog, hence the broadcast joins.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times as Z
from tidemark.functions.shape import either
from tidemark.sources.definitions import MAX_ROWS

COUNT_LIMIT, RATIO_LIMIT = 1e18, 1e6

HEADER_SCHEMA = """dimensionHeaders ARRAY<STRUCT<name: STRING>>, metricHeaders ARRAY<STRUCT<name: STRING>>,
 rows ARRAY<STRUCT<dimensionValues: ARRAY<STRUCT<value: STRING>>, metricValues: ARRAY<STRUCT<value: STRING>>>>,
 dataLossFromOtherRow BOOLEAN,
 metadata STRUCT<timeZone: STRING, subjectToThresholding: BOOLEAN, samplingMetadatas: ARRAY<MAP<STRING, STRING>>,
 schemaRestrictionResponse: STRUCT<activeMetricRestrictions: ARRAY<STRING>>>"""

SEARCH_SCHEMA = """rows ARRAY<STRUCT<keys: ARRAY<STRING>, clicks: DOUBLE, impressions: DOUBLE, ctr: DOUBLE, position: DOUBLE>>,
 responseAggregationType STRING, metadata STRUCT<first_incomplete_date: STRING, first_incomplete_hour: STRING>,
 pagination STRUCT<capReached: BOOLEAN>"""

PAGE_SCHEMA = """rows ARRAY<STRUCT<dimensionValues: ARRAY<STRUCT<stringValue: STRING, intValue: STRING>>,
 metricValueGroups: ARRAY<STRUCT<primaryValues: ARRAY<STRUCT<intValue: STRING, doubleValue: DOUBLE>>>>>>,
 runTime STRING, totalRowCount BIGINT, nextPageToken STRING,
 dateRanges ARRAY<STRUCT<startDate: STRUCT<year: INT, month: INT, day: INT>, endDate: STRUCT<year: INT, month: INT, day: INT>>>"""

TIME_DIMENSIONS = ("date", "dateHour", "hour", "DATE", "HOUR")


ZONES = ", ".join(f"'{name}'" for name in sorted(zoneinfo.available_timezones()))


def known_zone(column: str) -> Column:
    return F.expr(f"coalesce({column} IN ({ZONES}), false)")


def _safe_zone(column: str) -> Column:
    return F.when(known_zone(column), F.col(column)).otherwise("UTC")


def dimension_text(names: Column, values: Column) -> Column:
    """'name=value' of every non-time dimension, sorted: the series part of a point's identity."""
    pairs = F.zip_with(names, values, lambda n, v: F.when(~n.isin(*TIME_DIMENSIONS), F.concat(F.lower(n), F.lit("="), v)))
    return F.array_join(F.array_sort(F.array_compact(pairs)), "|")


def _value_of(names: Column, values: Column, name: str) -> Column:
    return F.try_element_at(values, F.array_position(names, name).cast("int"))


def _with_definitions(reports: DataFrame, definitions: DataFrame, schema: str) -> DataFrame:
    return reports.withColumn("r", F.from_json("payload", schema)).join(F.broadcast(definitions), "definition", "left")


def _split(df: DataFrame, reason: Column, key: str) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull()).select(key, "reason")


def ga4_points(reports: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column-header reports.  Reports: report_id, definition, payload."""
    df = _with_definitions(reports, definitions, HEADER_SCHEMA)
    rows, zone = F.coalesce("r.rows", F.array().cast(df.schema["r"].dataType["rows"].dataType)), F.col("r.metadata.timeZone")
    names = lambda c: F.transform(c, lambda h: h["name"])
    time_name = F.when(F.col("granularity") == "HOUR", "dateHour").otherwise("date")
    time_format = F.when(F.col("granularity") == "HOUR", r"^\d{10}$").otherwise(r"^\d{8}$")

    def numbers_ok(row: Column) -> Column:
        def one(value: Column, metric: Column) -> Column:
            n = value["value"].try_cast("double")
            limit = F.when(metric["unit"] == "RATIO", RATIO_LIMIT).otherwise(COUNT_LIMIT)
            return F.coalesce((n >= 0) & (n <= limit) & ~F.isnan(n), F.lit(False))

        return F.forall(F.zip_with(row["metricValues"], F.col("metrics"), one), lambda ok: ok)

    def raw_time(row: Column) -> Column:
        place = F.array_position(F.col("dimensions"), time_name).cast("int")
        return F.try_element_at(row["dimensionValues"], place)["value"]

    def parsed(raw: Column) -> Column:
        return F.when(
            raw.rlike(r"^\d{8}(\d{2})?$"), F.try_to_timestamp(F.rpad(raw, 10, "0"), F.lit("yyyyMMddHH"))
        )

    reason = either(
        (F.col("metrics").isNull(), "UNKNOWN_DEFINITION"),
        (~names("r.dimensionHeaders").eqNullSafe(F.col("dimensions")), "DIMENSION_HEADERS"),
        (~names("r.metricHeaders").eqNullSafe(F.transform("metrics", lambda m: m["api_name"])), "METRIC_HEADERS"),
        (~known_zone("r.metadata.timeZone"), "TIME_ZONE"),
        (F.size(rows) > MAX_ROWS["GA4"], "ROW_BOUND"),
        (
            F.exists(rows, lambda x: ~F.coalesce((F.size(x["dimensionValues"]) == F.size("dimensions")) & (F.size(x["metricValues"]) == F.size("metrics")), F.lit(False))),
            "CARDINALITY",
        ),
        (F.exists(rows, lambda x: ~F.coalesce(F.rlike(raw_time(x), time_format) & parsed(raw_time(x)).isNotNull(), F.lit(False))), "TEMPORAL_DIMENSION"),
        (F.exists(rows, lambda x: ~numbers_ok(x)), "METRIC_VALUE"),
    )
    good, rejected = _split(df.withColumn("rows", rows), reason, "report_id")
    long = good.select(
        "report_id", "source", "definition", "semantics_version", "granularity", "dimensions", "metrics",
        zone.alias("zone"), F.explode("rows").alias("row"),
    )
    local = parsed(raw_time(F.col("row")))
    hourly = F.col("granularity") == "HOUR"
    zone_ok = F.col("zone")  # every report that got here names a known zone
    span = F.when(hourly, Z.wall_interval(local, zone_ok, "HOUR")).otherwise(Z.wall_interval(local, zone_ok, "DAY"))
    timed = long.withColumn("span", span).withColumn("source_time", raw_time(F.col("row"))).withColumn(
        "dimension_text", dimension_text(F.col("dimensions"), F.transform("row.dimensionValues", lambda v: v["value"]))
    )
    points = timed.withColumn("m", F.explode(F.arrays_zip(F.col("metrics").alias("def"), F.col("row.metricValues").alias("val")))).select(
        "report_id", "source", "definition", "semantics_version", "granularity", F.col("m.def.metric_code").alias("metric_code"),
        F.col("m.def.unit").alias("unit"), "dimension_text", "source_time", "span.period_start", "span.period_end",
        F.col("m.val.value").cast("double").alias("value"),
    )
    return points, rejected


def gsc_points(reports: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positional-key reports; ctr points carry their clicks and impressions."""
    df = _with_definitions(reports, definitions, SEARCH_SCHEMA)
    rows = F.coalesce("r.rows", F.array().cast(df.schema["r"].dataType["rows"].dataType))
    in_date, in_hour = F.col("r.metadata.first_incomplete_date"), F.col("r.metadata.first_incomplete_hour")
    state, hourly = F.col("data_state"), F.col("granularity") == "HOUR"

    def day(row: Column) -> Column:
        raw = _value_of(F.col("dimensions"), row["keys"], "date")
        return F.when(raw.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))

    def bad_time(row: Column) -> Column:
        hour = Z.search_hour(_value_of(F.col("dimensions"), row["keys"], "hour"))["valid"]
        return F.when(hourly, ~hour).otherwise(day(row).isNull())

    def bad_value(row: Column) -> Column:
        checks = [F.coalesce((row[m] < 0) | (row[m] > COUNT_LIMIT) | F.isnan(row[m]), F.lit(True)) for m in ("clicks", "impressions", "ctr", "position")]
        bad = (row["ctr"] > 1) | (row["clicks"] != F.floor(row["clicks"])) | (row["impressions"] != F.floor(row["impressions"]))
        for check in checks:
            bad = bad | check
        return F.coalesce(bad, F.lit(True))

    reason = either(
        (F.col("metrics").isNull(), "UNKNOWN_DEFINITION"),
        (F.size(rows) > MAX_ROWS["GSC"], "ROW_BOUND"),
        (~F.coalesce(F.col("r.responseAggregationType"), F.lit("auto")).isin("auto", "byPage", "byProperty"), "AGGREGATION"),
        ((state == "final") & (in_date.isNotNull() | in_hour.isNotNull()), "FINAL_WITH_INCOMPLETE"),
        ((state == "all") & in_hour.isNotNull(), "DAILY_WITH_HOUR"),
        ((state == "hourly_all") & in_date.isNotNull(), "HOURLY_WITH_DATE"),
        (F.exists(rows, lambda x: ~F.coalesce(F.size(x["keys"]) == F.size("dimensions"), F.lit(False))), "CARDINALITY"),
        (F.exists(rows, bad_time), "TEMPORAL_DIMENSION"),
        (F.exists(rows, bad_value), "METRIC_VALUE"),
    )
    good, rejected = _split(df.withColumn("rows", rows), reason, "report_id")
    long = good.select(
        "report_id", "source", "definition", "semantics_version", "granularity", "dimensions", "metrics",
        in_date.alias("in_date"), in_hour.alias("in_hour"), F.explode("rows").alias("row"),
    )
    row = F.col("row")
    hour = Z.search_hour(_value_of(F.col("dimensions"), row["keys"], "hour"))
    whole_day = Z.wall_interval(day(row), Z.SEARCH_ZONE, "DAY")
    start = F.when(hourly, hour["period_start"]).otherwise(whole_day["period_start"])
    end = F.when(hourly, hour["period_end"]).otherwise(whole_day["period_end"])
    limit_hour = F.try_to_timestamp("in_hour")
    young = F.when(hourly, start >= limit_hour).otherwise(day(row) >= F.try_to_timestamp(F.col("in_date"), F.lit("yyyy-MM-dd")))
    value = either(*[(F.col("m.api_name") == m, row[m]) for m in ("clicks", "impressions", "ctr", "position")])
    is_ctr = F.col("m.api_name") == "ctr"
    points = long.withColumn("m", F.explode("metrics")).select(
        "report_id", "source", "definition", "semantics_version", "granularity", F.col("m.metric_code").alias("metric_code"), F.col("m.unit").alias("unit"),
        dimension_text(F.col("dimensions"), row["keys"]).alias("dimension_text"), start.alias("period_start"), end.alias("period_end"), value.alias("value"),
        F.when(is_ctr, row["clicks"]).alias("numerator"), F.when(is_ctr, row["impressions"]).alias("denominator"),
        F.when(F.coalesce(young, F.lit(False)), "PRELIMINARY").otherwise("MATURE").alias("freshness"),
    )
    return points, rejected


def gam_points(pages: DataFrame, networks: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paged, typed-value results.  Pages: result_id, page_no, definition, profile, network_code, payload.

    A result counts only when every page is there: exactly one page has no successor, page
    numbers have no hole and the rows add up to the declared total.
    """
    df = _with_definitions(pages, definitions, PAGE_SCHEMA).join(networks, "network_code", "left")
    empty = F.array().cast(df.schema["r"].dataType["rows"].dataType)
    df = df.withColumn("rows", F.coalesce("r.rows", empty))
    df = df.withColumn("zone_ok", known_zone("zone")).withColumn("zone", _safe_zone("zone"))
    zone = F.col("zone")
    span = F.try_element_at(F.col("r.dateRanges"), F.lit(1))
    date_of = lambda d: Z.google_date(d["year"], d["month"], d["day"])
    run_at = Z.run_time(F.col("r.runTime"))
    df = df.withColumn("start", date_of(span["startDate"])).withColumn("end", date_of(span["endDate"])).withColumn(
        "run_date", F.to_date(F.from_utc_timestamp(run_at, zone))
    )
    place = lambda row, name: F.try_element_at(row["dimensionValues"], F.array_position(F.col("dimensions"), name).cast("int"))
    text = lambda d: F.coalesce(d["stringValue"], d["intValue"])
    local_day = lambda row: F.try_to_date(text(place(row, "DATE")), "yyyy-MM-dd")
    hour = lambda row: F.when(text(place(row, "HOUR")).rlike(r"^(1?\d|2[0-3])$"), text(place(row, "HOUR")).cast("int"))

    def metric_ok(value: Column, metric: Column) -> Column:
        n = F.coalesce(value["intValue"].try_cast("double"), value["doubleValue"])
        typed = F.when(metric["unit"] == "COUNT", value["intValue"].isNotNull() & value["doubleValue"].isNull()).otherwise(n.isNotNull())
        return F.coalesce(typed & (n >= 0) & (n <= COUNT_LIMIT), F.lit(False))

    def row_ok(row: Column) -> Column:
        values = row["metricValueGroups"][0]["primaryValues"]
        inside = (local_day(row) >= F.col("start")) & (local_day(row) <= F.col("end")) & hour(row).isNotNull()
        shape = (F.size(row["dimensionValues"]) == F.size("dimensions")) & (F.size(row["metricValueGroups"]) == 1) & (F.size(values) == F.size("metrics"))
        return F.coalesce(shape & inside & F.forall(F.zip_with(values, F.col("metrics"), metric_ok), lambda ok: ok), F.lit(False))

    today = F.col("profile") == "TODAY"
    want_end = F.when(today, F.col("run_date")).otherwise(F.date_sub("run_date", 1))
    want_start = F.when(today, want_end).otherwise(F.date_sub(want_end, 6))
    wall = lambda row: F.to_timestamp(local_day(row)) + F.make_dt_interval(hours=hour(row))
    hours_ok = F.forall("rows", lambda row: F.coalesce(Z.exists_locally(wall(row), zone), F.lit(True)))
    marked = df.withColumn("rows_ok", F.forall("rows", row_ok)).withColumn("hours_ok", hours_ok).withColumn(
        "range_ok", F.coalesce((F.size("r.dateRanges") == 1) & (F.col("start") == want_start) & (F.col("end") == want_end), F.lit(False))
    )
    results = marked.groupBy("result_id").agg(
        F.sum(F.size("rows")).alias("row_count"), F.min("r.totalRowCount").alias("low"), F.max("r.totalRowCount").alias("high"),
        F.count("*").alias("pages"), F.max("page_no").alias("last_page"), F.min("page_no").alias("first_page"),
        F.count_if(F.coalesce(F.col("r.nextPageToken"), F.lit("")) == "").alias("ends"),
        F.bool_and(F.col("metrics").isNotNull()).alias("known"), F.bool_and("range_ok").alias("range_ok"), F.bool_and("rows_ok").alias("rows_ok"), F.bool_and("hours_ok").alias("hours_ok"),
        F.bool_and("zone_ok").alias("zone_ok"),
    )
    whole = (F.col("ends") == 1) & (F.col("pages") == F.col("last_page") - F.col("first_page") + 1)
    reason = either(
        (~F.col("known"), "UNKNOWN_DEFINITION"), (~F.col("zone_ok"), "TIME_ZONE"),
        (~(whole & F.col("low").eqNullSafe(F.col("row_count")) & F.col("high").eqNullSafe(F.col("row_count"))), "PARTIAL_RESULT"),
        (~F.col("range_ok"), "DATE_RANGE"), (F.col("row_count") > MAX_ROWS["GAM"], "ROW_BOUND"), (~F.col("rows_ok"), "ROW_VALUE"),
        (~F.col("hours_ok"), "NONEXISTENT_HOUR"),
    )
    good, rejected = _split(results, reason, "result_id")
    long = marked.join(good.select("result_id"), "result_id").select(
        "result_id", "source", "definition", "semantics_version", "granularity", "dimensions", "metrics", "network_code", "currency_code",
        zone.alias("zone"), "run_date", F.explode("rows").alias("row"),
    )
    row = F.col("row")
    timed = long.withColumn("span", Z.ad_server_hour(wall(row), F.col("zone"))).withColumn("day", local_day(row))
    named = F.array_join(
        F.array_sort(F.array(dimension_text(F.col("dimensions"), F.transform(row["dimensionValues"], text)),
                             F.concat(F.lit("network_code="), "network_code"), F.concat(F.lit("currency_code="), "currency_code"))), "|",
    )
    value = F.coalesce(F.col("m.val.intValue").cast("double"), F.col("m.val.doubleValue"))
    points = (
        timed.withColumn("dimension_text", named)
        .withColumn("m", F.explode(F.arrays_zip(F.col("metrics").alias("def"), row["metricValueGroups"][0]["primaryValues"].alias("val"))))
        .select(
            "result_id", "source", "definition", "semantics_version", "granularity", F.col("m.def.metric_code").alias("metric_code"),
            F.col("m.def.unit").alias("unit"), "dimension_text", "span.period_start", "span.period_end", "span.ambiguous", value.alias("value"),
            F.when(F.col("day") >= F.date_sub("run_date", 1), "PRELIMINARY").otherwise("MATURE").alias("freshness"),
        )
    )
    return points, rejected


def inspection_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allow-listed index status fields; a missing verdict is an error.  Documents: page_id, payload."""
    fields = (
        "verdict", "coverageState", "robotsTxtState", "indexingState", "pageFetchState", "googleCanonical", "userCanonical", "lastCrawlTime", "crawledAs",
    )
    schema = f"inspectionResult STRUCT<indexStatusResult: STRUCT<{', '.join(f'{f}: STRING' for f in fields)}>>"
    parsed = documents.withColumn("s", F.from_json("payload", schema)["inspectionResult"]["indexStatusResult"])
    reason = either(
        (F.col("s").isNull(), "NO_RESULT"), (F.coalesce("s.verdict", F.lit("")) == "", "MISSING_VERDICT"),
        *[((F.length(f"s.{f}") > 2048) | (F.col(f"s.{f}") == ""), f"FIELD_{f}") for f in fields[1:]],
    )
    good, rejected = _split(parsed, reason, "page_id")
    return good.select("page_id", "s.*"), rejected


def ga4_limitations(reports: DataFrame) -> DataFrame:
    r = reports.withColumn("r", F.from_json("payload", HEADER_SCHEMA))
    flags = F.array(
        F.when(F.col("r.dataLossFromOtherRow"), "OTHER_ROW_DATA_LOSS"),
        F.when(F.size(F.coalesce("r.metadata.schemaRestrictionResponse.activeMetricRestrictions", F.array().cast("array<string>"))) > 0, "PROPERTY_PERMISSION_LIMIT"),
        F.when(F.size(F.coalesce("r.metadata.samplingMetadatas", F.array().cast("array<map<string,string>>"))) > 0, "SAMPLING_APPLIED"),
        F.when(F.col("r.metadata.subjectToThresholding"), "THRESHOLDING_APPLIED"),
    )
    return r.select("report_id", F.array_sort(F.array_compact(flags)).alias("limitations"))


def gsc_limitations(reports: DataFrame) -> DataFrame:
    r = reports.withColumn("r", F.from_json("payload", SEARCH_SCHEMA))
    incomplete = F.col("r.metadata.first_incomplete_date").isNotNull() | F.col("r.metadata.first_incomplete_hour").isNotNull()
    flags = F.array(
        F.when(incomplete, "INCOMPLETE_DATA"), F.when(F.col("r.pagination.capReached"), "ROW_LIMIT_REACHED"), F.lit("TOP_ROWS_ONLY")
    )
    return r.select("report_id", F.array_compact(flags).alias("limitations"))


def gam_limitations(results: DataFrame, points: DataFrame) -> DataFrame:
    """Row-level flags of complete results; results: result_id of every accepted result."""
    seen = points.groupBy("result_id").agg(
        F.bool_or("ambiguous").alias("ambiguous"), F.bool_or(F.col("freshness") == "PRELIMINARY").alias("young")
    )
    flags = F.array(
        F.when(F.coalesce("ambiguous", F.lit(False)), "DST_AMBIGUOUS_HOUR"), F.when(F.col("young").isNull(), "NO_ROWS_RETURNED"),
        F.when(F.coalesce("young", F.lit(False)), "RECENT_DATA_PRELIMINARY"),
    )
    return results.join(seen, "result_id", "left").select("result_id", F.array_compact(flags).alias("limitations"))


def sample_status(limitations: Column) -> Column:
    return F.when(F.size(limitations) > 0, "LIMITED").otherwise("COMPLETE")


MAX_WINDOW_DAYS = 7


def drilldown_gate(requests: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """Adds ``rejection``: null when a drill-down request fits its fixed definition.

    Requests: code, parameters (map), start_date, end_date, profile.
    """
    joined = requests.join(F.broadcast(catalog.select("code", "window_mode", "required_parameters")), "code", "left")
    params = F.coalesce("parameters", F.create_map().cast("map<string,string>"))
    page = F.try_element_at(params, F.lit("page"))
    days = F.date_diff("end_date", "start_date") + 1
    explicit = F.col("window_mode") == "EXPLICIT_DATES"
    dated = F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & F.col("profile").isNull()
    in_bounds = (days >= 1) & (days <= MAX_WINDOW_DAYS) & (F.col("end_date") <= today)
    rolling = F.col("start_date").isNull() & F.col("end_date").isNull() & F.col("profile").isin("TODAY", "LAST_7_DAYS")
    return joined.withColumn(
        "rejection",
        either(
            (F.col("window_mode").isNull(), "DRILLDOWN_NOT_ALLOWED"),
            (F.array_sort(F.map_keys(params)) != F.array_sort("required_parameters"), "DRILLDOWN_PARAMETERS_INVALID"),
            (F.exists(F.map_values(params), lambda v: v.isNull() | (v == "") | (F.length(v) > 2048)), "DRILLDOWN_PARAMETERS_INVALID"),
            (page.isNotNull() & ~F.coalesce(page.rlike(r"^(?i)https?://[^/?#@]+([/?#]|$)"), F.lit(False)), "DRILLDOWN_PARAMETERS_INVALID"),
            (explicit & ~F.coalesce(dated & in_bounds, F.lit(False)), "DRILLDOWN_WINDOW_INVALID"),
            (~explicit & ~F.coalesce(rolling, F.lit(False)), "DRILLDOWN_WINDOW_INVALID"),
        ),
    ).drop("window_mode", "required_parameters")
