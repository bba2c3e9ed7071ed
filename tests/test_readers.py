"""Provider reports written by hand: completeness, bounds, clock changes."""

import json
from datetime import datetime

from tidemark.sources import definitions as D
from tidemark.sources import reports as P

PAGES = "result_id STRING, page_no INT, definition STRING, profile STRING, network_code STRING, payload STRING"


def page(no, rows, total, token, run="2026-08-02T10:00:00Z", day=(2026, 8, 2)):
    date = dict(zip(("year", "month", "day"), day))
    body = {
        "rows": [
            {"dimensionValues": [{"stringValue": d}, {"intValue": str(h)}, {"intValue": "9"}, {"stringValue": "Desktop"}, {"stringValue": "Banner"}],
             "metricValueGroups": [{"primaryValues": [{"intValue": "5"}, {"intValue": "4"}, {"intValue": "3"}]}]} for d, h in rows
        ],
        "runTime": run, "totalRowCount": total, "dateRanges": [{"startDate": date, "endDate": date}],
    }
    if token:
        body["nextPageToken"] = token
    return ("r", no, "GAM_INVENTORY_HEALTH_V1", "TODAY", "n1", json.dumps(body))


def read(spark, pages, zone="Europe/Bucharest"):
    networks = spark.createDataFrame([("n1", zone, "EUR")], "network_code STRING, zone STRING, currency_code STRING")
    points, rejected = P.gam_points(spark.createDataFrame(pages, PAGES), networks, D.extract_catalog(spark))
    return points.collect(), [r["reason"] for r in rejected.collect()]


DAY = "2026-08-02"


def test_all_pages_make_a_result(spark):
    points, bad = read(spark, [page(1, [(DAY, 0), (DAY, 1)], 3, "p2"), page(2, [(DAY, 2)], 3, None)])
    assert len(points) == 9 and not bad
    assert {p["freshness"] for p in points} == {"PRELIMINARY"}
    assert points[0]["dimension_text"].count("=") == 5


def test_a_missing_page_or_row_makes_it_partial(spark):
    assert read(spark, [page(1, [(DAY, 0)], 1, "p2")]) == ([], ["PARTIAL_RESULT"])
    assert read(spark, [page(1, [(DAY, 0)], 2, "p2"), page(3, [(DAY, 1)], 2, None)]) == ([], ["PARTIAL_RESULT"])
    assert read(spark, [page(1, [(DAY, 0)], 2, None)]) == ([], ["PARTIAL_RESULT"])


def test_range_must_fit_the_profile_and_rows_the_range(spark):
    assert read(spark, [page(1, [(DAY, 0)], 1, None, day=(2026, 8, 1))])[1] == ["DATE_RANGE"]
    assert read(spark, [page(1, [("2026-08-01", 0)], 1, None)])[1] == ["ROW_VALUE"]
    assert read(spark, [page(1, [(DAY, 0)], 1, None)], "Not/AZone")[1] == ["TIME_ZONE"]


def test_repeated_hour_is_flagged_and_skipped_hour_refused(spark):
    autumn = page(1, [("2026-10-25", 3)], 1, None, "2026-10-25T10:00:00Z", (2026, 10, 25))
    points, bad = read(spark, [autumn])
    assert not bad and points[0]["ambiguous"]
    assert (points[0]["period_start"], points[0]["period_end"]) == (datetime(2026, 10, 25, 0), datetime(2026, 10, 25, 2))
    spring = page(1, [("2026-03-29", 3)], 1, None, "2026-03-29T10:00:00Z", (2026, 3, 29))
    assert read(spark, [spring]) == ([], ["NONEXISTENT_HOUR"])


def test_empty_search_report_is_accepted_with_its_limits(spark):
    payload = json.dumps({"rows": [], "metadata": {}, "pagination": {"capReached": True}})
    reports = spark.createDataFrame([("a", "GSC_DISCOVER_DAILY_V1", payload)], "report_id STRING, definition STRING, payload STRING")
    points, rejected = P.gsc_points(reports, D.extract_catalog(spark))
    assert points.count() == 0 and rejected.count() == 0
    assert P.gsc_limitations(reports).first()["limitations"] == ["ROW_LIMIT_REACHED", "TOP_ROWS_ONLY"]


def test_final_search_report_must_not_declare_incomplete_data(spark):
    payload = json.dumps({"rows": [], "metadata": {"first_incomplete_date": "2026-08-01"}})
    reports = spark.createDataFrame([("a", "GSC_SEARCH_DAILY_V1", payload)], "report_id STRING, definition STRING, payload STRING")
    assert [r["reason"] for r in P.gsc_points(reports, D.extract_catalog(spark))[1].collect()] == ["FINAL_WITH_INCOMPLETE"]
