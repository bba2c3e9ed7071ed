"""Small cases with expected values written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import catalogs
from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.functions import times as Z
from tidemark.functions import urls as U
from tidemark.operators import config_text as K
from tidemark.operators import events as E
from tidemark.operators import evidence as V
from tidemark.operators import investigate as I
from tidemark.operators import metrics as M

H0, H1 = datetime(2026, 8, 1, 10), datetime(2026, 8, 1, 11)
NUM = ("GAM", "gam.ad_requests", "gam-historical-v1", "GAM_INVENTORY_HEALTH_V1")
DEN = ("GA4", "ga4.screen_page_views", "ga4-core-v1", "GA4_TRAFFIC_HOURLY_V1")
POINT = (
    "point_id BIGINT, site INT, series_id STRING, source STRING, metric_code STRING, semantics_version STRING, extract_type STRING, extract_id STRING, "
    "period_start TIMESTAMP, period_end TIMESTAMP, retrieved_at TIMESTAMP, freshness STRING, sample_status STRING, value DOUBLE, limitations ARRAY<STRING>"
)


def point(i, kind, value, series="s", freshness="MATURE", at=H1, sample="COMPLETE", limits=()):
    return (i, 1, f"{series}:{kind[0]}", *kind, "x", H0, H1, at, freshness, sample, float(value), list(limits))


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def ratios(spark, points):
    rows = M.ratio_derive(spark.createDataFrame(points, POINT), catalogs.ratio_roles(spark, catalogs.RATIOS[:1])).collect()
    assert len(rows) == 1
    return rows[0]


def test_ratio_sums_series_and_unites_limitations(spark):
    row = ratios(spark, [point(1, NUM, 30, "a", limits=["SAMPLING_APPLIED"]), point(2, NUM, 10, "b"), point(3, DEN, 20, sample="LIMITED")])
    assert (row["numerator"], row["denominator"], row["value"], row["alignment"]) == (40, 20, 2, "OK")
    assert row["limitations"] == ["SAMPLING_APPLIED", "SOURCE_POINT_LIMITED"]


def test_mature_revision_beats_a_later_preliminary_one(spark):
    row = ratios(spark, [point(1, NUM, 30), point(2, NUM, 99, freshness="PRELIMINARY", at=datetime(2026, 8, 2)), point(3, DEN, 10)])
    assert row["value"] == 3


@pytest.mark.parametrize(
    ("points", "reason"),
    [
        ([point(1, NUM, 1)], "MISSING_DENOMINATOR"),
        ([point(1, DEN, 1)], "MISSING_NUMERATOR"),
        ([point(1, NUM, 1), point(2, DEN, 1, freshness="PRELIMINARY")], "INCOMPATIBLE_FRESHNESS"),
        ([point(1, NUM, 1), point(2, DEN, 0)], "ZERO_DENOMINATOR"),
        ([point(1, NUM, 1, freshness="UNKNOWN"), point(2, DEN, 1, freshness="UNKNOWN")], "INCOMPATIBLE_FRESHNESS"),
    ],
)
def test_missing_is_not_zero(spark, points, reason):
    row = ratios(spark, points)
    assert row["alignment"] == reason and row["value"] is None and row["derivation_key"] is None


def test_fingerprint_ignores_order_and_notices_any_change(spark):
    base = [point(1, NUM, 30, "a"), point(2, NUM, 10, "b"), point(3, DEN, 20)]
    same, other = ratios(spark, base[::-1]), ratios(spark, [*base[:2], point(4, DEN, 20)])
    assert ratios(spark, base)["derivation_key"] == same["derivation_key"] != other["derivation_key"]


# --- zones ------------------------------------------------------------------------------------
def ts(text):
    return F.lit(text).cast("timestamp")


def test_wall_rule_keeps_the_wall_clock_over_the_repeated_hour(spark):
    span = one(spark, Z.wall_interval(ts("2026-10-25 03:00:00"), "Europe/Bucharest", "HOUR"))
    assert (span["period_start"], span["period_end"]) == (datetime(2026, 10, 25, 0), datetime(2026, 10, 25, 2))


def test_ad_server_rule_spans_repeated_and_refuses_skipped_hours(spark):
    twice = one(spark, Z.ad_server_hour(ts("2026-10-25 03:00:00"), "Europe/Bucharest"))
    assert (twice["period_start"], twice["period_end"], twice["ambiguous"]) == (datetime(2026, 10, 25, 0), datetime(2026, 10, 25, 2), True)
    never = one(spark, Z.ad_server_hour(ts("2026-03-29 03:00:00"), "Europe/Bucharest"))
    assert never["nonexistent"] and never["period_start"] is None
    plain = one(spark, Z.ad_server_hour(ts("2026-06-01 03:00:00"), "Europe/Bucharest"))
    assert (plain["period_end"], plain["ambiguous"]) == (datetime(2026, 6, 1, 1), False)


@pytest.mark.parametrize(
    ("text", "start"),
    [
        ("2026-11-01T01:00:00-07:00", datetime(2026, 11, 1, 8)), ("2026-11-01T01:00:00-08:00", datetime(2026, 11, 1, 9)),
        ("2026-11-01T01:00:00-05:00", None), ("2026-11-01T01:30:00-07:00", None), ("garbage", None),
    ],
)
def test_search_rule_needs_the_zones_own_offset(spark, text, start):
    assert one(spark, Z.search_hour(F.lit(text)))["period_start"] == start


@pytest.mark.parametrize(
    ("instant", "start", "end"),
    [
        ("2026-03-28 23:00:00", datetime(2026, 3, 28, 22), datetime(2026, 3, 29, 3)),  # five hours
        ("2026-10-24 23:00:00", datetime(2026, 10, 24, 21), datetime(2026, 10, 25, 4)),  # seven hours
        ("2026-07-01 10:00:00", datetime(2026, 7, 1, 9), datetime(2026, 7, 1, 15)),
    ],
)
def test_six_hour_windows_on_clock_change_days(spark, instant, start, end):
    window = one(spark, Z.six_hour_window(ts(instant), "Europe/Bucharest"))
    assert (window["window_start"], window["window_end"]) == (start, end)


# --- text -----------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("path", "want"),
    [("/a/12345/b", "/a/:id/b"), ("", "/"), ("//x//", "/x"), ("/v12345x", "/v:numberx"), ("/deadbeefdeadbeef", "/:id"), ("/a b  c", "/a b c")],
)
def test_path_family(spark, path, want):
    assert one(spark, T.path_family(F.lit(path))) == want


def test_long_path_family_ends_in_a_digest(spark):
    got = one(spark, T.path_family(F.lit("/" + "/".join(["abc"] * 300))))
    assert len(got) == 480 + 1 + 16 and got[480] == "~"


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://User@EXAMPLE.com.:8443/x?y#z", "example.com"), ("//cdn.example.com/a", "cdn.example.com"), ("/relative", None), ("https://[::1]:80/", "[::1]"), ("https:///x", None)],
)
def test_host(spark, url, host):
    assert one(spark, U.host(F.lit(url))) == host


@pytest.mark.parametrize(("raw", "want"), [("/%7eA", "/~A"), ("/%2f", "/%2F"), ("/a%zz", "/a%25zz"), ("/é", "/%C3%A9"), ("/a b", "/a%20b")])
def test_norm_octets(spark, raw, want):
    assert one(spark, U.norm_octets(F.lit(raw))) == want


def test_domains(spark):
    names = [" Example.COM. ", "münchen.example", "one", "a..b", "-x.example", "https://x.example"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    assert [r[0] for r in df.select(U.norm_domain(F.col("n"), True)).collect()] == ["example.com", "xn--mnchen-3ya.example", None, None, None, None]


@pytest.mark.parametrize(("raw", "want"), [("249.7MiB / 1GiB", 249.7), ("2GiB", 2048.0), ("512KiB/1GiB", 0.5), ("5 parsecs", None)])
def test_memory(spark, raw, want):
    assert one(spark, N.mem_to_mib(F.lit(raw))) == want


# --- sessions ---------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("samples", "want"),
    [
        ([(0, 0.1), (500, 0.2), (1499, 0.3)], 0.6), ([(0, 0.1), (1000, 0.2)], 0.2), ([(i * 900, 0.1) for i in range(8)], 0.6),
        ([(0, 0.0), (100, 0.5)], 0.5), ([(0, 9000.0), (10, 9000.0)], 10_000.0),
    ],
)
def test_largest_shift_session(spark, samples, want):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in samples], "k INT, t BIGINT, v DOUBLE")
    assert V.cls_sessions(df, ["k"]).first()["cls"] == pytest.approx(want)


# --- lifecycle --------------------------------------------------------------------------------
def actions(spark, rows):
    return spark.createDataFrame(
        [("c", datetime(2026, 1, d), run, action, severity, a, v) for d, run, action, severity, a, v in rows],
        "key STRING, at TIMESTAMP, run_id BIGINT, action STRING, severity STRING, affected_count BIGINT, valid_count BIGINT",
    )


def test_lifecycle_ignores_early_support_rises_only_and_recurs(spark):
    df = actions(spark, [
        (1, 1, "SUPPORT", "HIGH", 2, 3), (2, 2, "UPSERT", "HIGH", 3, 3), (3, 3, "SUPPORT", "LOW", 2, 5), (3, 3, "SUPPORT", "CRITICAL", 9, 9),
        (4, 4, "RESOLVE", "LOW", 0, 3), (5, 5, "RESOLVE", "LOW", 0, 3), (6, 6, "UPSERT", "MEDIUM", 1, 1),
    ])
    got = [tuple(r) for r in E.condition_lifecycle(df, ["key"], ["at", "run_id", "severity"]).orderBy("episode").select(
        "episode", "detected_at", "ended_at", "severity", "supporting_count", "affected_count", "valid_count", "blast_radius", "status").collect()]
    # Run 3 counts once, with its first action.
    assert got[0] == (1, datetime(2026, 1, 2), datetime(2026, 1, 4), "CRITICAL", 2, 9, 9, 2, "RESOLVED")
    assert got[1] == (2, datetime(2026, 1, 6), None, "MEDIUM", 1, 1, 1, 1, "ACTIVE")


def test_recovery_must_be_later_and_another_run(spark):
    rows = [("s", datetime(2026, 1, 1), 1, "OK"), ("s", datetime(2026, 1, 2), 2, "DEGRADED"), ("s", datetime(2026, 1, 2), 3, "OK"),
            ("s", datetime(2026, 1, 3), 4, "OK"), ("s", datetime(2026, 1, 4), 5, "OK")]
    df = spark.createDataFrame(rows, "site STRING, at TIMESTAMP, run_id BIGINT, state STRING")
    got = E.reliability_recoveries(df, ["site"]).collect()
    assert [(r["degraded_run"], r["recovered_run"]) for r in got] == [(2, 4)]


@pytest.mark.parametrize(
    ("present", "before", "want"),
    [
        ([False, False, False], [True, True, True], ("UPSERT", "CRITICAL")), ([False, False, True], [True, True, True], ("UPSERT", "HIGH")),
        ([False, False, True], [True, False, True], ("SUPPORT", "HIGH")), ([True, True], [False, True], ("RESOLVE", "HIGH")), ([False, True], [True, True], None),
    ],
)
def test_slot_cohort(spark, present, before, want):
    rows = [("w", 1, 1, i, 7, p, b) for i, (p, b) in enumerate(zip(present, before))]
    df = spark.createDataFrame(rows, "window_id STRING, template_id INT, scenario_id INT, url_id INT, slot INT, present BOOLEAN, previous_present BOOLEAN")
    got = E.slot_cohort(df).collect()
    assert [(r["action"], r["severity"]) for r in got] == ([want] if want else [])


# --- hypotheses -------------------------------------------------------------------------------
def ranked(spark, families, events, relations):
    labels = I.hypothesis_labels(
        spark.createDataFrame([(1, f) for f in families], "incident_id INT, family STRING"),
        spark.createDataFrame(events, "incident_id INT, family STRING, supports BOOLEAN, evidence_id STRING"),
        spark.createDataFrame(relations, "incident_id INT, from_family STRING, to_family STRING, relation_type STRING"),
        spark.createDataFrame([(1, "run SITE_ERROR")], "incident_id INT, description STRING"),
        spark.createDataFrame([(1, 9)], "incident_id INT, note_id BIGINT"),
    )
    return {r["family"]: (r["status"], r["score"], r["missing"], r["human_context"]) for r in I.rank_hypotheses(I.hypothesis_candidates(labels)).collect()}


def test_ranking_leading_and_weakened(spark):
    got = ranked(spark, ["GAM_ADSERVING", "SEARCH_DISCOVER"], [(1, "GAM_ADSERVING", True, "e1"), (1, "GAM_ADSERVING", True, "e2"), (1, "SEARCH_DISCOVER", False, "e3")], [])
    assert got == {"GAM_ADSERVING": ("LEADING", 4, 1, 1), "SEARCH_DISCOVER": ("WEAKENED", -1, 1, 1)}


def test_self_contradiction_only_weakens_and_cross_contradiction_mirrors(spark):
    assert ranked(spark, ["VIDEO"], [], [(1, "VIDEO", "VIDEO", "CONTRADICTS")])["VIDEO"][:2] == ("WEAKENED", -1)
    got = ranked(spark, ["VIDEO", "OTHER"], [], [(1, "VIDEO", "OTHER", "CONTRADICTS"), (1, "VIDEO", "OTHER", "CONTRADICTS")])
    assert got["VIDEO"][:2] == ("LEADING", 2) and got["OTHER"][:2] == ("WEAKENED", -1)


def test_oversized_packs_are_refused_not_cut(spark):
    at = datetime(2026, 1, 2)
    incidents = spark.createDataFrame([(1, 1, "a", datetime(2026, 1, 1), datetime(2026, 1, 3)), (2, 2, "b", datetime(2026, 1, 1), datetime(2026, 1, 3))],
                                      "incident_id INT, site INT, incident_text STRING, window_start TIMESTAMP, window_end TIMESTAMP")
    fact = "site INT, at TIMESTAMP, id BIGINT, entry STRING"
    none = spark.createDataFrame([], fact)
    notes = spark.createDataFrame([(1, at, i, "x" * 1000) for i in range(400)] + [(2, at, 1, "short")], fact)
    runs = spark.createDataFrame([(2, at, i, f"r{i}") for i in range(300)], fact)
    packs = {r["incident_id"]: r for r in I.evidence_pack(incidents, runs, none, none, none, notes).collect()}
    assert packs[1]["content"] is None
    assert packs[2]["content"].count('"r') == 1 + 200 and '"r199"' in packs[2]["content"] and '"r200"' not in packs[2]["content"]
    stored = spark.createDataFrame([], "incident_id INT, content_hash STRING")
    assert [r["incident_id"] for r in I.persist_pack(spark.createDataFrame(list(packs.values())), stored).collect()] == [2]


# --- files -------------------------------------------------------------------------------------
def test_seller_file_with_every_kind_of_line(spark):
    text = "\r\n".join([
        "﻿# head", "Good.example.com, 1 , direct, CERT # tail", "good.example.com,1,DIRECT,cert", "two.example.com,2", "x,1,DIRECT", "y.example.com,,DIRECT",
        "y.example.com,1,OWNER", "y.example.com,1,DIRECT,", "OWNERDOMAIN=me.example.com", "OWNERDOMAIN=you.example.com", "MANAGERDOMAIN=m.example.com,ro", "MANAGERDOMAIN=m.example.com,rou", "CONTACT=",
    ])
    lines = K.ads_diagnosed(K.ads_lines(spark.createDataFrame([(1, text)], "file_id INT, text STRING")))
    assert [(r["line_no"], r["problem"]) for r in lines.where("problem IS NOT NULL").orderBy("line_no").collect()] == [
        (3, "DUPLICATE_RECORD"), (4, "INVALID_FIELD_COUNT"), (5, "INVALID_DOMAIN"), (6, "INVALID_ACCOUNT_ID"), (7, "INVALID_RELATIONSHIP"), (8, "INVALID_CERT_AUTHORITY"),
        (10, "DUPLICATE_OWNERDOMAIN"), (12, "INVALID_MANAGERDOMAIN"), (13, "EMPTY_CONTACT"),
    ]
    state = K.ads_file_state(spark.createDataFrame([(1, text)], "file_id INT, text STRING")).first()
    assert (state["parse_status"], state["records"], state["owner_domain"], state["managers"]) == ("VALID_WITH_WARNINGS", 1, "me.example.com", ["m.example.com:RO"])


@pytest.mark.parametrize(
    ("agent", "path", "want"),
    [
        ("anybot", "/private/x", False), ("anybot", "/private/open", True), ("anybot", "/a.pdf", False), ("anybot", "/a.pdfx", True), ("MyBot/1.0", "/private/x", True),
        ("MyBot/1.0", "/only", False), ("anybot", "/tie", True),
    ],
)
def test_robots_longest_agent_longest_rule_allow_wins(spark, agent, path, want):
    text = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /tie\nAllow: /tie\n\nUser-agent: mybot\nDisallow: /only\n"
    rules = K.robots_rules(spark.createDataFrame([(1, text)], "file_id INT, text STRING"))
    urls = spark.createDataFrame([(1, 1, agent, path)], "url_id INT, file_id INT, user_agent STRING, path STRING")
    assert K.robots_allowed(urls, rules).first()["allowed"] is want


def test_page_signals(spark):
    html = ('<html><head><title> A &amp;\n B </title><META name="Robots" content="NoIndex, follow"><meta name="robots" content="follow">'
            '<link rel="alternate canonical" href="/x?y=1#z"></head></html>')
    row = K.page_seo(spark.createDataFrame([(1, "https://Site.example.com/a/b", html)], "page_id INT, url STRING, html STRING")).first()
    assert (row["meta_robots"], row["canonical_url"]) == ("follow,noindex", "https://site.example.com/x?y=1")
    assert row["title_hash"] == one(spark, F.sha2(F.lit("A & B"), 256))
