"""Fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: cross-source ratios -------------------------------------------------
RULE_VERSION = "cross-source-v1"
RATIOS = (
    {
        "ratio_code": "derived.requests_per_view_v1",
        "NUMERATOR": ("GAM", "gam.ad_requests", "gam-historical-v1", "GAM_INVENTORY_HEALTH_V1"),
        "DENOMINATOR": ("GA4", "ga4.screen_page_views", "ga4-core-v1", "GA4_TRAFFIC_HOURLY_V1"),
    },
    {
        "ratio_code": "derived.impressions_per_view_v1",
        "NUMERATOR": ("GAM", "gam.ad_server_impressions", "gam-historical-v1", "GAM_INVENTORY_HEALTH_V1"),
        "DENOMINATOR": ("GA4", "ga4.screen_page_views", "ga4-core-v1", "GA4_TRAFFIC_HOURLY_V1"),
    },
)


def ratio_roles(spark: SparkSession, ratios=RATIOS) -> DataFrame:
    """Two rows per ratio; a literal frame, so its size is fixed by the catalog."""
    rows = [(r["ratio_code"], role, *r[role]) for r in ratios for role in ("NUMERATOR", "DENOMINATOR")]
    return spark.createDataFrame(
        rows,
        "ratio_code STRING, role STRING, source STRING, metric_code STRING, "
        "semantics_version STRING, extract_type STRING",
    )


# --- fixed values: freshness thresholds in hours ----------------------------------------
FRESHNESS_HOURS = {"GA4": 6, "GSC": 12, "GAM": 6, "PUBLIC_CONFIG": 18}
BROWSER_STALE_HOURS = 7

# --- fixed values: resource limits per scope ---------------------------------------------
RESOURCE_LIMITS = {"DRILLDOWN": 4, "DIAGNOSTIC_RUN": 8, "LLM_PASS": 20, "CHECKPOINT_RUN": 4}
DRILLDOWNS_PER_INVESTIGATION = 4
DRILLDOWNS_PER_CONNECTION_DAY = 8

# --- fixed values: retention in days per artifact type -----------------------------------
RETENTION_DAYS = {
    "SCREENSHOT_VIEWPORT": 90,
    "SCREENSHOT_VIEWPORT_PRECONSENT": 90,
    "SCREENSHOT_VIEWPORT_POSTCONSENT": 90,
    "SCREENSHOT_FULL_PAGE": 90,
    "RAW_DOM": 30,
}

# --- fixed values: severities from low to high -------------------------------------------
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

# --- fixed values: incident vocabulary ----------------------------------------------------
INCIDENT_STATUSES = ("OPEN", "INVESTIGATING", "RESOLVED", "CLOSED_UNRESOLVED")
OPEN_INCIDENT_STATUSES = ("OPEN", "INVESTIGATING")
SYMPTOM_FAMILIES = (
    "GAM_ADSERVING",
    "SEARCH_DISCOVER",
    "CONSENT_CMP",
    "PREBID_HEADER_BIDDING",
    "VIDEO",
    "BROWSER_PERFORMANCE",
    "ANALYTICS_MEASUREMENT",
    "EXTERNAL_INFRASTRUCTURE",
    "REPORTING_DISCREPANCY",
    "POLICY_COMPLIANCE",
    "PROGRAMMATIC_MARKET",
    "OTHER",
)
RELATION_TYPES = (
    "PRECEDES",
    "COINCIDES_WITH",
    "SAME_SEGMENT_AS",
    "MECHANISTICALLY_CAN_AFFECT",
    "METRIC_PARENT_OF",
    "METRIC_DESCENDANT_OF",
    "SUPPORTS",
    "CONTRADICTS",
    "INTRODUCED_BY",
    "RESOLVED_AFTER",
    "PERSISTED_AFTER_REMOVAL",
    "EXTERNAL_CONTEXT_FOR",
    "UNKNOWN_RELATION",
)
NOTE_TYPES = ("DEPLOY", "ROLLBACK", "CONFIG_CHANGE", "OPERATOR_INTERVENTION", "EXTERNAL_COMMUNICATION", "OTHER")

# --- fixed values: run states --------------------------------------------------------------
VALID_RUN_STATUSES = ("COMPLETE", "PARTIAL")
FINAL_RUN_STATUSES = ("COMPLETE", "PARTIAL", "SITE_ERROR", "BROWSER_ERROR", "SKIPPED")
HEALTHY_CONFIG_STATUSES = ("VALID", "VALID_WITH_WARNINGS")
ADS_CONDITION_CODES = {"MISSING": "ADS_TXT_MISSING", "EMPTY": "ADS_TXT_EMPTY_200", "INVALID": "ADS_TXT_INVALID"}

# --- fixed values: event rules (code, kind, severity, confirmation, severity policy,
#     minimum valid urls, minimum affected urls, affected urls for CRITICAL, rule version) ----
EVENT_RULES = (
    ("THIRD_PARTY_DEPENDENCY_ADDED", "POINT", "LOW", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e1-v1"),
    ("THIRD_PARTY_DEPENDENCY_REMOVED", "POINT", "MEDIUM", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e1-v1"),
    ("JS_ERROR_STARTED", "CONDITION", "MEDIUM", "TWO_CONSECUTIVE_CHECKPOINTS", "FIXED_DEFAULT", None, None, None, "e2-v1"),
    ("BROWSER_SOURCE_DEGRADED", "POINT", "HIGH", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e26-v1"),
    ("BROWSER_ACCESS_CHALLENGE_SUSPECTED", "POINT", "MEDIUM", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e26-v1"),
    ("BROWSER_SOURCE_RECOVERED", "POINT", "LOW", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e26-v1"),
    ("NOINDEX_ADDED", "POINT", "MEDIUM", "SINGLE_STRONG_OBSERVATION", "NOINDEX_SCOPE", 2, 2, 2, "e2-v1"),
    ("CANONICAL_CHANGED", "POINT", "MEDIUM", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e1-v1"),
    ("GPT_EXPECTED_SLOT_MISSING", "CONDITION", "HIGH", "MULTI_URL_CORROBORATION", "AFFECTED_URL_COUNT", 2, 2, 3, "e2-v1"),
    ("ROBOTS_TXT_CHANGED", "POINT", "LOW", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e3-v1"),
    ("ROBOTS_BROAD_BLOCK_ADDED", "POINT", "CRITICAL", "IMMEDIATE_SECOND_CHECK", "FIXED_DEFAULT", None, None, None, "e3-v1"),
    ("ROBOTS_BROAD_BLOCK_REMOVED", "POINT", "LOW", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e3-v1"),
    ("ADS_TXT_CHANGED", "POINT", "LOW", "SINGLE_STRONG_OBSERVATION", "FIXED_DEFAULT", None, None, None, "e3-v1"),
    ("ADS_TXT_MISSING", "CONDITION", "HIGH", "IMMEDIATE_SECOND_CHECK", "FIXED_DEFAULT", None, None, None, "e3-v1"),
    ("ADS_TXT_EMPTY_200", "CONDITION", "HIGH", "IMMEDIATE_SECOND_CHECK", "FIXED_DEFAULT", None, None, None, "e3-v1"),
    ("ADS_TXT_INVALID", "CONDITION", "HIGH", "IMMEDIATE_SECOND_CHECK", "FIXED_DEFAULT", None, None, None, "e3-v1"),
)


def event_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(EVENT_RULES),
        "code STRING, kind STRING, default_severity STRING, confirmation STRING, severity_policy STRING, "
        "min_valid_urls INT, min_affected_urls INT, critical_min_affected_urls INT, rule_version STRING",
    )
