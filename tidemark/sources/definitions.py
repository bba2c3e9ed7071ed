"""Versioned extract and drill-down definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COUNT, RATIO, NUMBER, CURRENCY = "COUNT", "RATIO", "NUMBER", "CURRENCY"
ANALYTICS, AD_SERVER, SEARCH = "ga4-core-v1", "gam-historical-v1", "gsc-search-analytics-v1"
AD_TRAFFIC = "gam-ads-traffic-navigator-v1"


_WEB = (
    ("clicks", "gsc.web.clicks", COUNT),
    ("impressions", "gsc.web.impressions", COUNT),
    ("ctr", "gsc.web.ctr", RATIO),
    ("position", "gsc.web.position", NUMBER),
)
_DISCOVER = (
    ("clicks", "gsc.discover.clicks", COUNT),
    ("impressions", "gsc.discover.impressions", COUNT),
    ("ctr", "gsc.discover.ctr", RATIO),
    ("position", "gsc.discover.position", NUMBER),
)
_USERS = ("activeUsers", "ga4.active_users", COUNT)
_SESSIONS = ("sessions", "ga4.sessions", COUNT)
_VIEWS = ("screenPageViews", "ga4.screen_page_views", COUNT)
_AD_REQUESTS = ("AD_REQUESTS", "gam.ad_requests", COUNT)
_AD_IMPRESSIONS = ("AD_SERVER_IMPRESSIONS", "gam.ad_server_impressions", COUNT)

# (source, code, semantics, granularity, data state, dimensions, metrics(api name, code, unit))
EXTRACTS = (
    ("GA4", "GA4_TRAFFIC_HOURLY_V1", ANALYTICS, "HOUR", None, ("dateHour", "deviceCategory", "sessionDefaultChannelGroup"),
     (_USERS, _SESSIONS, _VIEWS, ("engagedSessions", "ga4.engaged_sessions", COUNT))),
    ("GA4", "GA4_BEHAVIOR_DAILY_V1", ANALYTICS, "DAY", None, ("date", "deviceCategory"),
     (_USERS, _SESSIONS, _VIEWS, ("screenPageViewsPerUser", "ga4.screen_page_views_per_user", RATIO),
      ("screenPageViewsPerSession", "ga4.screen_page_views_per_session", RATIO), ("engagementRate", "ga4.engagement_rate", RATIO))),
    ("GSC", "GSC_SEARCH_DAILY_V1", SEARCH, "DAY", "final", ("date", "device"), _WEB),
    ("GSC", "GSC_DISCOVER_DAILY_V1", SEARCH, "DAY", "final", ("date", "device"), _DISCOVER),
    ("GSC", "GSC_SEARCH_FRESH_DAILY_V1", SEARCH, "DAY", "all", ("date", "device"), _WEB),
    ("GSC", "GSC_SEARCH_HOURLY_V1", SEARCH, "HOUR", "hourly_all", ("hour", "device"), _WEB),
    ("GAM", "GAM_INVENTORY_HEALTH_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "AD_UNIT_ID", "DEVICE_CATEGORY_NAME", "INVENTORY_FORMAT_NAME"),
     (_AD_REQUESTS, _AD_IMPRESSIONS, ("AD_SERVER_RESPONSES_SERVED", "gam.ad_server_responses_served", COUNT))),
    ("GAM", "GAM_DEMAND_HEALTH_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "DEVICE_CATEGORY_NAME", "DEMAND_CHANNEL_NAME", "PROGRAMMATIC_CHANNEL_NAME"),
     (("AD_EXCHANGE_TOTAL_REQUESTS", "gam.ad_exchange_total_requests", COUNT),
      ("AD_EXCHANGE_PLUS_YIELD_GROUP_IMPRESSIONS", "gam.ad_exchange_plus_yield_group_impressions", COUNT),
      ("AD_EXCHANGE_PLUS_YIELD_GROUP_ECPM", "gam.ad_exchange_plus_yield_group_ecpm", CURRENCY))),
    ("GAM", "GAM_DELIVERY_COMPOSITION_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "DEVICE_CATEGORY_NAME", "LINE_ITEM_TYPE_NAME", "DEMAND_CHANNEL_NAME"),
     (("AD_SERVER_IMPRESSIONS", "gam.delivery_impressions", COUNT), ("AD_EXCHANGE_PLUS_YIELD_GROUP_IMPRESSIONS", "gam.programmatic_impressions", COUNT))),
)
# The same shape with the drill-down code, window mode and required parameters in front.
DRILLDOWNS = (
    ("traffic_by_hour_device_channel", "EXPLICIT_DATES", (), "GA4", "GA4_INCIDENT_TRAFFIC_HOUR_DEVICE_CHANNEL_V1", ANALYTICS, "HOUR", None,
     ("dateHour", "deviceCategory", "sessionDefaultChannelGroup"), (_USERS, _SESSIONS, _VIEWS)),
    ("traffic_by_page_device", "EXPLICIT_DATES", (), "GA4", "GA4_INCIDENT_TRAFFIC_PAGE_DEVICE_V1", ANALYTICS, "DAY", None,
     ("date", "pagePath", "deviceCategory"), (_USERS, _SESSIONS, _VIEWS)),
    ("traffic_by_country_device", "EXPLICIT_DATES", (), "GA4", "GA4_INCIDENT_TRAFFIC_COUNTRY_DEVICE_V1", ANALYTICS, "DAY", None,
     ("date", "country", "deviceCategory"), (_USERS, _SESSIONS, _VIEWS)),
    ("landing_page_by_channel", "EXPLICIT_DATES", (), "GA4", "GA4_INCIDENT_LANDING_PAGE_CHANNEL_V1", ANALYTICS, "DAY", None,
     ("date", "landingPagePlusQueryString", "sessionDefaultChannelGroup"), (_USERS, _SESSIONS, _VIEWS)),
    ("web_by_page_device", "EXPLICIT_DATES", (), "GSC", "GSC_INCIDENT_WEB_PAGE_DEVICE_V1", SEARCH, "DAY", "final",
     ("date", "page", "device"), _WEB),
    ("web_top_queries_for_page", "EXPLICIT_DATES", ("page",), "GSC", "GSC_INCIDENT_WEB_TOP_QUERIES_PAGE_V1", SEARCH, "DAY", "final",
     ("date", "query", "device"), _WEB),
    ("discover_by_page_device", "EXPLICIT_DATES", (), "GSC", "GSC_INCIDENT_DISCOVER_PAGE_DEVICE_V1", SEARCH, "DAY", "final",
     ("date", "page", "device"), _DISCOVER),
    ("ad_unit_by_device", "GAM_PROFILE", (), "GAM", "GAM_INCIDENT_AD_UNIT_DEVICE_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "AD_UNIT_ID", "DEVICE_CATEGORY_NAME"), (_AD_REQUESTS, _AD_IMPRESSIONS)),
    ("demand_channel_by_device", "GAM_PROFILE", (), "GAM", "GAM_INCIDENT_DEMAND_CHANNEL_DEVICE_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "DEMAND_CHANNEL_NAME", "DEVICE_CATEGORY_NAME"), (_AD_IMPRESSIONS,)),
    ("line_item_type_by_device", "GAM_PROFILE", (), "GAM", "GAM_INCIDENT_LINE_ITEM_TYPE_DEVICE_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "LINE_ITEM_TYPE_NAME", "DEVICE_CATEGORY_NAME"), (_AD_IMPRESSIONS,)),
    ("yield_partner_by_ad_unit", "GAM_PROFILE", (), "GAM", "GAM_INCIDENT_YIELD_PARTNER_AD_UNIT_V1", AD_TRAFFIC, "HOUR", None,
     ("DATE", "HOUR", "HBT_YIELD_PARTNER_NAME", "AD_UNIT_ID"),
     (("ATN_HBT_CANDIDATE_BIDS", "gam.atn_hbt_candidate_bids", COUNT), ("ATN_HBT_REJECTED_BIDS", "gam.atn_hbt_rejected_bids", COUNT))),
    ("restriction_by_inventory", "GAM_PROFILE", (), "GAM", "GAM_INCIDENT_RESTRICTION_INVENTORY_V1", AD_SERVER, "HOUR", None,
     ("DATE", "HOUR", "SERVING_RESTRICTION_NAME", "AD_UNIT_ID"), (_AD_REQUESTS, _AD_IMPRESSIONS)),
)
MAX_ROWS = {"GA4": 250_000, "GSC": 50_000, "GAM": 100_000}

DEFINITION_SCHEMA = (
    "source STRING, definition STRING, semantics_version STRING, granularity STRING, data_state STRING, dimensions ARRAY<STRING>, "
    "metrics ARRAY<STRUCT<api_name: STRING, metric_code: STRING, unit: STRING>>"
)


def extract_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row[:5], list(row[5]), list(row[6])) for row in EXTRACTS], DEFINITION_SCHEMA)


def drilldown_catalog(spark: SparkSession) -> DataFrame:
    rows = [(d[0], d[1], list(d[2]), *d[3:8], list(d[8]), list(d[9])) for d in DRILLDOWNS]
    return spark.createDataFrame(rows, "code STRING, window_mode STRING, required_parameters ARRAY<STRING>, " + DEFINITION_SCHEMA)
