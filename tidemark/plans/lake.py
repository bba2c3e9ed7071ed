"""Driver tables and the adapter frames that stand in for the domain tables.

A frame is one SQL text valid in both engines; Spark binds ``{name}`` to DataFrames, so it
stays an ordinary lazy plan with pruning and pushdown into the parquet scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Explicit schemas: no footer inference, and zone-free timestamps read as UTC instants.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


@dataclass(frozen=True)
class Frame:
    sql: str
    arrays: dict[str, tuple[str, ...]] | None = None  # array column -> nullable source columns
    spark_sql: str | None = None  # only where the engines spell a clause differently


FRAMES: dict[str, Frame] = {}


def frame(
    name: str, sql: str, arrays: dict[str, tuple[str, ...]] | None = None, spark_sql: str | None = None
) -> None:
    FRAMES[name] = Frame(sql, arrays, spark_sql)


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in self._cache:
            return self._cache[name]
        if name in TABLES:
            df = self.table(name)
        elif name in FRAMES:
            spec = FRAMES[name]
            text = spec.spark_sql or spec.sql
            inputs = {n: getattr(self, n) for n in set(re.findall(r"\{([a-z_]\w*)\}", text))}
            df = self.spark.sql(text, **inputs)
            for column, parts in (spec.arrays or {}).items():
                df = df.withColumn(column, F.array_compact(F.array(*parts))).drop(*parts)
        else:
            raise AttributeError(name)
        self._cache[name] = df
        return df


frame(
    "points",
    """
    SELECT event_id AS point_id, user_id % 5 AS site,
           concat(event_type, ':', CAST(user_id % 10 AS STRING)) AS series_id,
           CASE WHEN event_type IN ('click', 'purchase') THEN 'GAM' ELSE 'GA4' END AS source,
           CASE event_type WHEN 'click' THEN 'gam.ad_requests' WHEN 'purchase' THEN 'gam.ad_server_impressions'
                WHEN 'view' THEN 'ga4.screen_page_views' WHEN 'signup' THEN 'ga4.sessions'
                ELSE 'ga4.active_users' END AS metric_code,
           CASE WHEN event_type IN ('click', 'purchase') THEN 'gam-historical-v1'
                ELSE 'ga4-core-v1' END AS semantics_version,
           CASE WHEN event_type IN ('click', 'purchase') THEN 'GAM_INVENTORY_HEALTH_V1'
                ELSE 'GA4_TRAFFIC_HOURLY_V1' END AS extract_type,
           concat(event_type, ':', CAST(user_id % 5 AS STRING), ':', CAST(CAST(ts AS DATE) AS STRING)) AS extract_id,
           date_trunc('hour', ts) AS period_start, date_trunc('hour', ts) + INTERVAL '1' HOUR AS period_end,
           ts AS retrieved_at,
           CASE WHEN event_id % 5 = 0 THEN 'PRELIMINARY' ELSE 'MATURE' END AS freshness,
           CASE WHEN event_id % 7 = 0 THEN 'LIMITED' ELSE 'COMPLETE' END AS sample_status,
           CASE WHEN user_id % 5 = 4 AND event_id % 3 = 0 THEN 0.0 ELSE value END AS value,
           CASE WHEN event_id % 7 = 0 THEN 'SAMPLING_APPLIED' END AS lim_a,
           CASE WHEN event_id % 21 = 0 THEN 'OTHER_ROW_DATA_LOSS' END AS lim_b
    FROM {events}
    """,
    {"limitations": ("lim_a", "lim_b")},
)
frame(
    "series",
    """
    SELECT DISTINCT concat(event_type, ':', CAST(user_id % 10 AS STRING)) AS series_id, user_id % 5 AS site,
           CASE WHEN event_type IN ('click', 'purchase') THEN 'GAM' ELSE 'GA4' END AS source,
           CASE WHEN user_id % 10 = 9 THEN 'DAY' ELSE 'HOUR' END AS granularity,
           CASE WHEN event_type = 'purchase' THEN 'CURRENCY' ELSE 'COUNT' END AS unit
    FROM {events}
    """,
)
frame(
    "extracts",
    """
    SELECT concat(event_type, ':', CAST(user_id % 5 AS STRING), ':', CAST(CAST(ts AS DATE) AS STRING)) AS extract_id,
           user_id % 5 AS site,
           CASE WHEN event_type IN ('click', 'purchase') THEN 'GAM' ELSE 'GA4' END AS source,
           CASE WHEN (user_id % 5 + day(CAST(ts AS DATE))) % 9 = 8 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
           max(ts) AS retrieved_at
    FROM {events} GROUP BY 1, 2, 3, 4
    """,
)
frame(
    "connections",
    """
    SELECT s_suppkey AS connection_id, s_nationkey % 5 AS site,
           CASE s_suppkey % 3 WHEN 0 THEN 'GA4' WHEN 1 THEN 'GSC' ELSE 'GAM' END AS provider,
           CASE s_suppkey % 4 WHEN 0 THEN 'CONNECTED' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'AUTH_EXPIRED'
                ELSE 'PERMISSION_ERROR' END AS status,
           CASE s_suppkey % 5 WHEN 0 THEN 'RELATIVE_ONLY' WHEN 1 THEN 'UNKNOWN' ELSE 'ABSOLUTE' END AS visibility,
           s_suppkey % 6 = 0 AS archived,
           CASE WHEN s_suppkey % 7 <> 0
                THEN TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '1' HOUR * CAST(s_suppkey % 20 AS INT) END AS last_success_at
    FROM {supplier}
    """,
)
frame(
    "runs",
    """
    SELECT event_id AS run_id, user_id AS url_id, user_id % 10 AS template_id, user_id % 5 AS site,
           event_id % 2 AS scenario_id,
           date_trunc('hour', ts) - INTERVAL '1' HOUR * CAST(hour(ts) % 6 AS INT) AS scheduled_for,
           ts AS completed_at,
           CASE event_type WHEN 'error' THEN 'SITE_ERROR' WHEN 'signup' THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
           CASE WHEN event_id % 10 = 0 THEN 'DIAGNOSTIC' ELSE 'SCHEDULED' END AS observation_kind,
           CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'v1' ELSE 'v2' END AS collector_version,
           value AS duration_s, event_id % 3 AS attempts
    FROM {events}
    """,
)

frame(
    "hrefs",
    """SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM {pages}""",
    spark_sql="""SELECT page_id, url, explode(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM {pages}""",
)
frame(
    "net",
    """
    SELECT l_orderkey AS run_id, l_orderkey % 5 AS site, l_linenumber AS seq, l_suppkey AS supp,
           concat('https://',
             CASE l_suppkey % 8 WHEN 0 THEN 'securepubads.g.doubleclick.net' WHEN 1 THEN 'Bidder.example.net'
               WHEN 2 THEN 'consent.example.org:8443' WHEN 3 THEN 'www.google-analytics.com' WHEN 4 THEN 'user@player.example.com.'
               WHEN 5 THEN 'cdn.example.com' WHEN 6 THEN 'shop.example.com' ELSE 'site0.example.com' END,
             CASE l_linenumber % 7 WHEN 1 THEN '/gampad/ads' WHEN 2 THEN '/openrtb2/auction'
               WHEN 3 THEN concat('/vast/', CAST(l_partkey AS STRING))
               WHEN 4 THEN concat('/clips/clip-', CAST(l_partkey % 10 AS STRING), '.mp4')
               WHEN 5 THEN concat('/assets/', md5(CAST(l_partkey % 20 AS STRING)), '/app.js')
               ELSE concat('/p/', CAST(l_partkey AS STRING), '/v12345x//Item 7') END,
             '?q=', CAST(l_orderkey AS STRING), '#f') AS url,
           CASE l_linenumber % 4 WHEN 0 THEN 'media' WHEN 1 THEN 'Script' WHEN 2 THEN 'xhr' ELSE '' END AS resource_type,
           CASE WHEN l_quantity < 5 THEN 500 WHEN l_quantity < 10 THEN 404 WHEN l_quantity < 49 THEN 200 END AS status,
           CASE WHEN l_returnflag = 'A' AND l_quantity < 3 THEN 'net::ERR' END AS error_text,
           CASE WHEN l_suppkey % 9 <> 0 THEN l_linenumber * 100 END AS at_ms
    FROM {lineitem}
    """,
)
frame(
    "snapshots",
    """
    SELECT o_orderkey AS snapshot_id, o_custkey AS url_id, o_orderdate AS at, o_orderkey % 11 = 0 AS truncated,
           o_orderpriority AS dom_hash, o_orderstatus AS run_status, o_orderkey % 19 <> 0 AS has_state,
           CASE WHEN o_orderkey % 23 <> 0 THEN 'd1' END AS dom_version, 's1' AS scripts_version,
           CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'n1' ELSE 'n2' END AS network_version,
           CASE WHEN o_orderkey % 29 <> 0 THEN 'j1' END AS javascript_errors_version
    FROM {orders}
    """,
)
frame("members", "SELECT DISTINCT l_orderkey AS snapshot_id, l_partkey % 20 AS member FROM {lineitem}")
frame("netmembers", "SELECT DISTINCT l_orderkey AS snapshot_id, l_suppkey % 20 AS member FROM {lineitem}")
frame(
    "errors",
    "SELECT DISTINCT l_orderkey AS snapshot_id, CAST(l_linenumber AS BIGINT) AS member FROM {lineitem} WHERE l_returnflag = 'R'",
)
frame(
    "netcounts",
    """
    SELECT l_orderkey AS snapshot_id, l_suppkey % 20 AS member,
           CAST(sum(CASE WHEN l_returnflag = 'A' AND l_quantity < 3 THEN 1 ELSE 0 END) AS BIGINT) AS failures,
           CAST(sum(CASE WHEN l_quantity >= 5 AND l_quantity < 10 THEN 1 ELSE 0 END) AS BIGINT) AS status_4xx,
           CAST(sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) AS BIGINT) AS status_5xx
    FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 20
    """,
)
frame(
    "runstates",
    """
    SELECT event_id AS run_id, event_type, ts AS completed_at,
           CASE event_type WHEN 'error' THEN 'SITE_ERROR' WHEN 'signup' THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
           CASE WHEN event_id % 13 <> 0 THEN 's1' END AS scripts_version,
           CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'n1' ELSE 'n2' END AS network_version,
           CASE WHEN event_id % 17 <> 0 THEN 'j1' END AS javascript_errors_version, 'x1' AS seo_version,
           CASE WHEN event_id % 3 = 0 THEN ' NoIndex, follow' WHEN event_id % 3 = 1 THEN 'follow' END AS meta_robots,
           CASE WHEN event_id % 4 <> 0 THEN concat('https://site.example.com/', CAST(event_id % 4 AS STRING)) END AS canonical
    FROM {events}
    """,
)
frame(
    "wruns",
    """
    SELECT event_id AS run_id, user_id % 5 AS site,
           date_trunc('hour', ts) - INTERVAL '1' HOUR * CAST(hour(ts) % 6 AS INT) AS scheduled_for,
           CASE WHEN day(ts) = 20 AND event_id % 2 = 0 THEN 'PENDING' WHEN day(ts) = 21 THEN 'PENDING'
                WHEN event_id % 97 = 0 THEN 'RUNNING' WHEN day(ts) = 9 OR event_id % 5 = 0 THEN 'BROWSER_ERROR' ELSE 'COMPLETE' END AS status
    FROM {events}
    """,
)
frame(
    "wwindows",
    """
    SELECT DISTINCT site, scheduled_for FROM {wruns}
    UNION SELECT DISTINCT site, scheduled_for + INTERVAL '60' DAY FROM {wruns}
    """,
)
frame(
    "slots",
    """
    SELECT o.o_orderkey AS snapshot_id, CAST(c.c_nationkey AS BIGINT) AS template_id, o.o_orderkey % 2 AS scenario_id, o.o_custkey AS url_id,
           o.o_orderdate AS at, date_trunc('month', o.o_orderdate) AS window_id, CAST(l.l_linenumber AS BIGINT) AS slot,
           min(CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END) = 1 AS present
    FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey
    GROUP BY 1, 2, 3, 4, 5, 6, 7
    """,
)
frame(
    "actions",
    """
    SELECT o_custkey AS condition_key, o_orderdate AS at, o_orderkey AS run_id, 0 AS seq,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'UPSERT' WHEN '2-HIGH' THEN 'UPSERT' WHEN '5-LOW' THEN 'RESOLVE' ELSE 'SUPPORT' END AS action,
           CASE o_orderstatus WHEN 'F' THEN 'LOW' WHEN 'O' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
           o_orderkey % 5 AS affected_count, o_orderkey % 5 + o_orderkey % 3 AS valid_count
    FROM {orders}
    UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, 1, CASE o_orderkey % 4 WHEN 0 THEN 'UPSERT' WHEN 1 THEN 'SUPPORT' WHEN 2 THEN 'RESOLVE' ELSE 'UPSERT' END,
           'CRITICAL', o_orderkey % 7, o_orderkey % 7 + 1
    FROM {orders} WHERE o_custkey % 2 = 0
    """,
)
frame(
    "adsactions",
    """
    SELECT o_custkey % 50 AS site, o_orderdate AS at, o_orderkey AS run_id,
           CASE o_orderkey % 3 WHEN 0 THEN 'ADS_TXT_MISSING' WHEN 1 THEN 'ADS_TXT_EMPTY_200' ELSE 'ADS_TXT_INVALID' END AS code,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'UPSERT' WHEN '5-LOW' THEN 'RESOLVE' ELSE 'SUPPORT' END AS action,
           'HIGH' AS severity, CAST(1 AS BIGINT) AS affected_count, CAST(1 AS BIGINT) AS valid_count
    FROM {orders}
    """,
)
frame(
    "observations",
    """
    SELECT user_id % 5 AS site, date_trunc('hour', ts) AS at, event_id AS run_id,
           CASE event_type WHEN 'error' THEN 'DEGRADED' WHEN 'click' THEN 'CHALLENGE' ELSE 'OK' END AS state
    FROM {events} WHERE event_type IN ('error', 'click', 'signup')
    """,
)
frame(
    "refs",
    """
    SELECT l_orderkey AS event_id, l_linenumber * 1000000 + l_partkey AS ref_id, l_suppkey * 137 + l_linenumber AS source_id,
           CASE l_returnflag WHEN 'A' THEN 'TRIGGER_AFTER' WHEN 'R' THEN 'BEFORE' ELSE 'SUPPORTING' END AS relation
    FROM {lineitem}
    """,
)
frame(
    "auction_events",
    """
    SELECT user_id AS run_id, concat(CAST(user_id AS STRING), ':', CAST(CAST(ts AS DATE) AS STRING)) AS auction_key, event_id AS seq,
           CASE WHEN event_id % 11 = 0 THEN 'auctionEnd' WHEN event_id % 13 = 0 THEN 'noBid' WHEN event_id % 59 = 0 THEN 'auctionTimeout'
                WHEN event_type = 'signup' THEN 'auctionInit' WHEN event_type = 'click' THEN 'bidRequested' WHEN event_type = 'view' THEN 'bidResponse'
                WHEN event_type = 'error' THEN 'bidTimeout' ELSE 'bidWon' END AS event_type,
           CASE WHEN event_id % 17 <> 0 THEN CAST(hour(ts) * 60 + minute(ts) AS BIGINT) END AS elapsed_ms,
           event_id % 4 * 500 AS timeout_ms, event_id % 3 AS ad_units, value AS response_ms,
           CASE WHEN event_id % 19 = 0 THEN 'bad bidder' ELSE concat('bidder-', CAST(event_id % 4 AS STRING)) END AS bidder
    FROM {events}
    """,
)
frame(
    "run_auctions",
    """
    SELECT o_orderkey AS run_id, concat('a', CAST(o_custkey AS STRING)) AS auction_key,
           CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 8 * 100 END AS ended_ms, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 4 * 100 END AS started_ms
    FROM {orders}
    UNION ALL SELECT o_orderkey, 'b', o_custkey % 6 * 100, CAST(0 AS BIGINT) FROM {orders} WHERE o_orderstatus = 'F'
    """,
)
frame(
    "consents",
    """
    SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 7 * 100 END AS boundary_ms,
           CASE WHEN o_orderstatus = 'F' THEN 'REJECT' ELSE 'ACCEPT' END AS consent_path
    FROM {orders}
    """,
)
frame(
    "players",
    """
    SELECT o_orderkey AS run_id, 'p1' AS player FROM {orders} WHERE o_orderkey % 3 > 0
    UNION ALL SELECT o_orderkey, 'p2' FROM {orders} WHERE o_orderkey % 3 = 2
    """,
)
frame(
    "shifts",
    """
    SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS t,
           CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value / 1000 END AS v, event_id % 50 AS interaction_id, value AS duration_ms
    FROM {events}
    """,
)
frame(
    "slot_entries",
    """
    SELECT l_orderkey AS run_id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS pos,
           CASE WHEN l_returnflag <> 'R' THEN concat('/net/', CAST(l_partkey % 6 AS STRING)) END AS ad_unit_path,
           CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN concat('slot-', CAST(l_suppkey % 6 AS STRING)) END AS element_id,
           CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS BIGINT) END AS requested_ms
    FROM {lineitem}
    """,
)
frame(
    "validity",
    """
    SELECT s_nationkey AS template_id, concat('gpt|ad-unit|/net/', CAST(s_suppkey % 8 AS STRING)) AS stable_key, s_suppkey AS validity_id,
           TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey * 37 % 1500 AS INT) AS valid_from,
           CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '1996-06-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey * 53 % 2000 AS INT) END AS valid_to
    FROM {supplier}
    """,
)
frame(
    "template_runs",
    "SELECT o.o_orderkey AS run_id, c.c_nationkey AS template_id, o.o_orderdate AS at FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey",
)
frame(
    "access_runs",
    """
    SELECT page_id AS run_id, page_id % 13 = 0 AS navigation_failed,
           CASE WHEN page_id % 5 = 0 THEN concat(html, ' Access Denied by policy') WHEN page_id % 7 = 0 THEN concat('CAPTCHA access denied', html) ELSE html END AS body,
           CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 503 END AS http_status
    FROM {pages}
    """,
)
frame(
    "jobs",
    """
    SELECT o.o_orderkey AS job_id, o.o_custkey % 40 AS tenant, o.o_orderdate AS created_at,
           CASE WHEN o.o_orderkey % 17 <> 0 THEN o.o_orderdate + INTERVAL '1' DAY END AS started_at, l.finished_at,
           CASE WHEN o.o_orderkey % 17 = 0 THEN 'PENDING' WHEN o.o_orderstatus = 'F' THEN 'COMPLETE' WHEN o.o_orderstatus = 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
           CASE WHEN o.o_orderkey % 5 <> 0 THEN o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_orderkey % 900 AS INT) END AS lock_expires_at
    FROM {orders} o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS finished_at FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
    """,
)
frame(
    "retention_runs",
    """
    SELECT o_orderkey AS run_id, o_custkey % 40 AS tenant, o_orderdate AS started_at,
           CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 60 AS INT) END AS finished_at
    FROM {orders} WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'
    """,
)
frame(
    "artifacts",
    """
    SELECT o_orderkey AS artifact_id, o_orderkey % 9973 AS run_id,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'SCREENSHOT_VIEWPORT' WHEN '2-HIGH' THEN 'RAW_DOM' WHEN '3-MEDIUM' THEN 'SCREENSHOT_FULL_PAGE'
                WHEN '5-LOW' THEN 'HAR_LOG' ELSE 'SCREENSHOT_VIEWPORT_PRECONSENT' END AS artifact_type,
           CASE WHEN o_orderkey % 3 = 0 THEN 'DERIVED' ELSE 'RAW_MEDIUM' END AS retention_class, o_orderdate AS created_at
    FROM {orders}
    """,
)
frame(
    "holds",
    """
    SELECT l_orderkey AS artifact_id, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS released_at FROM {lineitem} WHERE l_returnflag = 'R'
    """,
)
frame(
    "ledger",
    """
    SELECT event_id AS entry_id, user_id % 5 AS site, ts AS occurred_at,
           date_trunc('hour', ts) - INTERVAL '1' HOUR * CAST(hour(ts) % 6 AS INT) AS window_start,
           concat(CAST(user_id % 5 AS STRING), '|', CAST(date_trunc('hour', ts) - INTERVAL '1' HOUR * CAST(hour(ts) % 6 AS INT) AS STRING)) AS scope,
           CASE event_type WHEN 'error' THEN 'DIAGNOSTIC_RUN' WHEN 'signup' THEN 'DRILLDOWN' ELSE 'CHECKPOINT_RUN' END AS resource_kind,
           CAST(user_id AS STRING) AS usage_key, event_id % 3 AS amount
    FROM {events}
    """,
)
frame(
    "requests",
    """
    SELECT user_id % 3 AS connection_id, user_id % 11 AS investigation_id, concat(event_type, ':', CAST(user_id AS STRING), ':', CAST(event_id % 2 AS STRING)) AS request_key,
           event_id AS seq, CAST(CAST(ts AS DATE) AS STRING) AS day
    FROM {events}
    """,
)
frame(
    "samples",
    """
    SELECT CAST(l_shipdate AS DATE) AS snapshot, concat('browser-worker-', CAST(l_suppkey % 3 AS STRING)) AS container,
           concat(CAST(l_quantity AS STRING), 'MiB / 512MiB') AS memory, l_quantity, l_discount * 100 AS cpu_pct
    FROM {lineitem}
    """,
)
frame(
    "incidents",
    """
    SELECT c_custkey AS incident_id, CAST(c_nationkey AS BIGINT) AS tenant, c_custkey % 5 AS site,
           CASE WHEN c_custkey % 23 = 0 THEN ' ' ELSE c_name END AS title,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'VIDEO' WHEN 'MACHINERY' THEN 'SEARCH_DISCOVER' WHEN 'HOUSEHOLD' THEN 'GAM_ADSERVING' WHEN 'AUTOMOBILE' THEN 'CONSENT_CMP' ELSE 'UNKNOWN_FAMILY' END AS symptom_family,
           CASE WHEN c_custkey % 29 <> 0 THEN concat('balance ', CAST(CAST(c_acctbal AS BIGINT) AS STRING)) ELSE '' END AS description,
           CASE c_custkey % 6 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'RESOLVED' WHEN 3 THEN 'CLOSED_UNRESOLVED' WHEN 4 THEN 'OPEN' ELSE 'ARCHIVED' END AS status,
           TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 700 AS INT) AS opened_at,
           CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey * 7 % 720 AS INT) END AS onset,
           CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey * 11 % 900 AS INT) END AS ended
    FROM {customer}
    """,
)
frame(
    "configs",
    """
    SELECT o_orderkey AS snapshot_id, o_custkey % 60 AS site, CASE o_custkey % 2 WHEN 0 THEN 'ADS_TXT' ELSE 'ROBOTS_TXT' END AS config_type,
           o_orderdate AS observed_at,
           CASE o_orderstatus WHEN 'F' THEN 'VALID' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'EMPTY' ELSE 'INVALID' END
                ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'VALID_WITH_WARNINGS' ELSE 'MISSING' END END AS parse_status,
           CASE WHEN o_orderkey % 4 = 0 THEN 'VALIDATION' ELSE 'SCHEDULED' END AS fetch_kind,
           CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN o_orderpriority END AS semantic_hash,
           o_orderpriority IN ('1-URGENT', '2-HIGH') AS broad_blocked,
           CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'c1' ELSE 'c2' END AS normalizer_version
    FROM {orders}
    """,
)
frame(
    "urls",
    """
    SELECT user_id AS url_id, user_id % 5 AS site, min(ts) AS valid_from, CASE WHEN user_id % 4 = 0 THEN max(ts) - INTERVAL '5' DAY END AS valid_to
    FROM {events} GROUP BY user_id
    """,
)
frame(
    "sites",
    """
    SELECT DISTINCT user_id % 5 AS site, CASE WHEN user_id % 5 = 3 THEN 'OFF' ELSE 'ON' END AS monitoring_state,
           TIMESTAMP '2024-01-03 00:00:00' + INTERVAL '1' HOUR * CAST(user_id % 5 * 7 AS INT) AS enabled_at, 'UTC' AS zone
    FROM {events}
    """,
)
FAMILY = "CASE {0} % 4 WHEN 0 THEN 'VIDEO' WHEN 1 THEN 'GAM_ADSERVING' WHEN 2 THEN 'SEARCH_DISCOVER' ELSE 'CONSENT_CMP' END"
frame("hyp_families", f"SELECT c_custkey AS incident_id, {FAMILY.format('c_custkey')} AS family FROM {{customer}}")
frame(
    "hyp_events",
    f"SELECT o_custkey AS incident_id, {FAMILY.format('o_orderkey')} AS family, o_orderpriority IN ('1-URGENT', '2-HIGH') AS supports, o_orderkey AS evidence_id "
    "FROM {orders} WHERE o_orderstatus <> 'P'",
)
frame(
    "hyp_relations",
    f"SELECT o_custkey AS incident_id, {FAMILY.format('o_orderkey')} AS from_family, {FAMILY.format('(o_orderkey + o_custkey % 3)')} AS to_family, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'PRECEDES' ELSE 'CONTRADICTS' END AS relation_type FROM {orders} WHERE o_orderstatus = 'P'",
)
frame("hyp_gaps", "SELECT o_custkey AS incident_id, concat('run ', CAST(o_orderkey % 3 AS STRING)) AS description FROM {orders} WHERE o_orderkey % 13 = 0")
frame("hyp_notes", "SELECT o_custkey AS incident_id, o_orderkey AS note_id FROM {orders} WHERE o_orderkey % 17 = 0")
frame(
    "edges",
    """
    SELECT l_orderkey * 8 + l_linenumber AS edge_id, l_partkey % 500 AS from_id, l_suppkey * 5 % 500 AS to_id,
           CASE l_linenumber WHEN 1 THEN 'PRECEDES' WHEN 2 THEN 'SUPPORTS' WHEN 3 THEN 'CONTRADICTS' WHEN 4 THEN 'CAUSES' ELSE 'COINCIDES_WITH' END AS relation_type,
           concat('r', CAST(l_orderkey % 3 AS STRING)) AS engine_version, l_shipdate AS at, l_orderkey % 60 AS site
    FROM {lineitem}
    """,
)
frame(
    "machine_events",
    """
    SELECT user_id % 5 AS site, ts AS at, event_id AS id, event_type AS detail, CASE WHEN event_id % 2 = 0 THEN 'EXACT' ELSE 'WINDOW' END AS precision, ts AS occurred_before
    FROM {events}
    """,
)
frame(
    "human_notes",
    """
    SELECT o_custkey % 5 AS site, o_orderdate + INTERVAL '1' DAY * 9500 AS at, o_orderkey AS id, o_orderpriority AS detail FROM {orders}
    """,
)
frame(
    "corpus",
    """
    SELECT d.doc_id AS incident_id, d.source, d.lang, d.n_chars AS evidence_score,
           CASE WHEN l.quality = 1 THEN 'confirmed' WHEN l.quality = 0 THEN 'suspected' ELSE 'unknown' END AS root_cause_status,
           CASE WHEN l.toxic = 1 THEN 'hard' WHEN l.toxic = 0 THEN 'easy' ELSE 'open' END AS difficulty
    FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
    """,
)
frame(
    "pack_incidents",
    """
    SELECT c_custkey AS incident_id, c_custkey % 60 AS site, concat(c_name, ' ', c_mktsegment) AS incident_text,
           TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey * 7 % 1500 AS INT) AS window_start,
           TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '1' DAY * CAST(c_custkey * 7 % 1500 + 30 + c_custkey % 40 AS INT) AS window_end
    FROM {customer}
    """,
)
frame("pack_runs", "SELECT l_orderkey % 60 AS site, l_shipdate AS at, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS id, concat(CAST(l_orderkey AS STRING), ':', l_returnflag) AS entry FROM {lineitem}")
frame("pack_configs", "SELECT o_custkey % 60 AS site, o_orderdate AS at, o_orderkey AS id, concat(CAST(o_orderkey AS STRING), ':', o_orderstatus) AS entry FROM {orders}")
frame("pack_events", "SELECT o_orderkey % 60 AS site, o_orderdate AS at, o_orderkey AS id, concat(CAST(o_orderkey AS STRING), ':', o_orderpriority) AS entry FROM {orders}")
frame("pack_relations", "SELECT o_custkey % 60 AS site, o_orderdate AS at, o_orderkey AS id, concat('relation ', CAST(o_orderkey AS STRING), ' to ', CAST(o_custkey AS STRING), ' engine version r1 confidence MEDIUM, derived on one day') AS entry FROM {orders} WHERE o_orderstatus = 'P'")
frame("pack_notes", "SELECT o_custkey % 60 AS site, o_orderdate AS at, o_orderkey AS id, concat('note ', CAST(o_orderkey AS STRING), ' human_reported by operator, type CONFIG_CHANGE, text ', o_orderpriority) AS entry FROM {orders} WHERE o_orderpriority = '1-URGENT'")
frame(
    "drill_requests",
    """
    SELECT event_id AS request_id, event_id % 13 AS pick, CAST(ts AS DATE) AS start_date,
           CAST(CAST(ts AS DATE) + INTERVAL '1' DAY * CAST(event_id % 9 AS INT) AS DATE) AS end_date, user_id
    FROM {events}
    """,
)
frame(
    "entity_obs",
    "SELECT l_orderkey % 60 AS site, CASE WHEN l_linenumber % 2 = 0 THEN 'SCRIPT' ELSE 'SLOT' END AS kind, concat('k', CAST(l_partkey % 50 AS STRING)) AS stable_key, l_shipdate AS at FROM {lineitem}",
)
frame(
    "config_obs",
    """
    SELECT o_orderkey AS snapshot_id, o_custkey % 40 AS site, CASE o_custkey % 2 WHEN 0 THEN 'ADS_TXT' ELSE 'ROBOTS_TXT' END AS config_type,
           CAST(CAST(o_orderdate AS DATE) AS STRING) AS source_key, o_orderdate AS at
    FROM {orders}
    """,
)
frame(
    "extract_log",
    """
    SELECT o_orderkey AS extract_id, o_custkey % 40 AS connection_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS run_key, o_orderstatus AS definition,
           CASE WHEN o_orderkey % 3 = 0 THEN 'q1' ELSE 'q2' END AS query, 'MATURE' AS freshness
    FROM {orders}
    """,
)
frame(
    "ads_files",
    """
    SELECT s_suppkey AS file_id, s_suppkey % 7 AS variant,
           CASE s_suppkey % 7
             WHEN 0 THEN concat('# head', chr(10), 'ad', CAST(s_suppkey AS STRING), '.Example.com, acct-', CAST(s_nationkey AS STRING), ' , direct # inline', chr(13), chr(10), chr(10),
                                'other.example.org,7,RESELLER,CERT9', chr(10))
             WHEN 1 THEN concat('dup.example.com,1,DIRECT', chr(10), 'DUP.example.com , 1, direct', chr(10), 'bad line', chr(10), 'x.example.com,,DIRECT')
             WHEN 2 THEN concat('OWNERDOMAIN=own', CAST(s_suppkey AS STRING), '.example.com', chr(10), 'ownerdomain = second.example.com', chr(10), 'MANAGERDOMAIN=man.example.com, us', chr(10),
                                'CONTACT=', chr(10), 'a.example.com,1,DIRECT,')
             WHEN 3 THEN concat('   ', chr(10), '# only comments')
             WHEN 4 THEN 'localhost,1,DIRECT'
             WHEN 5 THEN concat('b.example.com,', CAST(s_suppkey AS STRING), ',OWNER', chr(10), 'b.example.com,2,RESELLER')
             ELSE concat('MANAGERDOMAIN=m.example.com,usa', chr(10), 'SUBDOMAIN=nope', chr(10), 'c.example.com,3,DIRECT') END AS text
    FROM {supplier}
    """,
)
frame(
    "robots_files",
    """
    SELECT n_nationkey AS file_id, n_nationkey % 5 AS variant,
           CASE n_nationkey % 5
             WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'User-agent: GoodBot', chr(10), 'Allow: /')
             WHEN 1 THEN concat('Disallow: /early', chr(10), 'User-agent: *', chr(10), 'User-agent: Slow', chr(10), 'Disallow: /p/', chr(10), 'Allow: /p/1', chr(10), 'Disallow: /*.pdf$', chr(10),
                                'User-agent: Slow', chr(10), 'Disallow: /%7etmp', chr(10), 'Disallow: nope')
             WHEN 2 THEN concat('# nothing', chr(10))
             WHEN 3 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'User-agent: GoodBot', chr(10), 'Disallow: /p/', chr(10), 'just text', chr(10), 'Sitemap: https://x.example.com/s.xml')
             ELSE concat('Allow: /x', chr(10), 'User-agent: bad agent 9') END AS text
    FROM {nation}
    """,
)
frame(
    "robots_urls",
    """
    SELECT o_orderkey AS url_id, CAST(o_custkey % 25 AS INT) AS file_id, CASE o_orderkey % 3 WHEN 0 THEN 'GoodBot/2.1' WHEN 1 THEN 'slowcrawler' ELSE 'other' END AS user_agent,
           CASE o_orderkey % 6 WHEN 0 THEN '/' WHEN 1 THEN concat('/p/', CAST(o_orderkey % 20 AS STRING)) WHEN 2 THEN '/a/b.pdf' WHEN 3 THEN '/~tmp/x' WHEN 4 THEN '/a/b.pdf?x=1' ELSE '/q' END AS path
    FROM {orders}
    """,
)
# One rule per supplier and part, and from these the files as text: prefixes, exceptions, wildcards and end anchors for two agents.
frame(
    "site_rules",
    """
    SELECT DISTINCT l_suppkey AS file_id, CASE WHEN l_partkey % 5 = 0 THEN 'goodbot' ELSE '*' END AS agent, CASE WHEN l_partkey % 4 = 1 THEN 'allow' ELSE 'disallow' END AS directive,
           CASE l_partkey % 4 WHEN 0 THEN concat('/p/', CAST(CAST(floor(l_partkey / 10) AS BIGINT) AS STRING)) WHEN 1 THEN concat('/p/', CAST(l_partkey AS STRING))
             WHEN 2 THEN concat('/p/*/', CAST(l_partkey % 50 AS STRING), '$') ELSE concat('/q/', CAST(l_partkey % 30 AS STRING), '*.html') END AS pattern
    FROM {lineitem}
    """,
)
frame(
    "site_files",
    """
    SELECT file_id, string_agg(block, chr(10) ORDER BY agent) AS text FROM (SELECT file_id, agent, concat('User-agent: ', agent, chr(10), string_agg(concat(directive, ': ', pattern), chr(10) ORDER BY pattern, directive)) AS block
        FROM {site_rules} GROUP BY file_id, agent) AS blocks GROUP BY file_id
    """,
    spark_sql="""
    SELECT file_id, listagg(block, '\n') WITHIN GROUP (ORDER BY agent) AS text FROM (SELECT file_id, agent, concat('User-agent: ', agent, chr(10), listagg(concat(directive, ': ', pattern), '\n') WITHIN GROUP (ORDER BY concat(directive, ': ', pattern))) AS block
        FROM {site_rules} GROUP BY file_id, agent) AS blocks GROUP BY file_id
    """,
)
frame(
    "site_urls",
    """
    SELECT o_orderkey AS url_id, o_custkey % 110 + 1 AS file_id, CASE o_orderkey % 4 WHEN 0 THEN 'GoodBot/2.1' WHEN 1 THEN NULL ELSE 'other' END AS user_agent,
           CASE o_orderkey % 5 WHEN 0 THEN concat('/p/', CAST(o_orderkey % 2100 AS STRING)) WHEN 1 THEN concat('/p/', CAST(o_orderkey % 2100 AS STRING), '/', CAST(o_custkey % 50 AS STRING))
             WHEN 2 THEN concat('/q/', CAST(o_custkey % 30 AS STRING), '/a.html?x=1') WHEN 3 THEN concat('/q/', CAST(o_custkey % 30 AS STRING), '/a.htm') ELSE '/' END AS path
    FROM {orders}
    """,
)
frame(
    "fetches",
    """
    SELECT o_orderkey AS fetch_id, CASE o_orderkey % 2 WHEN 0 THEN 'ADS_TXT' ELSE 'ROBOTS_TXT' END AS config_type,
           CASE WHEN o_orderkey % 17 = 0 THEN 'PUBLIC_CONFIG_TOO_LARGE' WHEN o_orderkey % 19 = 0 THEN 'PUBLIC_CONFIG_SECURITY_ERROR' WHEN o_orderkey % 23 = 0 THEN 'TIMEOUT' END AS error_code,
           CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 500 ELSE 403 END AS http_status
    FROM {orders}
    """,
)
