"""Scalar rules over whole tables: URLs, text masking, identities, zones and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogs import event_rules
from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.functions import times as Z
from tidemark.functions import urls as U
from tidemark.functions.hashing import canonical_hash, uuid_from_hash
from tidemark.functions.shape import big, r6, ts_text
from tidemark.plans.lake import frame
from tidemark.plans.registry import query

C = F.col


def sql_mask(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)(?:[0-9a-f]{{{{8}}}}-[0-9a-f-]{{{{27,}}}}|\\b[0-9a-f]{{{{12,}}}}\\b)', ':token', 'g'),"
        f" '\\d{{{{4,}}}}', ':number', 'g'), '\\s+', ' ', 'g'))"
    ).replace("{{", "{").replace("}}", "}")


def sql_family(x: str) -> str:
    parts = (
        f"array_to_string(list_transform(list_filter(string_split({x}, '/'), lambda p: p <> ''), lambda p: "
        "CASE WHEN regexp_full_match(p, '(?i)(?:\\d+|[0-9a-f]{12,}|[0-9a-f-]{32,})') THEN ':id' ELSE "
        + sql_mask("p") + " END), '/')"
    )
    return f"(SELECT CASE WHEN length(w) > 500 THEN substr(w, 1, 480) || '~' || substr(sha256(w), 1, 16) ELSE w END FROM (SELECT '/' || {parts} AS w))"


def sql_host(x: str) -> str:
    return (
        f"nullif(regexp_replace(lower(regexp_extract(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), "
        "'^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)', 1)), '\\.+$', ''), '')"
    )


def sql_path(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//[^/?#]*([^?#]*)', 1)"


def sql_category(h: str, p: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains(v, $${n}$$)' for n in needles)} THEN '{name}'" for name, needles in U.CATEGORIES
    ).replace("$$", "'")
    return f"(SELECT CASE {cases} ELSE 'UNKNOWN' END FROM (SELECT lower({h} || {p}) AS v))"


def sql_type(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 'other' ELSE lower({x}) END)"


def sql_key(u: str, k: str) -> str:
    return f"({sql_host(u)} || '|' || {sql_family(sql_path(u))} || '|' || {sql_type(k)})"


@query("path_family", f"SELECT family, B(count(*)) AS uses FROM (SELECT {sql_family(sql_path('url'))} AS family FROM {{net}}) GROUP BY 1")
def path_family(t):
    return t.net.groupBy(T.path_family(U.path(C("url"))).alias("family")).agg(F.count("*").alias("uses"))


@query("mask_volatile", f"SELECT B(event_id) AS event_id, {sql_mask('msg')} AS masked FROM (SELECT event_id, concat(props, '  ', md5(props), ' near ', event_id) AS msg FROM events)")
def mask_volatile(t):
    msg = F.concat(C("props"), F.lit("  "), F.md5("props"), F.lit(" near "), C("event_id").cast("string"))
    return t.events.select("event_id", T.mask_volatile(msg).alias("masked"))


@query(
    "safe_tokens",
    f"""SELECT B(conv_id) AS conv_id, B(turn) AS turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(
        regexp_split_to_array(trim(text), '\\s+'), lambda r: regexp_replace({sql_mask('r')}, '[^a-zA-Z0-9_:-]+', '', 'g')),
        lambda x: x <> ''))), ' '), '') AS tokens FROM conversations""",
)
def safe_tokens(t):
    return t.conversations.select("conv_id", "turn", T.safe_tokens(C("text")).alias("tokens"))


@query("dependency_key", f"SELECT k AS stable_key, B(count(*)) AS uses FROM (SELECT {sql_key('url', 'resource_type')} AS k FROM {{net}}) GROUP BY 1")
def dependency_key(t):
    return t.net.groupBy(U.dependency_key(C("url"), C("resource_type")).alias("stable_key")).agg(F.count("*").alias("uses"))


@query("dependency_category", f"""SELECT host, category, B(count(*)) AS uses FROM (SELECT host, {sql_category('host', 'p')} AS category
    FROM (SELECT {sql_host('url')} AS host, {sql_path('url')} AS p FROM {{net}})) GROUP BY ALL""")
def dependency_category(t):
    return t.net.groupBy(
        U.host(C("url")).alias("host"), U.dependency_category(U.host(C("url")), U.path(C("url"))).alias("category")
    ).agg(F.count("*").alias("uses"))


SQL_VAST = "regexp_matches(lower(p), '(?:^|[/_.-])(vast|vmap|video-?ad|ad-?tag)(?:[/_.-]|$)')"
SQL_MEDIA = "(resource_type = 'media' OR regexp_matches(lower(p), '\\.(m3u8|m4s|mp4|mpd|ogg|ogv|ts|webm)$'))"
SQL_AD = "(regexp_matches(h, 'doubleclick|googlesyndication|securepubads') OR contains(lower(p), '/gampad/ads'))"
SQL_BID = "(contains(lower(p), '/openrtb2/auction') OR contains(lower(p), '/openrtb2/amp'))"
frame("netparts", f"SELECT *, {sql_host('url')} AS h, {sql_path('url')} AS p FROM {{net}}", spark_sql="SELECT * FROM {net}")


@query("network_class", f"""SELECT vast, media, ad_server, bid_server, B(count(*)) AS requests FROM (SELECT {SQL_VAST} AS vast,
    {SQL_MEDIA} AND NOT {SQL_VAST} AS media, {SQL_AD} AS ad_server, {SQL_BID} AS bid_server FROM {{netparts}}) GROUP BY ALL""")
def network_class(t):
    h, p = U.host(C("url")), U.path(C("url"))
    return t.net.groupBy(
        U.is_vast(p).alias("vast"), (U.is_media(p, C("resource_type")) & ~U.is_vast(p)).alias("media"),
        U.is_ad_server(h, p).alias("ad_server"), U.is_bid_server(p).alias("bid_server"),
    ).agg(F.count("*").alias("requests"))


@query("third_party_hosts", """SELECT DISTINCT B(site) AS site, h AS host FROM (SELECT site, h, CASE site WHEN 0 THEN 'example.com' ELSE 'site0.example.com' END AS d
    FROM {netparts}) WHERE h <> d AND NOT ends_with(h, '.' || d)""")
def third_party_hosts(t):
    domain = F.when(C("site") == 0, "example.com").otherwise("site0.example.com")
    host = U.host(C("url"))
    return t.net.where(U.is_third_party(host, domain)).select(big("site").alias("site"), host.alias("host")).distinct()


@query("canonical_hash", "SELECT B(event_id) AS event_id, sha256(concat_ws('|', event_type, user_id::VARCHAR, TS(ts))) AS identity FROM events")
def canonical_hash_query(t):
    return t.events.select("event_id", canonical_hash("event_type", "user_id", ts_text("ts")).alias("identity"))


@query("event_id", """SELECT B(o_orderkey) AS o_orderkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
    substr('89ab', CAST('0x' || substr(d, 17, 1) AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS event_id
    FROM (SELECT o_orderkey, sha1(concat_ws('|', 'ADS_TXT_CHANGED', o_custkey::VARCHAR, o_orderkey::VARCHAR)) AS d FROM orders)""")
def event_id(t):
    return t.orders.select("o_orderkey", uuid_from_hash(F.lit("ADS_TXT_CHANGED"), "o_custkey", "o_orderkey").alias("event_id"))


def sql_utc(local: str, zone: str) -> str:
    return f"timezone('UTC', timezone('{zone}', {local}))"


def sql_local(ts: str, zone: str) -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


@query("local_hour_to_utc", f"""SELECT B(event_id) AS event_id, TS({sql_utc("date_trunc('hour', ts)", 'Europe/Bucharest')}) AS wall_start,
    TS({sql_utc("date_trunc('hour', ts) + INTERVAL '1' HOUR", 'Europe/Bucharest')}) AS wall_end,
    TS({sql_utc("date_trunc('hour', ts)", 'America/Los_Angeles')}) AS server_start,
    TS({sql_utc("date_trunc('hour', ts)", 'America/Los_Angeles')} + INTERVAL '1' HOUR) AS server_end, false AS ambiguous,
    TS(date_trunc('hour', ts) + INTERVAL '8' HOUR) AS search_start, true AS search_valid FROM events""")
def local_hour_to_utc(t):
    local = F.date_trunc("hour", "ts")
    wall, server = Z.wall_interval(local, "Europe/Bucharest", "HOUR"), Z.ad_server_hour(local, "America/Los_Angeles")
    search = Z.search_hour(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00")))
    return t.events.select(
        "event_id", ts_text(wall["period_start"]).alias("wall_start"), ts_text(wall["period_end"]).alias("wall_end"),
        ts_text(server["period_start"]).alias("server_start"), ts_text(server["period_end"]).alias("server_end"),
        server["ambiguous"].alias("ambiguous"), ts_text(search["period_start"]).alias("search_start"), search["valid"].alias("search_valid"),
    )


def sql_floor(zone: str, n: int) -> str:
    local = sql_local("ts", zone)
    return f"(date_trunc('hour', {local}) - INTERVAL '1' HOUR * CAST(hour({local}) % {n} AS INT))"


@query("six_hour_window", f"""SELECT TS(s) AS window_start, TS(e) AS window_end, B(count(*)) AS events FROM (SELECT
    {sql_utc(sql_floor('Europe/Bucharest', 6), 'Europe/Bucharest')} AS s, {sql_utc(sql_floor('Europe/Bucharest', 6) + " + INTERVAL '6' HOUR", 'Europe/Bucharest')} AS e
    FROM events) GROUP BY ALL""")
def six_hour_window(t):
    window = Z.six_hour_window(C("ts"), "Europe/Bucharest")
    return t.events.groupBy(ts_text(window["window_start"]).alias("window_start"), ts_text(window["window_end"]).alias("window_end")).agg(
        F.count("*").alias("events")
    )


@query("slot", "SELECT B(event_id) AS event_id, " + ", ".join(
    f"TS({sql_utc(sql_floor('America/Los_Angeles', n), 'America/Los_Angeles')}) AS slot_{n}" for n in (2, 4, 6)) + " FROM events")
def slot(t):
    return t.events.select("event_id", *[ts_text(Z.slot(C("ts"), "America/Los_Angeles", n)).alias(f"slot_{n}") for n in (2, 4, 6)])


@query("next_boundary", f"""SELECT B(event_id) AS event_id, CASE WHEN event_type <> 'error' THEN
    TS({sql_utc(sql_floor('Europe/Bucharest', 6) + " + INTERVAL '6' HOUR", 'Europe/Bucharest')}) END AS next_boundary FROM events""")
def next_boundary(t):
    state = F.when(C("event_type") == "error", "OFF").otherwise("ON")
    return t.events.select("event_id", ts_text(Z.next_boundary(state, C("ts"), "Europe/Bucharest")).alias("next_boundary"))


@query("robots_directives", """SELECT B(conv_id) AS conv_id, B(turn) AS turn, coalesce(array_to_string(list_sort(list_filter(list_transform(
    string_split(text, ','), lambda p: lower(trim(p))), lambda p: p <> '')), '|'), '') AS directives FROM conversations""")
def robots_directives(t):
    return t.conversations.select("conv_id", "turn", F.array_join(T.directives(C("text")), "|").alias("directives"))


_SCHEME = "'^([A-Za-z][A-Za-z0-9+.\\-]*):'"
_AUTH = "'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)'"
@query("canonical_url", f"""WITH a AS (SELECT page_id, trim(href) AS ref, lower(regexp_extract(url, {_SCHEME}, 1)) AS sch,
        lower(regexp_extract(url, {_SCHEME}, 1)) || '://' || regexp_extract(url, {_AUTH}, 1) AS origin, {sql_path('url')} AS bp, url FROM {{hrefs}}),
    b AS (SELECT page_id, CASE WHEN ref = '' THEN NULL WHEN regexp_matches(ref, {_SCHEME}) THEN ref WHEN starts_with(ref, '//') THEN sch || ':' || ref
        WHEN starts_with(ref, '/') THEN origin || ref WHEN starts_with(ref, '?') THEN origin || bp || ref WHEN starts_with(ref, '#') THEN url
        ELSE origin || CASE WHEN regexp_extract(bp, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(bp, '^(.*/)', 1) END || ref END AS u FROM a),
    c AS (SELECT page_id, u, {sql_host('u')} AS h, lower(regexp_extract(u, {_SCHEME}, 1)) AS s,
        regexp_extract(regexp_extract(u, {_AUTH}, 1), ':(\\d+)$', 1) AS port, {sql_path('u')} AS p, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS q FROM b)
    SELECT B(page_id) AS page_id, CASE WHEN s IN ('http', 'https') AND h IS NOT NULL THEN s || '://' || h || CASE WHEN port <> '' THEN ':' || port ELSE '' END ||
        CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM c""")
def canonical_url(t):
    return t.hrefs.select("page_id", U.canonical_url(C("href"), C("url")).alias("canonical"))


@query("title_hash", """SELECT B(page_id) AS page_id, CASE WHEN x <> '' THEN sha256(x) END AS title_hash FROM (SELECT page_id,
    trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS x FROM pages)""")
def title_hash(t):
    return t.pages.select("page_id", T.title_hash(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_hash"))


@query("tc_hash", "SELECT B(event_id) AS event_id, sha256(trim(props)) AS tc_hash FROM events")
def consent_hash(t):
    return t.events.select("event_id", T.consent_hash(C("props")).alias("tc_hash"))


@query("video_key", "SELECT B(page_id) AS page_id, 'video-player|dom|' || sha256(url) AS video_key FROM pages")
def video_key(t):
    return t.pages.select("page_id", T.video_key(C("url")).alias("video_key"))


@query("slot_key", """SELECT B(l_orderkey) AS l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN 'gpt|ad-unit|/net/' || l_partkey
    WHEN l_suppkey % 2 = 0 THEN 'gpt|dom|slot-' || l_suppkey END AS slot_key FROM lineitem""")
def slot_key(t):
    path = F.when(C("l_returnflag") != "R", F.concat(F.lit(" /net/"), C("l_partkey").cast("string"))).otherwise(" ")
    element = F.when(C("l_suppkey") % 2 == 0, F.concat(F.lit("slot-"), C("l_suppkey").cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", T.slot_key(path, element).alias("slot_key"))


@query("record_hash", """SELECT B(s_suppkey) AS s_suppkey, sha256(concat_ws(chr(31), lower(replace(s_name, '#', '-')) || '.example.com', s_suppkey::VARCHAR,
    CASE WHEN s_suppkey % 2 = 0 THEN 'DIRECT' ELSE 'RESELLER' END, '')) AS record_hash FROM supplier""")
def record_hash(t):
    domain = F.concat(F.lower(F.replace(C("s_name"), F.lit("#"), F.lit("-"))), F.lit(".example.com"))
    kind = F.when(C("s_suppkey") % 2 == 0, "DIRECT").otherwise("RESELLER")
    return t.supplier.select("s_suppkey", T.record_hash(domain, C("s_suppkey").cast("string"), kind, F.lit(None).cast("string")).alias("record_hash"))


frame("numtext", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN '-3' WHEN 2 THEN '1e3' WHEN 3 THEN '12.5' WHEN 4 THEN '999999999999'
    WHEN 5 THEN '"7"' WHEN 6 THEN CAST(user_id AS STRING) ELSE NULL END AS raw FROM {events}""")


@query("bounded_number", """SELECT B(event_id) AS event_id, CASE WHEN n >= 0 AND n <= 86400000 THEN n END AS number, CASE WHEN n >= 0 AND n <= 86400000 AND n = floor(n) THEN B(n) END AS whole
    FROM (SELECT event_id, CASE WHEN regexp_matches(raw, '^-?(0|[1-9]\\d*)(\\.\\d+)?([eE][+-]?\\d+)?$') THEN TRY_CAST(raw AS DOUBLE) END AS n FROM {numtext})""")
def bounded_number(t):
    return t.numtext.select("event_id", N.bounded_number(C("raw"), 86_400_000.0).alias("number"), N.bounded_int(C("raw"), 86_400_000.0).alias("whole"))


@query("google_date", """SELECT B(o_orderkey) AS o_orderkey, strftime(TRY_CAST(printf('2026-%02d-%02d', o_orderkey % 14, o_orderkey % 33) AS DATE), '%Y-%m-%d') AS day,
    CASE WHEN o_orderkey % 4 <> 0 THEN TS(o_orderdate - INTERVAL '2' HOUR) END AS ran_at FROM orders""")
def google_date(t):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(C("o_orderkey") % 4 == 0, "").otherwise("+02:00"))
    day = Z.google_date(F.lit(2026), C("o_orderkey") % 14, C("o_orderkey") % 33)
    return t.orders.select("o_orderkey", day.cast("string").alias("day"), ts_text(Z.run_time(stamp)).alias("ran_at"))


@query("mem_to_mib", """SELECT B(l_orderkey) AS l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(l_quantity / 1024, 6) WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity * 1024 END AS mib FROM lineitem""")
def mem_to_mib(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KiB", "MiB", "GiB", "parsecs")]), (C("l_linenumber") % 4 + 1).cast("int"))
    text = F.concat(C("l_quantity").cast("string"), unit, F.lit(" / 2GiB"))
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(N.mem_to_mib(text)).alias("mib"))


@query("severity", """SELECT B(l_orderkey) AS l_orderkey, code, affected, valid, CASE WHEN affected > valid THEN NULL
    WHEN code = 'NOINDEX_ADDED' THEN CASE WHEN affected >= 2 THEN 'CRITICAL' ELSE 'MEDIUM' END WHEN affected >= 3 AND affected = valid THEN 'CRITICAL' ELSE 'HIGH' END AS severity
    FROM (SELECT l_orderkey, B(count(*) FILTER (l_returnflag = 'R')) AS affected, B(count(*) - count(*) FILTER (l_quantity < 5)) AS valid FROM lineitem GROUP BY 1)
    CROSS JOIN (VALUES ('NOINDEX_ADDED'), ('GPT_EXPECTED_SLOT_MISSING')) AS v(code)""")
def severity(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(
        F.count_if(C("l_returnflag") == "R").alias("affected"), (F.count("*") - F.count_if(C("l_quantity") < 5)).alias("valid")
    )
    rules = event_rules(t.spark).where(C("severity_policy") != "FIXED_DEFAULT")
    asked = counts.withColumn("code", F.explode(F.array(F.lit("NOINDEX_ADDED"), F.lit("GPT_EXPECTED_SLOT_MISSING"))))
    return asked.join(F.broadcast(rules), "code").select(
        "l_orderkey", "code", "affected", "valid",
        N.severity_for(C("severity_policy"), C("default_severity"), C("min_affected_urls"), C("critical_min_affected_urls"), C("affected"), C("valid")).alias("severity"),
    )


@query("higher_severity", """SELECT B(o_orderkey) AS o_orderkey, a AS current, b AS proposed, CASE WHEN list_position(s, b) > list_position(s, a) THEN b ELSE a END AS higher
    FROM (SELECT o_orderkey, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'] AS s, s[CAST(o_orderkey % 5 + 1 AS INT)] AS a, s[CAST(o_custkey % 5 + 1 AS INT)] AS b FROM orders)""")
def higher_severity(t):
    pick = lambda c: N.severity_name((C(c) % 5).cast("int"))
    return t.orders.select(
        "o_orderkey", pick("o_orderkey").alias("current"), pick("o_custkey").alias("proposed"),
        N.higher_severity(pick("o_orderkey"), pick("o_custkey")).alias("higher"),
    )


@query("fingerprints_equal", """SELECT B(o_orderkey) AS o_orderkey, o_orderkey % 3 = o_custkey % 3 AND o_orderstatus = 'F' AS comparable FROM orders""")
def fingerprints_equal(t):
    left = F.create_map(F.lit("collector"), (C("o_orderkey") % 3).cast("string"), F.lit("bundle"), C("o_orderstatus"))
    right = F.create_map(F.lit("bundle"), F.lit("F"), F.lit("collector"), (C("o_custkey") % 3).cast("string"))
    return t.orders.select("o_orderkey", N.fingerprints_equal(left, right).alias("comparable"))


@query("json_field", """SELECT B(event_id) AS event_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE B(json_extract(props, '$.k')) END AS k,
    B(CASE WHEN event_id % 4 = 1 THEN 0 ELSE 1 END) AS readable FROM events""")
def json_field(t):
    raw = F.when(C("event_id") % 4 == 1, F.concat(F.lit("[1, "), C("props"))).otherwise(C("props"))
    parsed = F.from_json(raw, "k BIGINT, slots ARRAY<STRING>", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", parsed["k"].alias("k"), big(parsed["k"].isNotNull().cast("int")).alias("readable"))


@query("norm_domain", """SELECT B(s_suppkey) AS s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'ad' || s_suppkey || '.example.com' WHEN 1 THEN 'ad' || s_suppkey || '.example.org'
    WHEN 5 THEN 'xn--mnchen-3ya.example' END AS domain FROM supplier""")
def norm_domain(t):
    key = C("s_suppkey").cast("string")
    raw = (
        F.when(C("s_suppkey") % 6 == 0, F.concat(F.lit("  AD"), key, F.lit(".Example.com. ")))
        .when(C("s_suppkey") % 6 == 1, F.concat(F.lit("ad"), key, F.lit(".example.org")))
        .when(C("s_suppkey") % 6 == 2, F.concat(F.lit("https://ad"), key, F.lit(".example.org")))
        .when(C("s_suppkey") % 6 == 3, F.concat(F.lit("-bad"), key, F.lit(".example.org")))
        .when(C("s_suppkey") % 6 == 4, F.lit("localhost"))
        .otherwise(F.lit("München.example"))
    )
    return t.supplier.select("s_suppkey", U.norm_domain(raw, international=True).alias("domain"))


@query("norm_octets", """SELECT DISTINCT B(page_id) AS page_id, v AS raw, array_to_string(list_transform(regexp_extract_all(v, '(?s)(%[0-9A-Fa-f]{2}|.)'), lambda c:
    CASE WHEN length(c) = 3 AND regexp_matches(substr(c, 2), '^(2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])$') THEN chr(CAST('0x' || substr(c, 2) AS INT))
         WHEN length(c) = 3 THEN upper(c) WHEN c = '%' THEN '%25' WHEN regexp_matches(c, '^[!-~]$') THEN c
         ELSE regexp_replace(hex(c), '(..)', '%\\1', 'g') END), '') AS normal, NOT regexp_matches(regexp_replace(v, '%[0-9A-Fa-f]{2}', '', 'g'), '%') AS valid
    FROM (SELECT page_id, href || '%7eé%zz %2f%41' AS v FROM {hrefs} UNION ALL SELECT page_id, href FROM {hrefs})""")
def norm_octets(t):
    odd = t.hrefs.select("page_id", F.concat("href", F.lit("%7eé%zz %2f%41")).alias("raw"))
    both = odd.unionByName(t.hrefs.select("page_id", C("href").alias("raw"))).distinct()
    return both.select("page_id", "raw", U.norm_octets(C("raw")).alias("normal"), U.octets_valid(C("raw")).alias("valid"))
