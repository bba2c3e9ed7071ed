"""Configuration files, their transitions, and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import config_text as K
from tidemark.operators.ordered import carry_previous, time_bucket
from tidemark.plans.lake import frame
from tidemark.plans.registry import query
from tidemark.plans.scalar_queries import sql_category, sql_family, sql_host, sql_mask, sql_path

C = F.col


# The variants of the derived files are known, so the expected records are written out per variant.
SQL_ADS = """ads AS (
    SELECT file_id, 2 AS line_no, 'ad' || file_id || '.example.com' AS domain, 'acct-' || s_nationkey AS account, 'DIRECT' AS relationship, NULL AS authority FROM {ads_files} JOIN supplier ON s_suppkey = file_id WHERE variant = 0
    UNION ALL SELECT file_id, 4, 'other.example.org', '7', 'RESELLER', 'cert9' FROM {ads_files} WHERE variant = 0
    UNION ALL SELECT file_id, 1, 'dup.example.com', '1', 'DIRECT', NULL FROM {ads_files} WHERE variant = 1
    UNION ALL SELECT file_id, 2, 'b.example.com', '2', 'RESELLER', NULL FROM {ads_files} WHERE variant = 5
    UNION ALL SELECT file_id, 3, 'c.example.com', '3', 'DIRECT', NULL FROM {ads_files} WHERE variant = 6),
    hashed AS (SELECT *, sha256(concat_ws(chr(31), domain, account, relationship, coalesce(authority, ''))) AS record_hash FROM ads)"""


@query("ads_records", "WITH " + SQL_ADS + " SELECT B(file_id) AS file_id, line_no, domain, account, relationship, authority, record_hash FROM hashed")
def ads_records(t):
    return K.ads_records(t.ads_files)


@query("ads_file_state", "WITH " + SQL_ADS + """ SELECT B(f.file_id) AS file_id, CASE variant WHEN 3 THEN 'EMPTY' WHEN 2 THEN 'INVALID' WHEN 4 THEN 'INVALID' WHEN 0 THEN 'VALID' ELSE 'VALID_WITH_WARNINGS' END AS parse_status,
    B(CASE variant WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END) AS records, B(CASE variant WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END) AS invalid_rows, B(CASE variant WHEN 1 THEN 1 ELSE 0 END) AS duplicates,
    CASE variant WHEN 2 THEN 'own' || f.file_id || '.example.com' END AS owner_domain, CASE variant WHEN 2 THEN 'man.example.com:US' ELSE '' END AS managers,
    sha256(concat_ws('|', coalesce(h.hs, ''), CASE variant WHEN 2 THEN 'own' || f.file_id || '.example.com' ELSE '' END, CASE variant WHEN 2 THEN 'man.example.com:US' ELSE '' END)) AS semantic_hash
    FROM {ads_files} f LEFT JOIN (SELECT file_id, string_agg(record_hash, ',' ORDER BY record_hash) AS hs FROM hashed GROUP BY 1) h ON h.file_id = f.file_id""")
def ads_file_state(t):
    return K.ads_file_state(t.ads_files).withColumn("managers", F.array_join("managers", ","))


SQL_ROBOTS = """rules AS (SELECT f.file_id, r.agent, r.directive, r.pattern FROM {robots_files} f JOIN (VALUES
    (0, '*', 'disallow', '/'), (0, 'goodbot', 'allow', '/'), (1, '*', 'disallow', '/p/'), (1, '*', 'allow', '/p/1'), (1, '*', 'disallow', '/*.pdf$'), (1, 'slow', 'disallow', '/p/'), (1, 'slow', 'allow', '/p/1'),
    (1, 'slow', 'disallow', '/*.pdf$'), (1, 'slow', 'disallow', '/~tmp'), (3, '*', NULL, NULL), (3, 'goodbot', 'disallow', '/p/')) AS r(variant, agent, directive, pattern) ON r.variant = f.variant)"""


@query("robots_rules", "WITH " + SQL_ROBOTS + " SELECT file_id, agent, directive, pattern FROM rules")
def robots_rules(t):
    return K.robots_rules(t.robots_files)


@query("robots_state", "WITH " + SQL_ROBOTS + """ SELECT f.file_id, CASE variant WHEN 0 THEN 'VALID' WHEN 2 THEN 'EMPTY' WHEN 4 THEN 'INVALID' ELSE 'VALID_WITH_WARNINGS' END AS parse_status, B(count(DISTINCT agent)) AS groups, B(count(pattern)) AS rules,
    variant = 0 AS broad_blocked, sha256(coalesce(string_agg(concat_ws('|', agent, coalesce(directive, ''), coalesce(pattern, '')), ',' ORDER BY concat_ws('|', agent, coalesce(directive, ''), coalesce(pattern, ''))) FILTER (agent IS NOT NULL), '')) AS semantic_hash
    FROM {robots_files} f LEFT JOIN rules r ON r.file_id = f.file_id GROUP BY f.file_id, variant""")
def robots_state(t):
    return K.robots_state(t.robots_files)


@query("robots_allowed", """SELECT B(url_id) AS url_id, CASE u.file_id % 5 WHEN 0 THEN user_agent LIKE 'GoodBot%'
    WHEN 1 THEN CASE WHEN path LIKE '/p/1%' THEN true WHEN path LIKE '/p/%' THEN false WHEN path = '/a/b.pdf' THEN false WHEN path LIKE '/~tmp%' THEN user_agent <> 'slowcrawler' ELSE true END
    WHEN 3 THEN NOT (user_agent LIKE 'GoodBot%' AND path LIKE '/p/%') ELSE true END AS allowed FROM {robots_urls} u""")
def robots_allowed(t):
    return K.robots_allowed(t.robots_urls, K.robots_rules(t.robots_files)).select("url_id", "allowed")


@query("site_robots", """WITH mine AS (SELECT u.*, CASE WHEN coalesce(user_agent, '') LIKE 'GoodBot%' AND EXISTS (SELECT 1 FROM {site_rules} r WHERE r.file_id = u.file_id AND r.agent = 'goodbot') THEN 'goodbot' ELSE '*' END AS agent FROM {site_urls} u),
    hit AS (SELECT url_id, directive = 'allow' AS allow, length(replace(replace(pattern, '*', ''), '$', '')) AS octets FROM mine m JOIN {site_rules} r USING (file_id, agent)
        WHERE CASE WHEN pattern LIKE '%$' THEN starts_with(path, '/p/') AND ends_with(path, replace(substr(pattern, 5), '$', '')) AND length(path) >= length(pattern) - 2
            WHEN contains(pattern, '*') THEN starts_with(path, split_part(pattern, '*', 1)) AND contains(substr(path, length(split_part(pattern, '*', 1)) + 1), '.html') ELSE starts_with(path, pattern) END),
    best AS (SELECT url_id, max({'octets': octets, 'allow': allow}) AS best FROM hit GROUP BY 1)
    SELECT B(u.url_id) AS url_id, coalesce(b.best.allow, true) AS allowed FROM {site_urls} u LEFT JOIN best b USING (url_id)""")
def site_robots(t):
    return K.robots_allowed(t.site_urls, K.robots_rules(t.site_files)).select("url_id", "allowed")


@query("config_outcome", """SELECT B(fetch_id) AS fetch_id, CASE WHEN error_code = 'PUBLIC_CONFIG_TOO_LARGE' THEN 'TOO_LARGE' WHEN error_code = 'PUBLIC_CONFIG_SECURITY_ERROR' THEN 'BLOCKED' WHEN error_code IS NOT NULL THEN 'UNREACHABLE'
    WHEN http_status = 200 THEN NULL WHEN http_status IN (404, 410) THEN 'MISSING' WHEN config_type = 'ROBOTS_TXT' AND http_status = 500 THEN 'UNREACHABLE' ELSE 'HTTP_ERROR' END AS outcome FROM {fetches}""")
def config_outcome(t):
    return K.config_outcome(t.fetches).select("fetch_id", "outcome")


def _sql_before(name: str, extra: str) -> str:
    return f"""(SELECT max({{'at': observed_at, 'id': snapshot_id, 'ps': parse_status, 'h': semantic_hash, 'b': broad_blocked}}) FROM {{configs}} p WHERE p.site = c.site AND p.config_type = c.config_type AND p.normalizer_version = c.normalizer_version
        AND p.fetch_kind = 'SCHEDULED' AND p.observed_at < c.observed_at {extra}) AS {name}"""


frame(
    "preceded",
    f"""
    WITH f AS (SELECT c.*, {_sql_before('prev', '')}, {_sql_before('healthy', "AND parse_status IN ('VALID', 'VALID_WITH_WARNINGS')")},
        {_sql_before('cond', "AND parse_status IN ('MISSING', 'EMPTY', 'INVALID') AND config_type = 'ADS_TXT'")} FROM {{configs}} c)
    SELECT *, CASE WHEN config_type = 'ADS_TXT' AND parse_status IN ('VALID', 'VALID_WITH_WARNINGS') AND NOT coalesce(prev.ps IN ('MISSING', 'EMPTY', 'INVALID'), false) AND cond IS NOT NULL
        AND (healthy IS NULL OR cond.at > healthy.at) THEN cond ELSE prev END AS eff FROM f
    """,
)
frame(
    "checked",
    """
    WITH v AS (SELECT o_orderkey AS validation_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS validation_of FROM {orders})
    SELECT v.validation_of, c.* FROM v JOIN {configs} c ON c.snapshot_id = v.validation_id WHERE c.fetch_kind = 'VALIDATION' AND v.validation_of IS NOT NULL
    """,
)


def validations(t):
    """A validation fetch checks the preceding order of the same customer."""
    owned = t.orders.select(C("o_orderkey").alias("snapshot_id"), "o_custkey", "o_orderdate", C("o_orderkey").alias("self"))
    before = carry_previous(owned, ["o_custkey"], ["o_orderdate", "snapshot_id"], "self", "validation_of", time_bucket("o_orderdate"))
    checks = t.configs.where(C("fetch_kind") == "VALIDATION").join(before.select("snapshot_id", "validation_of"), "snapshot_id")
    return checks.where(C("validation_of").isNotNull()).withColumnRenamed("snapshot_id", "validation_id")


def preceded(t):
    return K.config_predecessors(t.configs)


@query("config_predecessors", """SELECT B(snapshot_id) AS snapshot_id, B(prev.id) AS previous_id, B(healthy.id) AS healthy_id, B(cond.id) AS condition_id, B(eff.id) AS effective_id FROM {preceded}""")
def config_predecessors(t):
    return preceded(t).select(
        "snapshot_id", C("previous.snapshot_id").alias("previous_id"), C("previous_healthy.snapshot_id").alias("healthy_id"),
        C("previous_condition.snapshot_id").alias("condition_id"), C("effective.snapshot_id").alias("effective_id"),
    )


@query("validation_pair", """SELECT B(c.snapshot_id) AS snapshot_id, B(v.snapshot_id) AS validation_id, coalesce(v.parse_status = c.parse_status AND v.semantic_hash IS NOT DISTINCT FROM c.semantic_hash, false) AS agrees
    FROM {configs} c LEFT JOIN {checked} v ON v.validation_of = c.snapshot_id""")
def validation_pair(t):
    return K.validation_pair(t.configs, validations(t)).select("snapshot_id", C("validation.validation_id").alias("validation_id"), "agrees")


@query("needs_second_check", """SELECT B(snapshot_id) AS snapshot_id, healthy IS NOT NULL AND CASE WHEN config_type = 'ROBOTS_TXT' THEN broad_blocked AND NOT healthy.b
    ELSE parse_status IN ('MISSING', 'EMPTY', 'INVALID') OR coalesce(cond.at > healthy.at, false) END AS second_check FROM {preceded}""")
def needs_second_check(t):
    return K.needs_second_check(preceded(t)).select("snapshot_id", "second_check")


@query(
    "config_transitions",
    """WITH j AS (SELECT p.*, v.snapshot_id AS vid, v.observed_at AS vat, v.normalizer_version AS vn, coalesce(v.parse_status = p.parse_status AND v.semantic_hash IS NOT DISTINCT FROM p.semantic_hash, false) AS agrees,
        p.config_type = 'ROBOTS_TXT' AS rb, p.parse_status IN ('VALID', 'VALID_WITH_WARNINGS') AS ok, eff.ps IN ('VALID', 'VALID_WITH_WARNINGS') AS was_ok, p.parse_status IN ('MISSING', 'EMPTY', 'INVALID') AS bad,
        eff.ps IN ('MISSING', 'EMPTY', 'INVALID') AS was_bad, (eff.h IS NULL OR p.semantic_hash IS NULL) AS nohash FROM {preceded} p LEFT JOIN {checked} v ON v.validation_of = p.snapshot_id),
    s AS (SELECT *, CASE WHEN fetch_kind <> 'SCHEDULED' THEN 'PRIMARY_NOT_SCHEDULED' WHEN vid IS NOT NULL AND vn <> normalizer_version THEN 'INCOMPATIBLE_PUBLIC_CONFIG_NORMALIZER' WHEN eff IS NULL THEN 'FIRST_SEMANTIC_BASELINE'
        WHEN rb THEN CASE WHEN NOT (ok AND was_ok) THEN 'NON_SEMANTIC_ROBOTS_STATE' WHEN nohash THEN 'MISSING_SEMANTIC_HASH' WHEN eff.h = semantic_hash THEN 'UNCHANGED_SEMANTIC_STATE' WHEN NOT eff.b AND broad_blocked AND NOT agrees THEN 'AWAITING_OR_DISAGREEING_VALIDATION' END
        WHEN bad THEN CASE WHEN NOT agrees THEN 'AWAITING_OR_DISAGREEING_VALIDATION' END
        WHEN was_bad THEN CASE WHEN NOT agrees THEN 'AWAITING_OR_DISAGREEING_RECOVERY_VALIDATION' END WHEN nohash THEN 'MISSING_SEMANTIC_HASH' WHEN eff.h = semantic_hash THEN 'UNCHANGED_SEMANTIC_STATE' END AS skip FROM j),
    c AS (SELECT *, CASE parse_status WHEN 'MISSING' THEN 'ADS_TXT_MISSING' WHEN 'EMPTY' THEN 'ADS_TXT_EMPTY_200' ELSE 'ADS_TXT_INVALID' END AS cc FROM s)
    SELECT B(snapshot_id) AS snapshot_id, NULL AS code, NULL AS action, skip FROM c WHERE skip IS NOT NULL
    UNION ALL SELECT B(snapshot_id), CASE WHEN rb THEN CASE WHEN NOT eff.b AND broad_blocked THEN 'ROBOTS_BROAD_BLOCK_ADDED' WHEN eff.b AND NOT broad_blocked THEN 'ROBOTS_BROAD_BLOCK_REMOVED' ELSE 'ROBOTS_TXT_CHANGED' END WHEN bad THEN cc ELSE 'ADS_TXT_CHANGED' END,
        CASE WHEN NOT rb AND bad THEN CASE WHEN eff.ps = parse_status THEN 'SUPPORT' ELSE 'UPSERT' END ELSE 'RECORD' END, NULL FROM c WHERE skip IS NULL AND (rb OR bad OR NOT was_bad)
    UNION ALL SELECT B(snapshot_id), k, 'RESOLVE', NULL FROM c, (VALUES ('ADS_TXT_MISSING'), ('ADS_TXT_EMPTY_200'), ('ADS_TXT_INVALID')) AS x(k) WHERE skip IS NULL AND NOT rb AND NOT bad AND was_bad""",
)
def config_transitions(t):
    return K.config_transitions(K.validation_pair(preceded(t), validations(t))).select("snapshot_id", "code", "action", "skip")


@query("page_seo", """SELECT B(page_id) AS page_id, CASE WHEN x <> '' THEN sha256(x) END AS title_hash, NULL::VARCHAR AS meta_robots, NULL::VARCHAR AS canonical_url FROM (SELECT page_id, trim(regexp_replace(
    replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS x FROM pages)""")
def page_seo(t):
    return K.page_seo(t.pages)


SQL_ATTRS = """'(?i)\\s(aria-hidden|data-ad-unit|data-testid|defer|hidden|id|itemprop|name|property|rel|role|type)(?:\\s*=\\s*"[^"]*")?'"""


@query("page_structure", f"""SELECT B(page_id) AS page_id, B(len(tags)) AS node_count, sha256(array_to_string(list_transform(tags, lambda g:
    array_to_string(list_concat([lower(regexp_extract(g, '^<([a-zA-Z][a-zA-Z0-9]*)', 1))], list_sort(list_transform(regexp_extract_all(g, {SQL_ATTRS}), lambda a: {sql_mask('lower(a)')}))), ' ')), chr(10))) AS structure_hash
    FROM (SELECT page_id, regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:\\s[^<>]*)?>') AS tags FROM pages)""")
def page_structure(t):
    return K.page_structure(t.pages)


@query("page_links", f"""WITH r AS (SELECT page_id, 'a' AS tag, regexp_extract(url, '^https?://[^/?#]*', 0) || h AS u FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?(?:src|href)="([^"]*)"', 1)) AS h FROM pages))
    SELECT B(page_id) AS page_id, tag, {sql_host('u')} || '|' || {sql_family(sql_path('u'))} || '|a' AS stable_key, {sql_category(sql_host('u'), sql_family(sql_path('u')))} AS category FROM r""")
def page_links(t):
    return K.page_links(t.pages)
