"""Run evidence aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shape import r6
from tidemark.operators import evidence as V
from tidemark.operators.ordered import merged_spans
from tidemark.operators.sessions import span_sessions
from tidemark.plans.lake import frame
from tidemark.plans.registry import query
from tidemark.plans.scalar_queries import SQL_AD, SQL_MEDIA, SQL_VAST, sql_family, sql_host, sql_key, sql_mask, sql_path

C = F.col

frame("keyed", f"SELECT *, {sql_key('url', 'resource_type')} AS stable_key FROM {{net}}", spark_sql="SELECT * FROM {net}")
SQL_NET = """agg AS (SELECT run_id, stable_key, count(*) AS requests, count(*) FILTER (coalesce(error_text, '') <> '') AS failures,
        count(*) FILTER (status // 100 = 2) AS s2, count(*) FILTER (status // 100 = 4) AS s4, count(*) FILTER (status // 100 = 5) AS s5 FROM {keyed} WHERE stable_key IS NOT NULL GROUP BY 1, 2),
    st AS (SELECT run_id, stable_key, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM (SELECT run_id, stable_key, status, count(*) AS n
        FROM {keyed} WHERE status IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)"""


@query("network_agg", "WITH " + SQL_NET + """ SELECT B(run_id) AS run_id, stable_key, B(requests) AS requests, B(failures) AS failures, B(s2) AS status_2xx, B(0) AS status_3xx,
    B(s4) AS status_4xx, B(s5) AS status_5xx, coalesce(statuses, '') AS statuses FROM agg LEFT JOIN st USING (run_id, stable_key)""")
def network_agg(t):
    return V.network_agg(t.net)


@query("network_state", "WITH " + SQL_NET + """ SELECT B(run_id) AS run_id, B(count(*)) AS dependencies,
    sha256(concat_ws('|', count(*)::VARCHAR, bit_xor(H60(line))::VARCHAR, bit_xor(CAST('0x' || substr(md5(line), 16, 15) AS BIGINT))::VARCHAR)) AS state_hash FROM (SELECT run_id, concat_ws(':', stable_key, requests, failures, s4, s5) AS line FROM agg) GROUP BY 1""")
def network_state(t):
    return V.network_state(V.network_agg(t.net))


frame("jserrors", """SELECT user_id AS run_id, concat('Error in ', props, ' MODULE_', CAST(event_id % 7 AS STRING), CAST(12340 + event_id % 5 AS STRING)) AS message,
    CASE WHEN event_id % 5 <> 0 THEN concat('https://Static.example.com/js/', CAST(event_id % 3 AS STRING), '/app.js') END AS source FROM {events} WHERE event_type = 'error'""")


@query("js_errors", f"""SELECT B(run_id) AS run_id, m AS message, h AS source_host, p AS source_path, B(count(*)) AS occurrences,
    sha256('js-error-v1|' || m || '|' || coalesce(h, '') || '|' || coalesce(p, '')) AS fingerprint
    FROM (SELECT run_id, {sql_mask('lower(message)')} AS m, {sql_host('source')} AS h, CASE WHEN source IS NOT NULL THEN {sql_family(sql_path('source'))} END AS p FROM {{jserrors}}) GROUP BY ALL""")
def js_errors(t):
    return V.js_errors(t.jserrors)


@query("script_set", f"""WITH k AS (SELECT DISTINCT page_id, {sql_host('u')} || '|' || {sql_family(sql_path('u'))} || '|script' AS k FROM (SELECT page_id,
        regexp_extract(url, '^https?://[^/?#]*', 0) || href AS u FROM {{hrefs}}) WHERE {sql_host('u')} IS NOT NULL)
    SELECT B(page_id) AS run_id, B(count(*)) AS scripts,
    sha256(concat_ws('|', count(*)::VARCHAR, bit_xor(H60(k))::VARCHAR, bit_xor(CAST('0x' || substr(md5(k), 16, 15) AS BIGINT))::VARCHAR)) AS state_hash FROM k GROUP BY 1""")
def script_set(t):
    absolute = F.concat(F.regexp_extract("url", r"^https?://[^/?#]*", 0), C("href"))
    return V.script_set(t.hrefs.select(C("page_id").alias("run_id"), absolute.alias("url")))


@query("auction_agg", """SELECT B(run_id) AS run_id, auction_key, B(arg_min(elapsed_ms, seq) FILTER (event_type = 'auctionInit' AND elapsed_ms IS NOT NULL)) AS started_ms,
    B(arg_max_null(elapsed_ms, seq) FILTER (event_type IN ('auctionEnd', 'auctionTimeout'))) AS ended_ms,
    B(coalesce(arg_max(timeout_ms, seq) FILTER (timeout_ms > 0), 1000)) AS timeout_ms, B(arg_max(ad_units, seq) FILTER (ad_units > 0)) AS ad_units,
    B(count(*) FILTER (event_type = 'bidRequested')) AS requests, B(count(*) FILTER (event_type = 'bidResponse')) AS responses, B(count(*) FILTER (event_type = 'noBid')) AS no_bids,
    B(count(*) FILTER (event_type IN ('bidTimeout', 'auctionTimeout'))) AS timeouts FROM {auction_events} GROUP BY run_id, auction_key""")
def auction_agg(t):
    return V.auction_agg(t.auction_events, 1000, None)


@query("bidder_agg", """SELECT B(run_id) AS run_id, auction_key, bidder, B(count(*) FILTER (event_type = 'bidRequested')) AS requests, B(count(*) FILTER (event_type = 'bidResponse')) AS responses,
    B(count(*) FILTER (event_type = 'noBid')) AS no_bids, B(count(*) FILTER (event_type IN ('bidTimeout', 'auctionTimeout'))) AS timeouts, B(count(*) FILTER (event_type = 'bidWon')) AS wins,
    min(response_ms) FILTER (event_type = 'bidResponse') AS response_min, max(response_ms) FILTER (event_type = 'bidResponse') AS response_max,
    round(avg(response_ms) FILTER (event_type = 'bidResponse'), 6) AS response_avg FROM {auction_events} WHERE bidder <> 'bad bidder' GROUP BY run_id, auction_key, bidder""")
def bidder_agg(t):
    return V.bidder_agg(t.auction_events).withColumn("response_avg", r6("response_avg"))


@query("first_ad_request_after", f"""SELECT B(a.run_id) AS run_id, a.auction_key, B(min(n.at_ms)) AS first_request_ms FROM {{run_auctions}} a LEFT JOIN (SELECT * FROM {{netparts}} WHERE {SQL_AD}) n
    ON n.run_id = a.run_id AND n.at_ms >= coalesce(a.ended_ms, a.started_ms, 0) GROUP BY 1, 2""")
def first_ad_request_after(t):
    return V.first_ad_request_after(t.run_auctions, t.net)


@query("consent_phase_agg", """SELECT B(k.run_id) AS run_id, CASE WHEN coalesce(at_ms >= boundary_ms, false) THEN CASE WHEN consent_path = 'REJECT' THEN 'POST_REJECT' ELSE 'POST_ACCEPT' END
    ELSE 'PRE_CONSENT' END AS phase, stable_key, B(count(*)) AS requests, B(count(*) FILTER (error_text IS NOT NULL OR status >= 400)) AS errors, min(at_ms) AS first_request_ms
    FROM {keyed} k LEFT JOIN {consents} c USING (run_id) GROUP BY ALL""")
def consent_phase_agg(t):
    return V.consent_phase_agg(t.net, t.consents)


@query("video_attribution", f"""WITH s AS (SELECT run_id, count(*) FILTER ({SQL_VAST}) AS v, count(*) FILTER ({SQL_VAST} AND (error_text IS NOT NULL OR status >= 400)) AS ve,
        count(*) FILTER ({SQL_MEDIA} AND NOT {SQL_VAST}) AS m FROM {{netparts}} GROUP BY 1), p AS (SELECT run_id, count(*) AS n FROM {{players}} GROUP BY 1),
    j AS (SELECT run_id, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(ve, 0) AS ve, coalesce(m, 0) AS m FROM s FULL JOIN p USING (run_id))
    SELECT B(run_id) AS run_id, B(n) AS player_count, B(CASE WHEN n = 1 THEN v ELSE 0 END) AS vast, B(CASE WHEN n = 1 THEN ve ELSE 0 END) AS vast_errors, B(CASE WHEN n = 1 THEN m ELSE 0 END) AS media,
    concat_ws(',', CASE WHEN v > 0 THEN 'vast_payload_not_inspected' END, CASE WHEN v + m > 0 AND n = 0 THEN 'video_network_player_not_observable'
        WHEN v + m > 0 AND n > 1 THEN 'video_network_player_attribution_ambiguous' END) AS limitations FROM j""")
def video_attribution(t):
    return V.video_attribution(t.net, t.players).withColumn("limitations", F.array_join("limitations", ","))


@query("cls_sessions", """WITH RECURSIVE s AS (SELECT user_id, day, t, sum(v) AS v, row_number() OVER (PARTITION BY user_id, day ORDER BY t) AS rn FROM {shifts} GROUP BY user_id, day, t),
    w AS (SELECT user_id, day, rn, t AS start, t AS last, v AS total, v AS best FROM s WHERE rn = 1
      UNION ALL SELECT s.user_id, s.day, s.rn, CASE WHEN w.total > 0 AND s.t - w.last < 1000 AND s.t - w.start < 5000 THEN w.start ELSE s.t END, s.t,
        CASE WHEN w.total > 0 AND s.t - w.last < 1000 AND s.t - w.start < 5000 THEN w.total + s.v ELSE s.v END,
        greatest(w.best, CASE WHEN w.total > 0 AND s.t - w.last < 1000 AND s.t - w.start < 5000 THEN w.total + s.v ELSE s.v END)
      FROM w JOIN s ON s.user_id = w.user_id AND s.day = w.day AND s.rn = w.rn + 1)
    SELECT B(user_id) AS user_id, strftime(day, '%Y-%m-%d') AS day, round(max(best), 6) AS cls FROM w GROUP BY 1, 2""")
def cls_sessions(t):
    return V.cls_sessions(t.shifts, ["user_id", "day"]).select("user_id", C("day").cast("string").alias("day"), r6("cls").alias("cls"))


@query("shift_sessions", """WITH RECURSIVE s AS (SELECT user_id, day, t, sum(v) AS v, row_number() OVER (PARTITION BY user_id, day ORDER BY t) AS rn FROM {shifts} GROUP BY user_id, day, t),
    w AS (SELECT user_id, day, rn, t AS start, t, v, v AS total FROM s WHERE rn = 1
      UNION ALL SELECT s.user_id, s.day, s.rn, CASE WHEN w.total > 0 AND s.t - w.t < 1000 AND s.t - w.start < 5000 THEN w.start ELSE s.t END, s.t, s.v,
        CASE WHEN w.total > 0 AND s.t - w.t < 1000 AND s.t - w.start < 5000 THEN w.total + s.v ELSE s.v END
      FROM w JOIN s ON s.user_id = w.user_id AND s.day = w.day AND s.rn = w.rn + 1)
    SELECT B(user_id) AS user_id, strftime(day, '%Y-%m-%d') AS day, start::DOUBLE AS start_ms, max(t)::DOUBLE AS end_ms, B(count(*)) AS instants, round(sum(v), 6) AS total FROM w GROUP BY user_id, day, start""")
def shift_sessions(t):
    return span_sessions(t.shifts, ["user_id", "day"], V.GAP_MS, V.SPAN_MS).select(
        "user_id", C("day").cast("string").alias("day"), C("start").alias("start_ms"), C("end").alias("end_ms"), "instants", r6("total").alias("total")
    )


@query("interaction_proxy", """SELECT B(user_id) AS user_id, strftime(day, '%Y-%m-%d') AS day, max(CASE WHEN interaction_id > 0 THEN duration_ms END) AS inp_ms FROM {shifts} GROUP BY ALL""")
def interaction_proxy(t):
    return V.interaction_proxy(t.shifts, ["user_id", "day"]).select("user_id", C("day").cast("string").alias("day"), "inp_ms")


def perf_payloads(t):
    k = C("o_orderkey")
    kind = lambda name, when: F.when(when, F.lit(name))
    supported = F.array_compact(
        F.array(kind("largest-contentful-paint", k % 5 != 0), kind("layout-shift", k % 7 != 0), kind("event", k % 3 != 0), kind("longtask", k % 2 == 0))
    )
    part = (k % 10) / 10.0
    pair = lambda a, b: F.array(F.lit(a).cast("double"), b.cast("double"))
    nav = F.when(k % 13 != 0, F.create_map(
        F.lit("response_start"), (k % 200).cast("double"), F.lit("load_event_end"), F.when(k % 9 == 0, 0.0).otherwise((k % 100 + 1000).cast("double"))
    ))
    body = F.struct(
        supported.alias("supported_entry_types"), (k % 11 == 0).alias("was_hidden"),
        F.array((k % 1000).cast("double"), (k % 777).cast("double"), F.lit(-5.0)).alias("lcp_candidates"),
        F.array(pair(0, part), pair(500, part * 2), pair(2000, part / 2)).alias("layout_shifts"),
        F.array(F.array((k % 4).cast("double"), (k % 300).cast("double")), pair(0, F.lit(900))).alias("interactions"),
        (k % 6).alias("long_task_count"), (k % 50).alias("long_task_total_ms"), nav.alias("navigation"),
        F.when(k % 17 == 0, F.array(F.lit("LCP_OBSERVER_ERROR"), F.lit("x"))).alias("errors"),
        F.struct((k % 19 == 0).alias("lcp")).alias("samples_truncated"),
    )
    return t.orders.select(k.alias("run_id"), F.to_json(body).alias("payload"))


@query("perf_summary", """SELECT B(k) AS run_id, CASE WHEN k % 5 <> 0 AND k % 11 <> 0 THEN greatest(k % 1000, k % 777)::DOUBLE END AS lcp_ms,
    CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN round((k % 10) / 10.0 * 3, 6) END AS cls, CASE WHEN k % 3 <> 0 AND k % 4 > 0 THEN (k % 300)::DOUBLE END AS inp_ms,
    CASE WHEN k % 2 = 0 THEN B(k % 6) END AS long_tasks, CASE WHEN k % 2 = 0 THEN (k % 50)::DOUBLE END AS long_task_ms, CASE WHEN k % 13 <> 0 THEN (k % 200)::DOUBLE END AS ttfb_ms,
    CASE WHEN k % 13 <> 0 AND k % 9 <> 0 THEN (k % 100 + 1000)::DOUBLE END AS load_ms,
    concat_ws(',', CASE WHEN k % 5 = 0 THEN 'lcp_api_unsupported' WHEN k % 11 = 0 THEN 'performance_observation_backgrounded' END,
        CASE WHEN k % 7 = 0 THEN 'layout_shift_api_unsupported' WHEN k % 11 = 0 AND k % 5 = 0 THEN 'performance_observation_backgrounded' END,
        CASE WHEN k % 3 = 0 THEN 'inp_proxy_event_timing_unsupported' WHEN k % 4 = 0 THEN 'inp_proxy_unavailable_no_qualifying_interaction' END,
        CASE WHEN k % 2 = 1 THEN 'long_task_api_unsupported' END, CASE WHEN k % 13 = 0 THEN 'navigation_timing_not_observed' WHEN k % 9 = 0 THEN 'load_event_not_observed' END,
        CASE WHEN k % 17 = 0 THEN 'performance_observer_partial_error' END, CASE WHEN k % 19 = 0 THEN 'performance_samples_truncated' END) AS limitations
    FROM (SELECT o_orderkey AS k FROM orders)""")
def perf_summary(t):
    return V.perf_summary(perf_payloads(t)).withColumn("cls", r6("cls")).withColumn("limitations", F.array_join("limitations", ","))


SQL_ROWS = """seen AS (SELECT run_id, stable_key, arg_max_null(requested_ms, pos) AS requested_ms FROM (SELECT *, CASE WHEN ad_unit_path IS NOT NULL THEN 'gpt|ad-unit|' || ad_unit_path
    WHEN element_id IS NOT NULL THEN 'gpt|dom|' || element_id END AS stable_key FROM {slot_entries}) WHERE stable_key IS NOT NULL GROUP BY 1, 2)"""
SQL_VALID = """valid AS (SELECT r.run_id, r.template_id, v.stable_key, v.validity_id FROM {template_runs} r JOIN {validity} v ON v.template_id = r.template_id AND v.valid_from <= r.at
    AND (v.valid_to IS NULL OR v.valid_to > r.at))"""


@query("slot_rows", "WITH " + SQL_ROWS + " SELECT B(run_id) AS run_id, stable_key, requested_ms FROM seen")
def slot_rows(t):
    return V.slot_rows(t.slot_entries).select("run_id", "stable_key", "requested_ms")


@query("valid_at", "WITH " + SQL_VALID + " SELECT B(run_id) AS run_id, stable_key, B(validity_id) AS validity_id FROM valid")
def valid_at(t):
    return V.valid_at(t.template_runs, t.validity, ["template_id"]).select("run_id", "stable_key", "validity_id")


@query("overlapping_validity", """SELECT B(run_id) AS run_id, B(validity_id) AS validity_id FROM {template_runs} r JOIN {validity} v ON v.template_id = r.template_id
    AND v.valid_from <= r.at + INTERVAL '6' HOUR AND (v.valid_to IS NULL OR v.valid_to > r.at)""")
def overlapping_validity(t):
    windows = t.template_runs.withColumn("window_start", C("at")).withColumn("window_end", C("at") + F.expr("INTERVAL '6' HOUR"))
    return V.overlapping(windows, t.validity, ["template_id"]).select("run_id", "validity_id")


@query("expected_vs_observed", "WITH " + SQL_ROWS + ", " + SQL_VALID + """, e AS (SELECT DISTINCT run_id, stable_key FROM valid)
    SELECT B(run_id) AS run_id, stable_key, e.run_id IS NOT NULL AS expected, seen.run_id IS NOT NULL AS present, requested_ms FROM seen FULL JOIN e USING (run_id, stable_key)""")
def expected_vs_observed(t):
    # A slot is expected where any of its rules is in force, so the rules of a slot are united before runs meet them.
    rules = merged_spans(t.validity, ["template_id", "stable_key"], "valid_from", "valid_to")
    expected = V.valid_at(t.template_runs, rules, ["template_id"])
    return V.expected_vs_observed(V.slot_rows(t.slot_entries), expected, ["requested_ms"])


def consent_payloads(t):
    k = C("o_orderkey")
    body = F.struct(
        (k % 6 != 0).alias("tcfApiDetected"), F.when(k % 7 != 0, k % 500).alias("apiReadyAtMs"),
        F.struct(
            F.when(k % 3 == 0, F.lit(True)).when(k % 3 == 1, F.lit(False)).alias("gdprApplies"),
            F.when(k % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("CO"), C("o_custkey").cast("string"))).alias("tcString"),
            (k % 900 - 5).alias("cmpId"), F.lit(" tcloaded ").alias("eventStatus"),
        ).alias("latest"),
    )
    return t.orders.select(k.alias("run_id"), F.to_json(body).alias("payload"))


@query("consent_state", """SELECT B(k) AS run_id, k % 6 <> 0 AS api_detected, CASE WHEN k % 7 <> 0 THEN B(k % 500) END AS api_ready_ms, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS gdpr_applies,
    CASE WHEN k % 4 <> 0 THEN sha256('CO' || c) END AS tc_hash, CASE WHEN k % 900 >= 5 THEN B(k % 900 - 5) END AS cmp_id, 'tcloaded' AS event_status
    FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)""")
def consent_state(t):
    return V.consent_state(consent_payloads(t))


@query("access_class", """SELECT B(run_id) AS run_id, CASE WHEN navigation_failed THEN 'degraded' WHEN m IS NOT NULL THEN 'challenge_suspected' WHEN http_status >= 300 THEN 'degraded' ELSE 'ok' END AS state,
    CASE WHEN navigation_failed THEN 'navigation failed' WHEN m IS NOT NULL THEN 'deterministic challenge markers observed: ' || m WHEN http_status >= 300 THEN 'unexpected HTTP status ' || http_status
    ELSE 'no access anomalies in bounded signal set' END AS reason FROM (SELECT *, CASE WHEN contains(b, 'captcha') THEN 'captcha' WHEN contains(b, 'access denied') THEN 'access denied' END AS m
    FROM (SELECT *, lower(body) AS b FROM {access_runs}))""")
def access_class(t):
    return V.access_class(t.access_runs).select("run_id", "state", "reason")
