"""Aggregates over the evidence of one observation run: network, errors, auctions, consent,
video, performance and ad slots.  Null means not observed and is never replaced by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.functions.hashing import canonical_hash, set_fingerprint
from tidemark.functions.shape import either
from tidemark.operators.intervals import instant_join, interval_join
from tidemark.operators.ordered import carry_previous, first_per_key


def identified(network: DataFrame) -> DataFrame:
    """Requests with their dependency key; requests without a host drop out."""
    return network.where(U.host(F.col("url")).isNotNull()).withColumn(
        "stable_key", U.dependency_key(F.col("url"), F.col("resource_type"))
    )


def network_agg(network: DataFrame) -> DataFrame:
    """Requests, failures, status classes and the per-status map of each dependency of a run."""
    by_status = identified(network).groupBy("run_id", "stable_key", "status").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("error_text", F.lit("")) != "").alias("failures")
    )

    def status_class(digit: int) -> Column:
        inside = F.floor(F.col("status") / 100) == digit
        return F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias(f"status_{digit}xx")

    pair = F.when(F.col("status").isNotNull(), F.concat_ws(":", F.col("status").cast("string"), F.col("n").cast("string")))
    # One entry per status code, so the list is bounded by the code space.
    return by_status.groupBy("run_id", "stable_key").agg(
        F.sum("n").alias("requests"),
        F.sum("failures").alias("failures"),
        *[status_class(d) for d in (2, 3, 4, 5)],
        F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("statuses"),
    )


def network_state(aggregates: DataFrame) -> DataFrame:
    """One order-free fingerprint per run over all its dependencies and their counts."""
    line = F.concat_ws(
        ":", "stable_key", *[F.col(c).cast("string") for c in ("requests", "failures", "status_4xx", "status_5xx")]
    )
    return aggregates.groupBy("run_id").agg(F.count("*").alias("dependencies"), set_fingerprint(line).alias("state_hash"))


def js_errors(errors: DataFrame) -> DataFrame:
    """Fingerprint and count of each masked error per run.  Errors: run_id, message, source."""
    message = T.mask_volatile(F.lower("message"))
    path = U.path(F.col("source"))
    shaped = errors.select(
        "run_id", message.alias("message"), U.host(F.col("source")).alias("source_host"),
        F.when(path != "", T.path_family(path)).alias("source_path"),
    )
    return shaped.groupBy("run_id", "message", "source_host", "source_path").agg(F.count("*").alias("occurrences")).withColumn(
        "fingerprint", canonical_hash(F.lit("js-error-v1"), "message", "source_host", "source_path")
    )


def script_set(scripts: DataFrame) -> DataFrame:
    """Number and fingerprint of the distinct script identities of a run."""
    unique = scripts.where(U.host(F.col("url")).isNotNull()).select(
        "run_id", U.dependency_key(F.col("url"), F.lit("script")).alias("stable_key")
    ).distinct()
    return unique.groupBy("run_id").agg(F.count("*").alias("scripts"), set_fingerprint("stable_key").alias("state_hash"))


def auction_agg(events: DataFrame, default_timeout: int | None, default_units: int | None) -> DataFrame:
    """One row per auction.  Events: run_id, auction_key, seq, event_type, elapsed_ms,
    timeout_ms, ad_units.  Settings take the last non-zero value; the end is the last one seen.
    """
    kind = F.col("event_type")
    ended = kind.isin("auctionEnd", "auctionTimeout")
    first_init = F.when((kind == "auctionInit") & F.col("elapsed_ms").isNotNull(), F.col("seq"))

    def last_set(column: str, default: int | None) -> Column:
        return F.coalesce(F.max_by(column, F.when(F.col(column) > 0, F.col("seq"))), F.lit(default)).alias(column)

    return events.groupBy("run_id", "auction_key").agg(
        F.min_by("elapsed_ms", first_init).alias("started_ms"),
        F.max_by("elapsed_ms", F.when(ended, F.col("seq"))).alias("ended_ms"),
        last_set("timeout_ms", default_timeout),
        last_set("ad_units", default_units),
        F.count_if(kind == "bidRequested").alias("requests"),
        F.count_if(kind == "bidResponse").alias("responses"),
        F.count_if(kind == "noBid").alias("no_bids"),
        F.count_if(kind.isin("bidTimeout", "auctionTimeout")).alias("timeouts"),
    )


def bidder_agg(events: DataFrame) -> DataFrame:
    """Per auction and bidder: counts, wins and response times."""
    keys = ["run_id", "auction_key", "bidder"]
    known = events.where(F.col("bidder").rlike(r"^[A-Za-z0-9_.-]{1,100}$"))
    kind = F.col("event_type")
    took = F.when((kind == "bidResponse") & (F.col("response_ms") >= 0), F.col("response_ms"))
    return known.groupBy(*keys).agg(
        F.count_if(kind == "bidRequested").alias("requests"),
        F.count_if(kind == "bidResponse").alias("responses"),
        F.count_if(kind == "noBid").alias("no_bids"),
        F.count_if(kind.isin("bidTimeout", "auctionTimeout")).alias("timeouts"),
        F.count_if(kind == "bidWon").alias("wins"),
        F.min(took).alias("response_min"), F.max(took).alias("response_max"), F.avg(took).alias("response_avg"),
    )


def first_ad_request_after(auctions: DataFrame, network: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Earliest ad-server request of the run at or after the auction's end, else its start.

    Both sides merge into one timeline per run that is read backwards, so each auction looks up
    the request carried to it instead of being paired with every request of its run.
    """
    ads = network.where(U.is_ad_server(U.host(F.col("url")), U.path(F.col("url"))) & F.col("at_ms").isNotNull())
    after = F.coalesce("ended_ms", "started_ms", F.lit(0))
    auction_side = auctions.select(
        "run_id", (-after.cast("bigint")).alias("_neg"), F.lit(1).alias("_kind"), F.col("auction_key"), F.lit(None).cast("bigint").alias("_at")
    )
    request_side = ads.groupBy("run_id", "at_ms").agg(F.lit(1)).select(
        "run_id", (-F.col("at_ms").cast("bigint")).alias("_neg"), F.lit(0).alias("_kind"), F.lit("").alias("auction_key"), F.col("at_ms").cast("bigint").alias("_at")
    )
    line = carry_previous(
        auction_side.unionByName(request_side), ["run_id"], ["_neg", "_kind", "auction_key"], "_at", "first_request_ms",
        F.floor(F.col("_neg") / bucket_ms),
    )
    return line.where(F.col("_kind") == 1).select("run_id", "auction_key", "first_request_ms")


def consent_phase_agg(network: DataFrame, consent: DataFrame) -> DataFrame:
    """Requests per run, consent phase and dependency.  Consent: run_id, boundary_ms, consent_path."""
    joined = identified(network).join(consent, "run_id", "left")
    later = F.coalesce(F.col("at_ms") >= F.col("boundary_ms"), F.lit(False))
    phase = either(
        (~later, "PRE_CONSENT"), (F.col("consent_path") == "REJECT", "POST_REJECT"), otherwise="POST_ACCEPT"
    )
    failed = F.col("error_text").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(False))
    return joined.groupBy("run_id", phase.alias("phase"), "stable_key").agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("errors"), F.min("at_ms").alias("first_request_ms")
    )


def video_attribution(network: DataFrame, players: DataFrame) -> DataFrame:
    """Video requests of a run, credited to its player only when there is exactly one."""
    path = U.path(F.col("url"))
    vast = U.is_vast(path)
    failed = F.col("error_text").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(False))
    seen = network.groupBy("run_id").agg(
        F.count_if(vast).alias("vast"), F.count_if(vast & failed).alias("vast_errors"),
        F.count_if(U.is_media(path, F.col("resource_type")) & ~vast).alias("media"),
    )
    counts = players.groupBy("run_id").agg(F.count("*").alias("player_count"))
    runs = seen.join(counts, "run_id", "full_outer")
    total = F.coalesce("player_count", F.lit(0))
    observed = (F.coalesce("vast", F.lit(0)) + F.coalesce("media", F.lit(0))) > 0
    limits = F.array_compact(
        F.array(
            F.when(F.coalesce("vast", F.lit(0)) > 0, "vast_payload_not_inspected"),
            either(
                (observed & (total == 0), "video_network_player_not_observable"),
                (observed & (total > 1), "video_network_player_attribution_ambiguous"),
            ),
        )
    )
    credit = lambda c: F.when(total == 1, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return runs.select(
        "run_id", total.cast("bigint").alias("player_count"), credit("vast"), credit("vast_errors"), credit("media"), limits.alias("limitations")
    )


GAP_MS, SPAN_MS, MAX_CLS = 1_000, 5_000, 10_000.0


def largest_session(samples: Column) -> Column:
    """Largest layout-shift session of an array of struct(t, v).

    A session goes on while the gap stays below 1 s, its span below 5 s and its sum above zero.
    """
    zero = F.lit(0.0)
    start = F.struct(zero.alias("start"), zero.alias("last"), zero.alias("total"), zero.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        goes_on = (acc["total"] > 0) & (x["t"] - acc["last"] < GAP_MS) & (x["t"] - acc["start"] < SPAN_MS)
        total = F.when(goes_on, acc["total"] + x["v"]).otherwise(x["v"])
        return F.struct(
            F.when(goes_on, acc["start"]).otherwise(x["t"]).alias("start"), x["t"].alias("last"), total.alias("total"),
            F.greatest(acc["best"], total).alias("best"),
        )

    return F.aggregate(F.array_sort(samples), start, step, lambda acc: F.least(acc["best"], F.lit(MAX_CLS)))


def cls_sessions(shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Largest session per page load.  Shifts: keys, t (ms within the load), v.

    Shifts of one instant always share a session, so they are summed first: what is collected
    is at most one entry per time unit of one page load, however many rows there are.
    """
    instants = shifts.groupBy(*keys, "t").agg(F.sum("v").alias("v"))
    sample = F.struct(F.col("t").cast("double").alias("t"), F.col("v").alias("v"))
    return instants.groupBy(*keys).agg(F.collect_list(sample).alias("_s")).select(*keys, largest_session(F.col("_s")).alias("cls"))


def interaction_proxy(interactions: DataFrame, keys: list[str]) -> DataFrame:
    """Longest interaction with a usable id; null when there is none."""
    usable = (F.col("interaction_id") > 0) & (F.col("interaction_id") <= 1_000_000_000)
    return interactions.groupBy(*keys).agg(F.max(F.when(usable, F.col("duration_ms"))).alias("inp_ms"))


PERF_SCHEMA = """supported_entry_types ARRAY<STRING>, was_hidden BOOLEAN, lcp_candidates ARRAY<DOUBLE>,
 layout_shifts ARRAY<ARRAY<DOUBLE>>, interactions ARRAY<ARRAY<DOUBLE>>, long_task_count DOUBLE, long_task_total_ms DOUBLE,
 navigation MAP<STRING, DOUBLE>, errors ARRAY<STRING>,
 samples_truncated STRUCT<interaction: BOOLEAN, layout_shift: BOOLEAN, lcp: BOOLEAN>"""
MAX_TIME_MS = 86_400_000.0
# --- fixed values: observer error codes -----------------------------------------------------
OBSERVER_ERRORS = (
    "EVENT_OBSERVER_ERROR",
    "LCP_OBSERVER_ERROR",
    "LAYOUT_SHIFT_OBSERVER_ERROR",
    "LONG_TASK_OBSERVER_ERROR",
    "SNAPSHOT_ERROR",
)


def _ok(value: Column, maximum: float = MAX_TIME_MS) -> Column:
    return F.when((value >= 0) & (value <= maximum), value)


def _pairs(value: Column, maximum: float) -> Column:
    full = F.filter(value, lambda p: F.size(p) == 2)
    shaped = F.transform(full, lambda p: F.struct(_ok(p[0]).alias("t"), _ok(p[1], maximum).alias("v")))
    return F.filter(shaped, lambda s: s["t"].isNotNull() & s["v"].isNotNull())


def perf_summary(snapshots: DataFrame) -> DataFrame:
    """Page-load metrics and ordered limitations from one JSON payload per run."""
    df = snapshots.withColumn("p", F.from_json("payload", PERF_SCHEMA))
    p = lambda name: F.col(f"p.{name}")
    has = lambda kind: F.coalesce(F.array_contains(p("supported_entry_types"), kind), F.lit(False))
    hidden = F.coalesce(p("was_hidden"), F.lit(False))
    lcp = F.array_max(F.filter(p("lcp_candidates"), lambda v: (v >= 0) & (v <= MAX_TIME_MS)))
    shifts = F.coalesce(_pairs(p("layout_shifts"), MAX_CLS), F.array().cast("array<struct<t:double,v:double>>"))
    touched = F.filter(_pairs(p("interactions"), MAX_TIME_MS), lambda s: (F.floor(s["t"]) > 0) & (s["t"] <= 1_000_000_000))
    inp = F.array_max(F.transform(touched, lambda s: s["v"]))
    df = df.withColumn("lcp_ms", F.when(has("largest-contentful-paint") & ~hidden, lcp))
    df = df.withColumn("cls", F.when(has("layout-shift") & ~hidden, largest_session(shifts)))
    df = df.withColumn("inp_ms", F.when(has("event"), inp))
    nav = F.coalesce(p("navigation"), F.create_map().cast("map<string,double>"))
    load = _ok(F.try_element_at(nav, F.lit("load_event_end")))
    errors = F.array_sort(F.array_distinct(F.filter(p("errors"), lambda e: e.isin(*OBSERVER_ERRORS))))
    cut = [F.coalesce(p(f"samples_truncated.{n}"), F.lit(False)) for n in ("interaction", "layout_shift", "lcp")]
    backgrounded = hidden & (has("largest-contentful-paint") | has("layout-shift"))
    # Backgrounding is noted at the first metric it concerns.
    lcp_note = either(
        (~has("largest-contentful-paint"), "lcp_api_unsupported"), (hidden, "performance_observation_backgrounded"),
        (F.col("lcp_ms").isNull(), "lcp_candidate_not_observed"),
    )
    shift_note = either(
        (~has("layout-shift"), "layout_shift_api_unsupported"),
        (backgrounded & ~has("largest-contentful-paint"), "performance_observation_backgrounded"),
    )
    inp_note = either(
        (~has("event"), "inp_proxy_event_timing_unsupported"),
        (F.col("inp_ms").isNull(), "inp_proxy_unavailable_no_qualifying_interaction"),
    )
    notes = F.array_compact(
        F.array(
            lcp_note, shift_note, inp_note,
            F.when(~has("longtask"), "long_task_api_unsupported"),
            either((F.size(nav) == 0, "navigation_timing_not_observed"), (load == 0, "load_event_not_observed")),
            F.when(F.size(errors) > 0, "performance_observer_partial_error"),
            F.when(cut[0] | cut[1] | cut[2], "performance_samples_truncated"),
        )
    )
    whole = lambda c: F.when((c >= 0) & (c <= 1_000_000) & (c == F.floor(c)), c.cast("bigint"))
    return df.select(
        "run_id", "lcp_ms", "cls", "inp_ms",
        F.when(has("longtask"), whole(p("long_task_count"))).alias("long_tasks"),
        F.when(has("longtask"), _ok(p("long_task_total_ms"))).alias("long_task_ms"),
        _ok(F.try_element_at(nav, F.lit("response_start"))).alias("ttfb_ms"),
        F.when(load != 0, load).alias("load_ms"),
        notes.alias("limitations"),
    )


def slot_rows(snapshots: DataFrame) -> DataFrame:
    """Observed ad slots: of the entries of one key the last one wins.

    Snapshots: run_id, pos, ad_unit_path, element_id and nullable times.
    """
    keyed = snapshots.withColumn("stable_key", T.slot_key(F.col("ad_unit_path"), F.col("element_id"))).where("stable_key IS NOT NULL")
    return first_per_key(keyed, ["run_id", "stable_key"], [F.col("pos").desc()])


def expected_vs_observed(observed: DataFrame, expected: DataFrame, times: list[str]) -> DataFrame:
    """Full outer: expected but absent has present = false and null times, extra has expected = false."""
    keys = ["run_id", "stable_key"]
    left = observed.select(*keys, F.lit(True).alias("present"), *times)
    right = expected.select(*keys, F.lit(True).alias("expected")).distinct()
    return left.join(right, keys, "full_outer").select(
        *keys, F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("present", F.lit(False)).alias("present"), *times
    )


def valid_at(facts: DataFrame, validity: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Validity rows in force at each fact: valid_from <= at and (open or valid_to > at)."""
    live = F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at))
    return instant_join(facts, validity, keys, at, ("valid_from", "valid_to")).where(live)


def overlapping(windows: DataFrame, validity: DataFrame, keys: list[str]) -> DataFrame:
    """Validity rows that overlap [window_start, window_end], as the run grid reads them."""
    live = F.col("valid_to").isNull() | (F.col("valid_to") > F.col("window_start"))
    return interval_join(windows, validity, keys, ("window_start", "window_end"), ("valid_from", "valid_to")).where(live)


CONSENT_SCHEMA = """tcfApiDetected BOOLEAN, capturedAtMs DOUBLE, apiReadyAtMs DOUBLE, tcStateAvailableAtMs DOUBLE,
 latest STRUCT<gdprApplies: BOOLEAN, tcString: STRING, cmpId: DOUBLE, cmpStatus: STRING, eventStatus: STRING>"""


def consent_state(snapshots: DataFrame) -> DataFrame:
    """One row per run from the consent payload; the consent string survives only as a digest."""
    df = snapshots.withColumn("c", F.from_json("payload", CONSENT_SCHEMA))
    c = lambda name: F.col(f"c.{name}")
    whole = lambda v: F.when((v >= 0) & (v <= 2_147_483_647), v.cast("bigint"))
    return df.select(
        "run_id", F.coalesce(c("tcfApiDetected"), F.lit(False)).alias("api_detected"), whole(c("apiReadyAtMs")).alias("api_ready_ms"),
        c("latest.gdprApplies").alias("gdpr_applies"), T.consent_hash(c("latest.tcString")).alias("tc_hash"),
        whole(c("latest.cmpId")).alias("cmp_id"), F.trim(c("latest.eventStatus")).alias("event_status"),
    )


def access_class(runs: DataFrame) -> DataFrame:
    """State of our own access path.  Runs: navigation_failed, body, http_status."""
    marker = T.challenge_marker(F.col("body"))
    odd = (F.col("http_status") >= 400) | F.col("http_status").between(300, 399)
    state = either(
        (F.col("navigation_failed"), "degraded"), (marker.isNotNull(), "challenge_suspected"),
        (F.coalesce(odd, F.lit(False)), "degraded"), otherwise="ok",
    )
    reason = either(
        (F.col("navigation_failed"), F.lit("navigation failed")),
        (marker.isNotNull(), F.concat(F.lit("deterministic challenge markers observed: "), marker)),
        (F.coalesce(odd, F.lit(False)), F.concat(F.lit("unexpected HTTP status "), F.col("http_status").cast("string"))),
        otherwise=F.lit("no access anomalies in bounded signal set"),
    )
    return runs.withColumn("state", state).withColumn("reason", reason)
