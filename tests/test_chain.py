"""The event chain against a plain evaluator that takes one run and one window at a time."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import chain as N

START = datetime(2024, 3, 1)
PAIR = (
    "run_id BIGINT, previous_id BIGINT, selection_scope STRING, site BIGINT, scheduled_for TIMESTAMP, template_id BIGINT, scenario_id BIGINT, url_id BIGINT, "
    + "".join(
        f"{s}_status STRING, {s}_completed_at TIMESTAMP, {s}_scripts_version STRING, {s}_network_version STRING, {s}_javascript_errors_version STRING, "
        f"{s}_seo_version STRING, {s}_canonical STRING, {s}_truncated BOOLEAN, {s}_noindex BOOLEAN, " for s in ("cur", "prev")
    ) + "skip_reasons ARRAY<STRING>"
)
NOINDEX = "cur_noindex AND NOT prev_noindex"


def corpus(seed):
    """Runs of one busy template and a few others; every url is visited once a window."""
    rng, runs, last = random.Random(seed), {}, {}
    number = 0
    for w in range(8):
        for url in range(9):
            number += 1
            template = 0 if url < 6 else url
            runs[number] = {
                "w": START + timedelta(hours=6 * w), "url": url, "template": template, "previous": last.get(url), "at": START + timedelta(hours=6 * w, minutes=url),
                "status": rng.choice(["COMPLETE"] * 9 + ["SITE_ERROR"]), "js": rng.choice(["j1"] * 15 + [None]), "net": "n1" if w < 6 else "n2",
                "cut": rng.random() < 0.15, "noindex": rng.random() < 0.4, "canonical": rng.choice([None, "a", "b"]), "scope": rng.choice(["EXACT_MONITORED_URL"] * 14 + ["SAME_TEMPLATE_URL_ROTATION"]),
                "deps": {m for m in range(4) if rng.random() < 0.6}, "errors": {m for m in range(3) if rng.random() < 0.5},
                "slots": {m: (rng.random() < 0.9, rng.choice([True, True, False, None])) for m in range(3) if rng.random() < 0.9},
            }
            last[url] = number
    return runs, {START + timedelta(hours=6 * w): "PARTIAL" if w == 4 else "COMPLETE" for w in range(10)}


def reasons(run, before):
    first = []
    if run["scope"] != "EXACT_MONITORED_URL":
        first = ["NON_EXACT_URL_LINEAGE"]
    elif "SITE_ERROR" in (run["status"], before["status"]):
        first = ["INVALID_CHECKPOINT_STATUS"]
    parts = ["INCOMPATIBLE_NETWORK_NORMALIZER"] if run["net"] != before["net"] else []
    parts += ["MISSING_JAVASCRIPT_ERRORS_STATE"] if run["js"] is None or before["js"] is None else []
    return first, parts


def plain(runs, windows):
    """(candidates, window reasons, episodes), folded run by run and window by window."""
    seen = lambda run: {s: p for s, (expected, p) in run["slots"].items() if expected and p is not None}
    local, skips, valid = [], defaultdict(int), defaultdict(list)
    for n, run in runs.items():
        if run["previous"] is None:
            continue
        before = runs[run["previous"]]
        first, parts = reasons(run, before)
        for r in first + parts if windows[run["w"]] == "COMPLETE" else ["INCOMPLETE_CHECKPOINT_WINDOW"]:
            skips[run["w"], r] += 1
        if first or parts:
            continue
        valid[run["w"]].append(n)
        say = lambda code, subject, action, weight=1: local.append((0, run["w"], n, code, str(subject), action, weight))  # noqa: E731, B023
        for m in run["deps"] - before["deps"]:
            say("THIRD_PARTY_DEPENDENCY_ADDED", m, "RECORD")
        for m in before["deps"] - run["deps"] if not (run["cut"] or before["cut"]) else ():
            say("THIRD_PARTY_DEPENDENCY_REMOVED", m, "RECORD")
        prior = runs.get(before["previous"]) if before["scope"] == "EXACT_MONITORED_URL" else None
        fit = prior is not None and prior["status"] == "COMPLETE" and prior["js"] == before["js"]
        for m in run["errors"] - before["errors"]:
            say("JS_ERROR_STARTED", m, "PENDING")
        for m in run["errors"] & before["errors"]:
            opens = fit and m not in prior["errors"]
            say("JS_ERROR_STARTED", m, "UPSERT" if opens else "SUPPORT", 2 if opens else 1)
        for m in before["errors"] - run["errors"]:
            say("JS_ERROR_STARTED", m, "RESOLVE")
        if run["noindex"] and not before["noindex"]:
            say("NOINDEX_ADDED", "rendered-page", "PENDING")
        if run["canonical"] != before["canonical"]:
            say("CANONICAL_CHANGED", "rendered-page", "RECORD")
        for s, present in seen(run).items():
            if not present and seen(before).get(s):
                say("GPT_EXPECTED_SLOT_MISSING", s, "PENDING")
    for w in windows:
        if not any(r["w"] == w and r["previous"] for r in runs.values()):
            skips[w, "EMPTY_CHECKPOINT_WINDOW"] = 0
    window = []
    for w, numbers in valid.items():
        if windows[w] != "COMPLETE":
            continue
        groups = defaultdict(list)
        for n in numbers:
            groups[runs[n]["template"]].append(n)
        for members in groups.values():
            hit = [n for n in members if runs[n]["noindex"] and not runs[runs[n]["previous"]]["noindex"]]
            if len(hit) >= 2:
                window.append((1, w, None, "NOINDEX_ADDED", "rendered-template", "RECORD", len(hit)))
            else:
                window += [(1, w, n, "NOINDEX_ADDED", "rendered-page", "RECORD", 1) for n in hit]
            for s in range(3):
                states = [(seen(runs[n])[s], seen(runs[runs[n]["previous"]]).get(s)) for n in members if s in seen(runs[n])]
                gone = sum(not p for p, _ in states)
                if gone >= 2:
                    action = "UPSERT" if sum(not p and b is True for p, b in states) >= 2 else "SUPPORT"
                    window.append((1, w, None, "GPT_EXPECTED_SLOT_MISSING", str(s), action, gone))
                elif not gone and len(states) >= 2:
                    window.append((1, w, None, "GPT_EXPECTED_SLOT_MISSING", str(s), "RESOLVE", 0))
    emitted = {(w, code) for _, w, _, code, _, _, _ in window}
    kept = [c for c in local if c[5] != "PENDING" or (c[1], c[3]) not in emitted] + window
    episodes, state = [], {}
    # One condition has one template here: only template 0 holds two urls.
    for _, w, n, code, subject, action, weight in sorted((c for c in kept if c[5] in N.CONDITION_ACTIONS), key=lambda c: (c[1], c[2] or 0)):
        key = (code, subject, runs[n]["url"] if n else None)
        if key in state and action == "RESOLVE":
            episodes.append((*key, state.pop(key), "RESOLVED"))
        elif action == "UPSERT" or (key in state and action == "SUPPORT"):
            state[key] = state.get(key, 0) + weight
    episodes += [(*key, count, "ACTIVE") for key, count in state.items()]
    return kept, dict(skips), episodes


def frames(spark, runs, windows):
    rows = []
    for n, run in runs.items():
        before = runs.get(run["previous"])
        side = lambda r: (r["status"], r["at"], "s1", r["net"], r["js"], "x1", r["canonical"], r["cut"], r["noindex"]) if r else (None,) * 9
        first, parts = reasons(run, before) if before else (["NON_EXACT_URL_LINEAGE"], [])
        rows.append((n, run["previous"], run["scope"] if before else None, 1, run["w"], run["template"], 0, run["url"], *side(run), *side(before), first or parts))
    pairs = spark.createDataFrame(rows, PAIR)
    states = spark.createDataFrame([(n, r["at"], r["status"], r["js"]) for n, r in runs.items()], "run_id BIGINT, completed_at TIMESTAMP, status STRING, javascript_errors_version STRING")
    many = lambda key: spark.createDataFrame([(n, m) for n, r in runs.items() for m in r[key]], "run_id BIGINT, member BIGINT")
    slots = spark.createDataFrame([(n, s, e, p) for n, r in runs.items() for s, (e, p) in r["slots"].items()], "run_id BIGINT, slot BIGINT, expected BOOLEAN, present BOOLEAN")
    known = spark.createDataFrame([(1, w, s) for w, s in windows.items()], "site BIGINT, scheduled_for TIMESTAMP, window_status STRING")
    pairs = N.with_prior(N.in_windows(pairs, known), states)
    return pairs, N.pair_facts(pairs, many("deps"), many("errors"), slots), known


def test_chain_equals_a_plain_evaluator(spark):
    upserts = 0
    for seed in (3, 4):
        runs, windows = corpus(seed)
        kept, skips, episodes = plain(runs, windows)
        pairs, facts, known = frames(spark, runs, windows)
        noindex = F.expr(NOINDEX)
        found = N.event_candidates(N.local_candidates(pairs, facts, noindex), N.window_candidates(pairs, facts, noindex)).cache()
        got = [(r.section, r.scheduled_for, r.run_id, r.code, r.subject, r.action, r.runs) for r in found.collect()]
        order = lambda rows: sorted(rows, key=str)
        assert order(got) == order(kept)
        assert {(r.scheduled_for, r.reason): r.runs for r in N.window_skips(pairs, known).collect()} == skips
        told = [(r.code, r.subject, r.url_id, r.supporting_count, r.status) for r in N.event_episodes(found).collect()]
        assert order(told) == order(episodes)
        upserts += sum(c[5] == "UPSERT" and c[0] == 1 for c in kept)
        found.unpersist()
    assert upserts


def test_run_skips_and_nothing_to_judge(spark):
    runs, windows = corpus(5)
    pairs, facts, _ = frames(spark, runs, windows)
    own = {(r.run_id, r.reason) for r in N.run_skips(pairs, facts).collect()}
    assert {(n, "NO_PREDECESSOR") for n, r in runs.items() if r["previous"] is None} == {x for x in own if x[1] == "NO_PREDECESSOR"}
    cut = {
        n for n, r in runs.items() if r["previous"] and not any(reasons(r, runs[r["previous"]])) and (r["cut"] or runs[r["previous"]]["cut"]) and runs[r["previous"]]["deps"] - r["deps"]
    }
    assert {n for n, reason in own if reason == "TRUNCATED_DEPENDENCY_ABSENCE"} == cut
    nothing = N.event_candidates(N.local_candidates(pairs.limit(0), facts.limit(0), F.expr(NOINDEX)), N.window_candidates(pairs.limit(0), facts.limit(0), F.expr(NOINDEX)))
    assert N.event_episodes(nothing).count() == 0
