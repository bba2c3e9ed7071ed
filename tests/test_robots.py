"""Verdicts of the rule index against a matcher that tries every rule."""

from __future__ import annotations

import random

from tidemark.operators import config_text as K


def matches(pattern, path):
    """Whether the pattern, cut at its wildcards, is found piece by piece along the path."""
    ends = pattern.endswith("$")
    pieces = (pattern[:-1] if ends else pattern).split("*")
    if not path.startswith(pieces[0]):
        return False
    if len(pieces) == 1:
        return path == pieces[0] if ends else True
    at = len(pieces[0])
    for piece in pieces[1:-1]:
        found = path.find(piece, at)
        if found < 0:
            return False
        at = found + len(piece)
    if ends:
        return path.endswith(pieces[-1]) and len(path) - len(pieces[-1]) >= at
    return path.find(pieces[-1], at) >= 0


def allowed(rules, user_agent, path):
    agents = {a for a, _, _ in rules if a == "*" or (user_agent and a in user_agent.lower())}
    if not agents or path is None:
        return True
    size = lambda a: 0 if a == "*" else len(a)
    longest = max(map(size, agents))
    hits = [
        (len(p.replace("*", "").removesuffix("$")), d == "allow") for a, d, p in rules if a in agents and size(a) == longest and p is not None and matches(p, path)
    ]
    return max(hits)[1] if hits else True


def test_index_equals_every_rule(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    rules = {(f, a, d, "/" + "".join(rng.choice("ab/a*") for _ in range(rng.randint(0, 6))) + rng.choice(["", "", "$", "*"]))
             for f in (1, 2) for a in ("*", "bot", "big", "bigbot") for d in ("allow", "disallow") for _ in range(12 if f == 1 else 2)}
    rules |= {(3, "bot", None, None), (3, "*", "disallow", "/"), (4, "bot", "disallow", "/a.c+(x)"), (4, "bot", "allow", "/$/a")}
    urls = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.choice(["BigBot/1", "bot", "other", "", None]), rng.choice(["/" + word(rng.randint(0, 9)), "/a.c+(x)y", "/abc", "/$/ab", None])) for i in range(800)]
    urls.append((900, 1, "bot", "/" + "ab" * 4000))
    got = K.robots_allowed(
        spark.createDataFrame(urls, "url_id BIGINT, file_id BIGINT, user_agent STRING, path STRING"),
        spark.createDataFrame(sorted(rules, key=str), "file_id BIGINT, agent STRING, directive STRING, pattern STRING"),
    ).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r.allowed == allowed([x[1:] for x in rules if x[0] == r.file_id], r.user_agent, r.path), r
    assert len({r.allowed for r in got}) == 2


def test_no_rules(spark):
    urls = spark.createDataFrame([(1, 1, "bot", "/a")], "url_id BIGINT, file_id BIGINT, user_agent STRING, path STRING")
    none = spark.createDataFrame([], "file_id BIGINT, agent STRING, directive STRING, pattern STRING")
    assert [r.allowed for r in K.robots_allowed(urls, none).collect()] == [True]
    assert K.robots_allowed(urls.limit(0), none).count() == 0
