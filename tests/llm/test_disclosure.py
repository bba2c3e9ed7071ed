"""Op 11 against plain versions: base spans by the patterns as written, disclosing terms by counts over sets of documents."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidemark.llm import disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return (sum(turned[::2]) + sum(sum(map(int, str(2 * d))) for d in turned[1::2])) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def plain_spans(texts, alpha, near):
    """Per text: base and added spans, by sets of documents."""
    docs = []
    for text in texts:
        text = text or ""
        base = plain_base(text)
        covered = {i for _, a, b in base for i in range(a, b)}
        rest = "".join("\n" if i in covered else c for i, c in enumerate(text))
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", rest)]
        close = {}
        for kind, a, b in base:
            left = [w for w in words if w[0] < a][-near:]
            right = [w for w in words if w[0] >= b][:near]
            close.setdefault(disclosure.entity(kind, text[a:b]), []).extend(w for _, _, w in left + right)
        docs.append((base, words, close))
    form = lambda w: w[: len(w) // 2] + "*" if len(w) >= 6 else None
    both = lambda ws: set(ws) | {form(w) for w in ws if form(w)}
    n = len(docs)
    seen, known, near_by, contexts = {}, {}, {}, {}
    for k, (_, words, close) in enumerate(docs):
        for t in both([w for _, _, w in words]):
            seen.setdefault(t, set()).add(k)
        for e, ws in close.items():
            known.setdefault(e, set()).add(k)
            for t in both(ws):
                near_by.setdefault((e, t), set()).add(k)
                contexts.setdefault((e, t), set()).add(tuple(ws))
    open_ = {
        (e, t)
        for (e, t), at in near_by.items()
        if len(contexts[e, t]) > 1 and len(known[e]) < n and len(at) >= len(seen[t]) * (len(known[e]) / n) ** (1 - alpha)
    }
    actions = {}
    for e, t in open_:
        if not t.endswith("*"):
            fine = form(t) is not None and (e, form(t)) not in open_
            actions[t] = actions.get(t, True) and fine
    out = []
    for base, words, _ in docs:
        added = [("generalized" if actions[w] else "removed", a, b) for a, b, w in words if w in actions]
        out.append((base, sorted(added, key=lambda s: (s[0] != "generalized", s[1]))))
    return out


ODD = [
    "a@b.c_d@e.f.g x", "@@a@b@c.d", "me@host", "+%@x.y..z", "1.2.3.4.5.6.7.8", "1.2.3", "0000255.1.1.256 256.1.1.1 255.255.255.255",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "00000000000000", "+1 (040) 555-0631 x", "+1 2 +49-30.123 456 78)", "++1234567890+",
    "+1((((((((", "１２３@a.b", "9" * 3000, "1." * 400, "a" * 3000 + "@", "é@ü.de mail@x.é", "12-34 56-78 90-12 34", "+12345678\n9", "x.92@mail6.example.com,",
]


def test_base_spans():
    rng = random.Random(3)
    parts = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", ".", "@", " ", "-", "7", "+", "é", "x_y", "(", "\n", "255"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        assert disclosure.base_spans(text) == plain_base(text), text


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    common = [f"w{k}" for k in range(40)]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    out = [None, "", "...", *ODD]
    # The same surname, street and badge number stand by one address in different texts; the family of names is common elsewhere.
    for k in range(4):
        out.append(f"{prose(12)} Kowalska of Quux {['lane', 'road'][k % 2]} ann@corp.example badge 47906 {prose(9)}")
    out += [f"{prose(6)} Kowalska {prose(5)}", f"{prose(4)} kowalik {prose(4)}", f"{prose(4)} Kowalczyk and kowaliko {prose(3)}"]
    out += [f"{prose(8)} kowarsch {prose(2)}" for _ in range(60)]
    # One text copied often is no evidence.
    out += [f"zebrafish {' '.join(common[:9])} bob@corp.example unicorns"] * 30
    out += [prose(20) for _ in range(150)] + [prose(9_000) + " call +49 30 1234567 Kowalska"]
    return out


def test_spans_equal_sets(spark, texts):
    rows = [(k, t, "x", [1], "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, places array<int>, kind string")
    for alpha, near in ((0.9, 8), (0.6, 3)):
        got = {r.doc_id: r for r in disclosure.digest(disclosure.sanitizing_spans(spark, docs, alpha, near)).collect()}
        wanted = plain_spans(texts, alpha, near)
        assert len(got) == len(texts)
        for k, (base, added) in enumerate(wanted):
            named = [",".join(f"{kind}:{a}:{b}" for kind, a, b in spans) for spans in (base, base + added)]
            assert got[k].spans == named[1], (k, texts[k])
            assert got[k].base_sha256 == hashlib.sha256(named[0].encode()).hexdigest()
            assert [got[k][f"n_{kind}"] for kind in PLAIN] == [sum(s[0] == kind for s in base) for kind in PLAIN]
    assert any("removed" in r.spans for r in got.values())


def test_sanitized_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in disclosure.sanitized(spark, docs).collect()}
    first = next(k for k, t in enumerate(texts) if t and "badge" in t)
    assert "[email]" in got[first] and "ann@" not in got[first] and "kowa*" in got[first] and "Quux" not in got[first]
    later = next(k for k, t in enumerate(texts) if t and "Kowalska" in t and "@" not in t)
    assert "Kowalska" not in got[later]
    assert "zebrafish" in got[next(k for k, t in enumerate(texts) if t and "zebrafish" in t)]
    assert got[0] == "" and got[1] == "" and got[2] == "..."


def test_empty_and_shared_ids(spark):
    schema = "doc_id long, text string"
    assert disclosure.digest(disclosure.sanitizing_spans(spark, spark.createDataFrame([], schema))).collect() == []
    rows = [(None, "a@b.c"), (None, "a@b.c"), (2**60 + 1, "none"), (2**60 + 1, "1.2.3.4 x")]
    got = disclosure.digest(disclosure.sanitizing_spans(spark, spark.createDataFrame(rows, schema))).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1152921504606846977", ""), ("1152921504606846977", "ip:0:7"), ("None", "email:0:5"), ("None", "email:0:5")]
