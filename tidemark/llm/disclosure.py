"""Personal data and the terms that give it away, by what the corpus says about both.

Patterns find the protected entities (addresses of mail, hosts, cards, phones). A term is judged by information:
an entity e known in n_e of N documents holds log2(N / n_e) bits, and a term t seen in n_t documents, n_te of
them near e, gives PMI(t, e) = log2(N n_te / (n_t n_e)) of them away. Where that reaches the share ALPHA, t
discloses e, wherever in the corpus it stands, also where e itself has been taken out. A disclosing term is
generalised to its masked form ("baltimore" to "balt*", "47906" to "479*", judged like a term by the counts of all words
it covers) if that discloses none of the term's entities any more, and else removed.

Three passes over the texts: mentions with the words around them, document counts of the candidate terms, spans. What
travels between them is a filter of fixed size and tables; no set of terms or entities reaches the driver.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, stored

KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalized", "removed")
# A term that gives away this share of an entity's information, or more, discloses it.
ALPHA = 0.9
# Words on each side of a mention that count as seen near it.
NEAR_WORDS = 8
FILTER_BITS = 25
# Marks masked forms among the counted terms; no word holds it.
MARK = "*"
_CACHED_WORDS = 400_000

_LOCAL = "A-Za-z0-9._%+-"
_MAIL_START = re.compile(rf"[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_MAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMERIC = re.compile(r"[0-9](?:[ .-]?[0-9])+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _mails(text: str) -> Iterator[tuple[int, int]]:
    # A local part starts where its run of characters does, or where the match before has ended: no start is tried twice.
    at = 0
    while text.find("@", at) >= 0:
        found = _MAIL_START.match(text, at) or _MAIL.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def _octets(value: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in value.split(".")))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their check are dropped, not retried."""
    mails = [("email", a, b) for a, b in _mails(text)] if "@" in text else []
    hosts, cards = [], []
    for run in _NUMERIC.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        hosts += [("ip", *m.span()) for m in _IP.finditer(text, a, b) if _octets(m[0])]
        if b - a >= 13:
            for m in _CARD.finditer(text, a, b):
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    cards.append(("card", *m.span()))
    phones = []
    if "+" in text:
        phones = [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return mails + hosts + cards + phones


def entity(kind: str, value: str) -> str:
    """One name for all spellings of an entity."""
    if kind == "email":
        return f"email:{value.lower()}"
    if kind == "ip":
        return "ip:" + ".".join(p.lstrip("0") or "0" for p in value.split("."))
    return f"{kind}:{_NOT_DIGIT.sub('', value)}"


def blanked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its entities as line breaks: words keep their places, and no word of an entity is a term."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > at:
            out += [text[at : max(a, at)], "\n" * (b - max(a, at))]
            at = b
    return "".join([*out, text[at:]]) if out else text


def masked(word: str) -> str | None:
    """The first half of a word of six characters or more; shorter words have no form but nothing at all."""
    return word[: len(word) // 2] + MARK if len(word) >= 6 else None


def mentions(text: str, near: int, general: Callable[[str], str | None]) -> Iterator[tuple[str | None, str | None, str | None, int]]:
    """(entity, term, its masked form, context): each term near a mention once per entity, and one row without a term.

    Rows without an entity name each term near any of the text's mentions once.

    The context is a hash of the words near the entity's mentions, so that the evidence of copies can be told apart.
    """
    spans = base_spans(text)
    if not spans:
        return
    words = [(m.start(), m[0].lower()) for m in _WORD.finditer(blanked(text, spans))]
    starts = [a for a, _ in words]
    around: dict[str, list[str]] = {}
    for kind, a, b in spans:
        left, right = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        found = words[max(0, left - near) : left] + words[right : right + near]
        around.setdefault(entity(kind, text[a:b]), []).extend(w for _, w in found)
    every = set()
    for name, found in around.items():
        context = xxhash.xxh64_intdigest(" ".join(found)) >> 1
        yield name, None, None, context
        forms = set()
        for word in dict.fromkeys(found):
            form = general(word)
            yield name, word, form, context
            if form and form not in forms:
                forms.add(form)
                yield name, form, None, context
        every.update(found, forms)
    for term in every:
        yield None, term, None, 0


class TermFilter:
    """A filter of fixed size: keeps every term put in, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask, self.known = bits, len(bits) * 64 - 1, {}

    def __contains__(self, term: str) -> bool:
        h = xxhash.xxh64_intdigest(term.encode(), 42)
        a, b = h & self.mask, (h >> 32) & self.mask
        return bool((int(self.bits[a >> 6]) >> (a & 63)) & (int(self.bits[b >> 6]) >> (b & 63)) & 1)

    def word(self, word: str, general: Callable[[str], str | None]) -> tuple[str, str | None, bool, bool]:
        """(term, masked form, term kept, form kept) of a word as written; the latest words are remembered."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHED_WORDS:
                self.known.clear()
            term = word.lower()
            form = general(term)
            found = self.known[word] = (term, form, term in self, form is not None and form in self)
        return found


def term_filter(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter's 64-bit words; at most 2^(bits - 6) rows come to the driver, however many terms there are."""
    h = F.xxhash64("term")
    mask = F.lit((1 << bits) - 1)
    places = terms.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    held = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[held["at"].to_numpy(np.int64)] = held["word"].to_numpy(np.int64)
    return out.view(np.uint64)


def _texts(frame: pd.DataFrame) -> list[str]:
    return frame["text"].fillna("").tolist()


def _mention_pass(near: int, general):
    def run(frames):
        for frame in frames:
            rows = [r for text in _texts(frame) for r in mentions(text, near, general)]
            yield pd.DataFrame(rows, columns=["entity", "term", "form", "context"], dtype=object)

    return run


def _count_pass(held, general):
    def run(frames):
        kept = TermFilter(held.value)
        for frame in frames:
            counts: Counter[str] = Counter()
            for text in _texts(frame):
                terms = set()
                for word in set(_WORD.findall(blanked(text, base_spans(text)))):
                    term, form, own, formed = kept.word(word, general)
                    if own:
                        terms.add(term)
                    if formed:
                        terms.add(form)
                counts.update(terms)
            yield pd.DataFrame({"term": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    return run


def _span_pass(held, general, with_text):
    def run(frames):
        from pyspark import TaskContext

        kept, row = TermFilter(held.value), TaskContext.get().partitionId() << 40
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], _texts(frame)):
                spans = base_spans(text)
                rest, places = blanked(text, spans), []
                if any(kept.word(w, general)[2] for w in set(_WORD.findall(rest))):
                    for m in _WORD.finditer(rest):
                        term, _, own, _ = kept.word(m[0], general)
                        if own:
                            places.append((term, *m.span()))
                rows.append((row, doc_id, text if with_text else None, spans, places))
                row += 1
            yield pd.DataFrame(rows, columns=["row", "doc_id", "text", "base", "places"], dtype=object)

    return run


def pair_counts(docs: DataFrame, near: int = NEAR_WORDS, general=masked) -> DataFrame:
    """(entity, term, form, n, varied): documents in which a term stands near an entity, in more than one context or not.

    The rows without a term count the entity's own documents, those without an entity the documents in which a term stands
    near any entity.
    """
    rows = in_batches(docs.select(F.col("text").cast("string")), _mention_pass(near, general), "entity string, term string, form string, context long")
    return rows.groupBy("entity", "term").agg(F.max("form").alias("form"), F.count("*").alias("n"), (F.min("context") < F.max("context")).alias("varied"))


def discloses(n: int, n_te: Column, n_t: Column, n_e: Column, alpha: float) -> Column:
    """PMI(t, e) >= alpha * log2(N / n_e), written without logarithms; an entity in all documents holds no information."""
    return (n_e < n) & (n_te >= n_t * F.pow(n_e / F.lit(float(n)), F.lit(1.0 - alpha)))


def disclosing_terms(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, near: int = NEAR_WORDS, general=masked) -> DataFrame:
    """(term, action, form, n_entities, pmi): the terms that disclose, and what replaces them.

    A pair counts only if it was seen in two different contexts: a single text, however often copied, is no evidence
    that a term goes with an entity rather than both with that text. pmi is the largest one.
    """
    docs = docs.select(F.col("text").cast("string"))
    total = docs.count()
    pairs = stored(spark, pair_counts(docs, near, general), "entity-terms")
    known = pairs.where("term IS NULL").select("entity", F.col("n").alias("n_e"))
    # A term occurs in at least as many documents as it stands near some entity in; what fails by that needs no count.
    least = pairs.where("entity IS NULL").select("term", F.col("n").alias("n_least"))
    seen = pairs.where("entity IS NOT NULL AND term IS NOT NULL AND varied").join(known, "entity").join(least, "term")
    seen = stored(spark, seen.where(discloses(total, F.col("n"), F.col("n_least"), F.col("n_e"), alpha)), "candidate-terms")
    held = spark.sparkContext.broadcast(term_filter(seen.select("term").distinct()))
    counts = in_batches(docs, _count_pass(held, general), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    judged = seen.join(counts, "term").where(discloses(total, F.col("n"), F.col("n_t"), F.col("n_e"), alpha))
    judged = stored(spark, judged.withColumn("pmi", F.log2(F.lit(float(total)) * F.col("n") / (F.col("n_t") * F.col("n_e")))), "disclosures")
    forms = judged.where(F.col("term").endswith(MARK)).select("entity", F.col("term").alias("form"), F.lit(True).alias("open"))
    words = judged.where(~F.col("term").endswith(MARK)).join(forms, ["entity", "form"], "left")
    closed = F.col("form").isNotNull() & F.col("open").isNull()
    return words.groupBy("term").agg(
        F.when(F.every(closed), F.lit(ADDED[0])).otherwise(F.lit(ADDED[1])).alias("action"),
        F.when(F.every(closed), F.max("form")).alias("form"),
        F.count("*").alias("n_entities"),
        F.max("pmi").alias("pmi"),
    )


SPAN = "struct<kind: string, start: long, stop: long>"
ADDED_SPAN = "struct<k: int, start: long, stop: long, kind: string, term: string, form: string>"


def sanitizing_spans(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, near: int = NEAR_WORDS, general=masked, with_text: bool = False) -> DataFrame:
    """(row, doc_id, text, base, added): the spans of every row of docs, base by kind and start, added with their replacements.

    added holds (k, start, stop, kind, term, form) in order of kind and start. Null and empty texts have no spans; repeated
    rows and rows that share an id get a row each with equal spans; an empty table gives no rows. Texts are read whole, however
    long. Other columns of docs are ignored, whatever their names. row tells rows apart within one result; text is null
    unless asked for, and only rows with a candidate term are shuffled.
    """
    # Ids pass through pandas as strings: a null would turn a column of numbers into doubles.
    docs = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    terms = stored(spark, disclosing_terms(spark, docs, alpha, near, general), "disclosing-terms")
    held = spark.sparkContext.broadcast(term_filter(terms.select("term")))
    schema = f"row long, doc_id string, text string, base array<{SPAN}>, places array<struct<term: string, start: long, stop: long>>"
    found = stored(spark, in_batches(docs, _span_pass(held, general, with_text), schema), "spans").withColumn("doc_id", F.col("doc_id").cast("long"))
    none = F.array().cast(f"array<{ADDED_SPAN}>")
    spots = found.select("row", F.explode("places").alias("p")).select("row", "p.*").join(terms.select("term", "action", "form"), "term")
    order = F.array_position(F.array(*map(F.lit, ADDED)), F.col("action")).cast("int")
    one = F.struct(order.alias("k"), "start", "stop", F.col("action").alias("kind"), "term", "form")
    added = spots.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("added"))
    columns = ["row", "doc_id", "text", "base"]
    touched = found.where(F.size("places") > 0).select(*columns).join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    return found.where(F.size("places") == 0).select(*columns, none.alias("added")).unionByName(touched)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns."""
    joined = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    texts = F.filter(F.array(joined("base"), joined("added")), lambda x: x != "")
    return spans.select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), F.array_join(texts, ",").alias("spans"))


def rewritten(text: str, base, added) -> str:
    """Entities as [kind], generalised terms as their forms, removed ones as [...]; of overlapping entities the first counts."""
    puts = [(s["start"], s["stop"], f"[{s['kind']}]") for s in base] + [(s["start"], s["stop"], s["form"] or "[...]") for s in added]
    out, at = [], 0
    for a, b, put in sorted(puts):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitized(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, near: int = NEAR_WORDS, general=masked) -> DataFrame:
    """(doc_id, text): every text without its entities and without the terms that disclose one; null texts become empty."""

    def run(frames):
        for frame in frames:
            frame["text"] = [rewritten(t, b, a) for t, b, a in zip(frame["text"], frame["base"], frame["added"])]
            yield frame[["doc_id", "text"]]

    spans = sanitizing_spans(spark, docs, alpha, near, general, with_text=True)
    spans = spans.select(F.col("doc_id").cast("string"), "text", "base", "added")
    return in_batches(spans, run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))
