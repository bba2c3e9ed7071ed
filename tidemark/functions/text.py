"""Masking, tokens and path families as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.shape import either

# --- fixed values: masking patterns -----------------------------------------------------
TOKEN = r"(?i)(?:[0-9a-f]{8}-[0-9a-f-]{27,}|\b[0-9a-f]{12,}\b)"
LONG_NUMBER = r"\d{4,}"
SPACE = r"\s+"
UNSAFE = r"[^a-zA-Z0-9_:-]+"
PATH_ID = r"(?i)^(?:\d+|[0-9a-f]{12,}|[0-9a-f-]{32,})$"
MAX_PATH, PATH_HEAD = 500, 480


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times within one expression."""
    return F.transform(F.array(value), use)[0]


def mask_volatile(value: Column) -> Column:
    """Identifiers become :token, long numbers :number, white space is squeezed."""
    masked = F.regexp_replace(F.regexp_replace(value, TOKEN, ":token"), LONG_NUMBER, ":number")
    return F.trim(F.regexp_replace(masked, SPACE, " "))


def safe_tokens(value: Column) -> Column:
    """Masked, cleaned, distinct tokens in order."""
    cleaned = F.transform(
        F.split(F.trim(value), SPACE),
        lambda raw: F.regexp_replace(mask_volatile(raw), UNSAFE, ""),
    )
    kept = F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))
    return F.array_join(kept, " ")


def path_family(path: Column) -> Column:
    """Path with identifiers replaced; long results end in a digest of the whole."""
    parts = F.transform(
        F.filter(F.split(path, "/"), lambda p: p != ""),
        lambda p: F.when(p.rlike(PATH_ID), F.lit(":id")).otherwise(mask_volatile(p)),
    )
    whole = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return bind(
        whole,
        lambda w: F.when(
            F.length(w) > MAX_PATH, F.concat(F.substring(w, 1, PATH_HEAD), F.lit("~"), F.substring(F.sha2(w, 256), 1, 16))
        ).otherwise(w),
    )


def directives(value: Column) -> Column:
    """Comma list to sorted lower-case directives."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.lower(F.trim(p)))
    return F.array_sort(F.filter(parts, lambda p: p != ""))


def title_hash(title: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(title, SPACE, " "))
    return F.when(squeezed != "", F.sha2(squeezed, 256))


def consent_hash(value: Column) -> Column:
    """Consent strings are only ever kept as a digest."""
    trimmed = F.trim(value)
    return F.when(trimmed != "", F.sha2(trimmed, 256))


def video_key(structural_path: Column) -> Column:
    return F.concat(F.lit("video-player|dom|"), F.sha2(structural_path, 256))


def slot_key(ad_unit_path: Column, element_id: Column) -> Column:
    path, element = F.trim(ad_unit_path), F.trim(element_id)
    return either(
        (F.coalesce(path, F.lit("")) != "", F.concat(F.lit("gpt|ad-unit|"), path)),
        (F.coalesce(element, F.lit("")) != "", F.concat(F.lit("gpt|dom|"), element)),
    )


def record_hash(domain: Column, account: Column, relationship: Column, authority: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", domain, account, relationship, F.coalesce(authority, F.lit(""))), 256)


def challenge_marker(body: Column) -> Column:
    """First challenge marker, in marker order, anywhere in the page text."""
    whole = F.lower(body)
    return F.coalesce(*[F.when(F.contains(whole, F.lit(m)), F.lit(m)) for m in CHALLENGE_MARKERS])


# --- fixed values: challenge markers, in precedence order ---------------------------------
CHALLENGE_MARKERS = (
    "captcha",
    "cf-challenge",
    "attention required! | cloudflare",
    "access denied",
    "request unsuccessful. incapsula",
    "denied access",
)
