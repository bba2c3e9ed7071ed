"""Bounded numbers, memory sizes and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.catalogs import SEVERITIES
from tidemark.functions.shape import either

JSON_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def bounded_number(text: Column, maximum: float) -> Column:
    """JSON number text within 0..maximum; anything else, true and false included, is null."""
    number = F.when(text.rlike(JSON_NUMBER), text.try_cast("double"))
    return F.when((number >= 0) & (number <= maximum), number)


def bounded_int(text: Column, maximum: float) -> Column:
    number = bounded_number(text, maximum)
    return F.when(number == F.floor(number), number.cast("bigint"))


# --- fixed values: memory units in MiB ------------------------------------------------------
MIB = {"B": 1 / (1024 * 1024), "KiB": 1 / 1024, "MiB": 1.0, "GiB": 1024.0}


def mem_to_mib(text: Column) -> Column:
    """'249.7MiB / 1GiB' to MiB; null for an unknown unit or unreadable text."""
    used = F.trim(F.split(text, "/")[0])
    pattern = r"^([0-9.]+)([A-Za-z]+)$"
    factor = either(*[(F.regexp_extract(used, pattern, 2) == unit, F.lit(value)) for unit, value in MIB.items()])
    return F.regexp_extract(used, pattern, 1).try_cast("double") * factor


def severity_rank(severity: Column) -> Column:
    return either(*[(severity == name, F.lit(rank)) for rank, name in enumerate(SEVERITIES)])


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def higher_severity(current: Column, proposed: Column) -> Column:
    return severity_name(F.greatest(severity_rank(current), severity_rank(proposed)))


def severity_for(
    policy: Column, default: Column, min_affected: Column, critical: Column, affected: Column, valid: Column
) -> Column:
    """Severity of a rule for affected and valid URL counts; null for impossible counts."""
    impossible = (affected < 0) | (valid < 0) | (affected > valid)
    return either(
        (impossible, None),
        ((policy == "NOINDEX_SCOPE") & (affected >= min_affected), "CRITICAL"),
        (policy == "NOINDEX_SCOPE", "MEDIUM"),
        ((policy == "AFFECTED_URL_COUNT") & (affected >= critical) & (affected == valid), "CRITICAL"),
        otherwise=default,
    )


def fingerprints_equal(left: Column, right: Column) -> Column:
    """Two string maps hold exactly the same entries."""
    return F.array_sort(F.map_entries(left)) == F.array_sort(F.map_entries(right))
