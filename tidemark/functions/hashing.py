"""Deterministic identities over delimiter-joined strings and order-free set fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("string"), F.lit(""))


def canonical_hash(*parts: Column | str) -> Column:
    """sha256 over the parts in the order given, joined by a vertical bar; null is empty."""
    return F.sha2(F.concat_ws("|", *[text(p) for p in parts]), 256)


def hash60(value: Column | str, lane: int = 0) -> Column:
    """60 bits of the md5 of a string as a non-negative BIGINT; two independent lanes."""
    return F.conv(F.substring(F.md5(text(value)), 1 + 15 * lane, 15), 16, 10).cast("bigint")


def set_fingerprint(member: Column | str, when: Column | None = None) -> Column:
    """Fingerprint of a set of distinct strings as a plain partial aggregate.

    Exclusive-or of member hashes plus the count: independent of order, and no task ever
    holds the members, so a group of any size stays cheap.
    """
    member = F.col(member) if isinstance(member, str) else member
    if when is not None:
        member = F.when(when, member)
    return F.sha2(
        F.concat_ws(
            "|",
            F.count(member).cast("string"),
            F.coalesce(F.bit_xor(F.when(member.isNotNull(), hash60(member, 0))), F.lit(0)).cast("string"),
            F.coalesce(F.bit_xor(F.when(member.isNotNull(), hash60(member, 1))), F.lit(0)).cast("string"),
        ),
        256,
    )


def uuid_from_hash(*parts: Column | str) -> Column:
    """Stable identifier in UUID layout (version 5 bits) taken from sha1 of the joined parts."""
    digest = F.sha1(F.concat_ws("|", *[text(p) for p in parts]))
    variant = F.element_at(
        F.array(*[F.lit(x) for x in "89ab"]),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
