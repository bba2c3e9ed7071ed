"""Small output helpers shared by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_text(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


def joined(value: Column | str) -> Column:
    """Sorted, comma-joined text of an array."""
    return F.array_join(F.array_sort(value), ",")


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def seconds(value: Column | str) -> Column:
    return F.unix_micros(value) / F.lit(1e6)


def either(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """First matching branch; branch order is the decision order."""
    (condition, value), *rest = branches
    column = F.when(condition, value)
    for condition, value in rest:
        column = column.when(condition, value)
    return column.otherwise(otherwise)
