"""Zone rules. Timestamps are UTC instants; local wall clocks are zone-free values held in the
session zone UTC.  The three source rules differ on purpose and are not unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plus(value: Column, interval: str) -> Column:
    return value + F.expr(interval)


def wall_interval(local: Column, zone: Column | str, unit: str) -> Column:
    """Analytics rule: earlier reading of an ambiguous start, end one wall-clock unit later."""
    step = "INTERVAL '1' HOUR" if unit == "HOUR" else "INTERVAL '1' DAY"
    return F.struct(
        F.to_utc_timestamp(local, zone).alias("period_start"), F.to_utc_timestamp(_plus(local, step), zone).alias("period_end")
    )


def exists_locally(local: Column, zone: Column | str) -> Column:
    """False for wall-clock times a forward clock change skips."""
    return F.from_utc_timestamp(F.to_utc_timestamp(local, zone), zone) == local


def ad_server_hour(local: Column, zone: Column | str) -> Column:
    """Ad-server rule: a skipped hour is invalid, a repeated hour spans both readings and is flagged."""
    first = F.to_utc_timestamp(local, zone)
    exists = exists_locally(local, zone)
    again = F.coalesce(
        *[
            F.when(F.from_utc_timestamp(_plus(first, f"INTERVAL '{m}' MINUTE"), zone) == local, _plus(first, f"INTERVAL '{m}' MINUTE"))
            for m in (30, 60, 120)
        ]
    )
    return F.struct(
        F.when(exists, first).alias("period_start"),
        F.when(exists, _plus(F.coalesce(again, first), "INTERVAL '1' HOUR")).alias("period_end"),
        (exists & again.isNotNull()).alias("ambiguous"),
        (~exists).alias("nonexistent"),
    )


SEARCH_ZONE = "America/Los_Angeles"


def search_hour(text: Column) -> Column:
    """Search rule: the offset in the text must be the zone's own; one absolute hour."""
    instant = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    wall = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    valid = (
        instant.isNotNull() & (F.from_utc_timestamp(instant, SEARCH_ZONE) == wall) & (F.date_trunc("hour", wall) == wall)
    )
    valid = F.coalesce(valid, F.lit(False))
    return F.struct(
        F.when(valid, instant).alias("period_start"),
        F.when(valid, _plus(instant, "INTERVAL '1' HOUR")).alias("period_end"),
        valid.alias("valid"),
    )


def local_floor(ts: Column, zone: Column | str, hours: int) -> Column:
    """Local wall clock floored to a multiple of ``hours``."""
    local = F.from_utc_timestamp(ts, zone)
    start = F.date_trunc("hour", local)
    return start - F.make_dt_interval(hours=F.hour(local) % hours)


def slot(ts: Column, zone: Column | str, hours: int) -> Column:
    return F.to_utc_timestamp(local_floor(ts, zone, hours), zone)


def six_hour_window(ts: Column, zone: Column | str) -> Column:
    """Local 00/06/12/18 window as UTC bounds; five to seven hours long on clock-change days."""
    start = local_floor(ts, zone, 6)
    return F.struct(
        F.to_utc_timestamp(start, zone).alias("window_start"),
        F.to_utc_timestamp(_plus(start, "INTERVAL '6' HOUR"), zone).alias("window_end"),
    )


def next_boundary(state: Column, watermark: Column, zone: Column | str) -> Column:
    return F.when(state == "ON", six_hour_window(watermark, zone)["window_end"])


def google_date(year: Column, month: Column, day: Column) -> Column:
    """{year, month, day} to a date; null when it does not exist."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def run_time(text: Column) -> Column:
    """RFC 3339 text with a zone to a UTC instant, else null."""
    zoned = text.rlike(r"(Z|[+-]\d\d:\d\d)$") & (F.length(text) <= 100)
    return F.when(zoned, F.try_to_timestamp(text))
