"""Cross-source metric derivation: selection, alignment, ratios, lineage and movement.

Points: point_id, site, series_id, source, metric_code, semantics_version, extract_type,
extract_id, period_start, period_end, retrieved_at, freshness, sample_status, value, limitations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalogs import RULE_VERSION
from tidemark.functions.hashing import canonical_hash, set_fingerprint
from tidemark.functions.shape import either, ts_text
from tidemark.operators.ordered import carry_previous, first_per_key, time_bucket, top_n

ROLE_KEYS = ["source", "metric_code", "semantics_version", "extract_type"]


def point_series_extract(points: DataFrame, series: DataFrame, extracts: DataFrame) -> DataFrame:
    """Points with the series and extract they belong to; the site must agree on all three."""
    return points.join(
        series.select("series_id", "site", "granularity", "unit"), ["series_id", "site"]
    ).join(extracts.select("extract_id", "site", F.col("status").alias("extract_status")), ["extract_id", "site"])


def source_points(points: DataFrame, series: DataFrame, extracts: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Hourly points of complete extracts whose period lies inside [start, end]; a bound not given is open."""
    inside = points.where(F.col("source").isin("GA4", "GAM"))
    if start is not None:
        inside = inside.where(F.col("period_start") >= start)
    if end is not None:
        inside = inside.where(F.col("period_end") <= end)
    return point_series_extract(
        inside, series.where(F.col("granularity") == "HOUR"), extracts.where(F.col("status") == "COMPLETE")
    ).drop("granularity", "extract_status")


def match_definition(points: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows that are numerator or denominator of a ratio, tagged with ratio and role.

    ``roles`` is the literal ratio catalog (two rows per ratio), hence the broadcast.
    """
    return points.join(F.broadcast(roles), ROLE_KEYS)


def freshness_rank(freshness: Column | str) -> Column:
    freshness = F.col(freshness) if isinstance(freshness, str) else freshness
    return either((freshness == "MATURE", 2), (freshness == "PRELIMINARY", 1), otherwise=0)


def best_current(points: DataFrame) -> DataFrame:
    """One revision per series and interval: mature first, then latest retrieval, then largest id."""
    return first_per_key(
        points,
        ["series_id", "period_start", "period_end"],
        [freshness_rank("freshness").desc(), F.col("retrieved_at").desc(), F.col("point_id").desc()],
    )


def alignment_status(has_num: Column, has_den: Column, compatible: Column, denominator: Column) -> Column:
    return either(
        (~has_num, "MISSING_NUMERATOR"),
        (~has_den, "MISSING_DENOMINATOR"),
        (~compatible, "INCOMPATIBLE_FRESHNESS"),
        (denominator <= 0, "ZERO_DENOMINATOR"),
        otherwise="OK",
    )


def interval_sums(points: DataFrame) -> DataFrame:
    """Sum and freshness range per site and interval of one role."""
    rank = freshness_rank("freshness")
    return points.groupBy("site", "period_start", "period_end").agg(
        F.sum("value").alias("total"), F.min(rank).alias("low"), F.max(rank).alias("high")
    )


def interval_align(num: DataFrame, den: DataFrame) -> DataFrame:
    """Full outer alignment of two interval sums on exact (site, start, end)."""
    keys = ["site", "period_start", "period_end"]
    left = num.select(*keys, F.col("total").alias("numerator"), F.col("low").alias("n_low"), F.col("high").alias("n_high"))
    right = den.select(*keys, F.col("total").alias("denominator"), F.col("low").alias("d_low"), F.col("high").alias("d_high"))
    low, high = F.least("n_low", "d_low"), F.greatest("n_high", "d_high")
    return left.join(right, keys, "full_outer").select(
        *keys,
        "numerator",
        "denominator",
        alignment_status(
            F.col("numerator").isNotNull(), F.col("denominator").isNotNull(), (low == high) & (high > 0), F.col("denominator")
        ).alias("alignment"),
    )


def limitation_union(*columns: str) -> Column:
    """Aggregate: sorted distinct union of limitation arrays.

    Limitation codes form a small fixed vocabulary, so the collected set is bounded.
    """
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(*columns) if len(columns) > 1 else columns[0]))))


def ratio_derive(points: DataFrame, roles: DataFrame) -> DataFrame:
    """Ratios per site and interval with value, skip reason, limitations and lineage fingerprint.

    Revision selection shuffles once by series and interval; numerator and denominator are then
    summed side by side in one aggregation instead of two sides joined afterwards.  Lineage is
    kept as an order-free fingerprint (the edges themselves are ``ratio_inputs``).
    """
    chosen = match_definition(best_current(points.join(F.broadcast(roles), ROLE_KEYS, "left_semi")), roles)
    is_num, is_den = F.col("role") == "NUMERATOR", F.col("role") == "DENOMINATOR"
    rank = freshness_rank("freshness")
    flags = F.when(
        F.col("sample_status") == "LIMITED", F.concat("limitations", F.array(F.lit("SOURCE_POINT_LIMITED")))
    ).otherwise(F.col("limitations"))
    member = F.concat_ws(":", "role", F.col("point_id").cast("string"))
    grouped = (
        chosen.withColumn("_flags", flags)
        .groupBy("site", "ratio_code", "period_start", "period_end")
        .agg(
            F.sum(F.when(is_num, F.col("value"))).alias("numerator"),
            F.sum(F.when(is_den, F.col("value"))).alias("denominator"),
            F.count_if(is_num).alias("numerator_points"),
            F.count_if(is_den).alias("denominator_points"),
            F.min(rank).alias("_low"),
            F.max(rank).alias("_high"),
            limitation_union("_flags").alias("limitations"),
            set_fingerprint(member).alias("input_fingerprint"),
        )
    )
    status = alignment_status(
        F.col("numerator_points") > 0,
        F.col("denominator_points") > 0,
        (F.col("_low") == F.col("_high")) & (F.col("_high") > 0),
        F.col("denominator"),
    )
    ok = F.col("alignment") == "OK"
    return (
        grouped.withColumn("alignment", status)
        .withColumn("value", F.when(ok, F.col("numerator") / F.col("denominator")))
        .withColumn("freshness", F.when(ok, F.when(F.col("_high") == 2, "MATURE").otherwise("PRELIMINARY")))
        .withColumn("derivation_key", F.when(ok, derivation_key()))
        .drop("_low", "_high")
    )


def derivation_key() -> Column:
    return canonical_hash(
        "site", "ratio_code", F.lit(RULE_VERSION), ts_text("period_start"), ts_text("period_end"), "input_fingerprint"
    )


def ratio_inputs(points: DataFrame, roles: DataFrame, ratios: DataFrame) -> DataFrame:
    """Lineage edge list (derivation, point, role) of the ratios that have a value."""
    chosen = match_definition(best_current(points.join(F.broadcast(roles), ROLE_KEYS, "left_semi")), roles)
    keys = ["site", "ratio_code", "period_start", "period_end"]
    derived = ratios.where(F.col("alignment") == "OK").select(*keys, "derivation_key", F.col("freshness").alias("ratio_freshness"))
    return chosen.select(*keys, "role", "point_id").join(derived, keys)


def skip_counts(ratios: DataFrame) -> DataFrame:
    return ratios.where(F.col("alignment") != "OK").groupBy("ratio_code", F.col("alignment").alias("reason")).count()


def lineage_recheck(
    edges: DataFrame, points: DataFrame, series: DataFrame, extracts: DataFrame, roles: DataFrame
) -> DataFrame:
    """Inputs that no longer support their derivation, with the first reason that applies."""
    role_side = roles.select("ratio_code", "role", *[F.col(k).alias(f"want_{k}") for k in ROLE_KEYS])
    current = points.select(
        "point_id", "series_id", "extract_id", "freshness", *ROLE_KEYS,
        F.col("period_start").alias("point_start"), F.col("period_end").alias("point_end"),
    )
    joined = (
        edges.join(current, "point_id", "left")
        .join(series.select("series_id", F.col("granularity")), "series_id", "left")
        .join(extracts.select("extract_id", F.col("status").alias("extract_status")), "extract_id", "left")
        .join(F.broadcast(role_side), ["ratio_code", "role"], "left")
    )
    same = F.lit(True)
    for key in ROLE_KEYS:
        same = same & F.col(key).eqNullSafe(F.col(f"want_{key}"))
    reason = either(
        (F.col("point_start").isNull(), "INPUT_VANISHED"),
        (~F.col("extract_status").eqNullSafe(F.lit("COMPLETE")), "EXTRACT_NOT_COMPLETE"),
        (~same | ~F.col("granularity").eqNullSafe(F.lit("HOUR")), "SEMANTICS_CHANGED"),
        ((F.col("point_start") != F.col("period_start")) | (F.col("point_end") != F.col("period_end")), "INTERVAL_CHANGED"),
        (F.col("freshness") != F.col("ratio_freshness"), "FRESHNESS_CHANGED"),
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "derivation_key", "ratio_code", "role", "point_id", "reason"
    )


def metric_value_gate(points: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: null when the raw text value is acceptable for its source and unit.

    Needs raw_value (text), source, unit, metric_api and value_kind (intValue or doubleValue).
    """
    number = F.expr("try_cast(raw_value AS double)")
    reason = either(
        (number.isNull(), "NOT_NUMERIC"),
        (F.isnan(number) | (F.abs(number) == float("inf")), "NOT_FINITE"),
        (number < 0, "NEGATIVE"),
        ((F.col("source") == "GA4") & (F.col("unit") == "RATIO") & (number > 1e6), "RATIO_TOO_LARGE"),
        (((F.col("source") != "GA4") | (F.col("unit") == "COUNT")) & (number > 1e18), "TOO_LARGE"),
        ((F.col("source") == "GSC") & (F.col("metric_api") == "ctr") & (number > 1), "CTR_ABOVE_ONE"),
        ((F.col("source") == "GSC") & (F.col("unit") == "COUNT") & (number != F.floor(number)), "COUNT_NOT_INTEGRAL"),
        ((F.col("source") == "GAM") & (F.col("unit") == "COUNT") & (F.col("value_kind") != "intValue"), "COUNT_NOT_INTEGER_TYPED"),
    )
    return points.withColumn("number", number).withColumn("reject_reason", reason)


def fractional_change(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Change against the preceding interval of the same key; undefined when that was zero.

    Intervals: keys, period_start, period_end, value, freshness; one row per key and interval.
    """
    packed = intervals.withColumn(
        "_me", F.struct("period_start", "period_end", "value", "freshness")
    )
    found = carry_previous(packed, keys, ["period_start"], "_me", "_prev", time_bucket("period_start"))
    contiguous = F.col("_prev.period_end") <= F.col("period_start")
    found = found.where(F.col("_prev").isNotNull() & contiguous)
    bad = (F.col("value") < 0) | (F.col("_prev.value") < 0)
    change = F.when(~bad & (F.col("_prev.value") != 0), (F.col("value") - F.col("_prev.value")) / F.col("_prev.value"))
    return found.select(
        *keys,
        F.col("_prev.period_start").alias("previous_start"),
        F.col("_prev.period_end").alias("previous_end"),
        F.col("_prev.freshness").alias("previous_freshness"),
        "period_start",
        "period_end",
        "freshness",
        change.alias("change"),
        bad.alias("invalid_negative"),
    )


def movement(change: Column, tolerance: float) -> Column:
    return either(
        (change.isNull(), "UNDEFINED"), (change > tolerance, "UP"), (change < -tolerance, "DOWN"), otherwise="STABLE"
    )


def divergence(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Compare the movement of two series over identical, equally fresh interval pairs."""
    shared = [*keys, "previous_start", "previous_end", "previous_freshness", "period_start", "period_end", "freshness"]
    a = fractional_change(left, keys).where(~F.col("invalid_negative")).select(*shared, F.col("change").alias("left_change"))
    b = fractional_change(right, keys).where(~F.col("invalid_negative")).select(*shared, F.col("change").alias("right_change"))
    both = a.join(b, shared)
    lm, rm = movement(F.col("left_change"), tolerance), movement(F.col("right_change"), tolerance)
    return both.withColumn("left_movement", lm).withColumn("right_movement", rm).withColumn(
        "diverged",
        (F.col("left_movement") != "UNDEFINED")
        & (F.col("right_movement") != "UNDEFINED")
        & (F.col("left_movement") != F.col("right_movement")),
    )


def series_head(points: DataFrame, n: int) -> DataFrame:
    """First ``n`` points per series by period."""
    return top_n(points, ["series_id"], [F.col("period_start"), F.col("point_id")], n, "position")


def dual_source_sites(connections: DataFrame) -> DataFrame:
    """Sites with both a GA4 and a GAM connection that is not archived."""
    live = connections.where(~F.col("archived") & F.upper("provider").isin("GA4", "GAM"))
    return live.groupBy("site").agg(F.countDistinct(F.upper("provider")).alias("sources")).where("sources = 2").select("site")


def monetization_visible(connections: DataFrame, series: DataFrame, points: DataFrame) -> DataFrame:
    """Points of the monetization source a site may see under its visibility setting.

    The most permissive live ad-server connection of the site decides.
    """
    level = either((F.col("visibility") == "ABSOLUTE", 2), (F.col("visibility") == "RELATIVE_ONLY", 1), otherwise=0)
    rule = (
        connections.where((F.upper("provider") == "GAM") & ~F.col("archived"))
        .groupBy("site")
        .agg(F.max(level).alias("level"))
        .where("level > 0")
    )
    shown = series.where(F.col("source") == "GAM").select("series_id", "site", "unit").join(rule, "site").where(
        (F.col("level") == 2) | (F.col("unit") != "CURRENCY")
    )
    return points.where(F.col("freshness").isin("MATURE", "PRELIMINARY")).join(shown, ["series_id", "site"])
