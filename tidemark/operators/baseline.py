"""Moving hour-of-week baselines: order statistics of the same local hour over the weeks before.

Points: series_id, period_start, value, zone.  A cell is one series at one local hour of the week;
its baseline for a week is read from the values of the ``weeks`` weeks before.  Weeks are
summarised as counts per value bin.  A week's counts enter the window one week later and leave it
``weeks`` weeks after that, so the window moves by adding one summary and taking another away; the
bins that hold the wanted ranks are found on these counts alone, and only their values are looked
at again.  Neither a series nor a cell is gathered anywhere: rows are spread by cell, week and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METHOD = "rolling_hour_of_week_median"
VERSION = "hour-of-week-v1"
# Bins a doubling of the value is cut into; only their order matters, not their edges.
BINS_PER_OCTAVE = 16
QUARTILES = {"lower_quartile": 0.25, "expected": 0.5, "upper_quartile": 0.75}
CELL = ["series_id", "hour_of_week"]
# Weeks are counted from a Monday.
FIRST_MONDAY = "1970-01-05"


def local_cell(start: Column, zone: Column) -> tuple[Column, Column]:
    """(week number, hour of week 0 to 167 from Monday) of an instant by the clock of its zone.

    When clocks go back two instants share a cell of one week, when they go forward a cell has none.
    """
    local = F.from_utc_timestamp(start, zone)
    monday = F.to_date(F.date_trunc("week", local))
    week = (F.datediff(monday, F.lit(FIRST_MONDAY).cast("date")) / 7).cast("int")
    return week, (F.weekday(local) * 24 + F.hour(local)).cast("int")


def value_bin(value: Column) -> Column:
    """Bin number that never falls when the value rises."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * BINS_PER_OCTAVE)).cast("int")


def weekly_counts(points: DataFrame) -> DataFrame:
    """(cell, week, bin, value, n): how often each value occurs; null and non-finite values are no evidence."""
    week, hour = local_cell(F.col("period_start"), F.col("zone"))
    fine = F.col("value").isNotNull() & (F.abs("value") < F.lit(float("inf")))
    return (
        points.where(fine & F.col("zone").isNotNull() & F.col("period_start").isNotNull())
        # -0.0 and 0.0 are one value.
        .select("series_id", hour.alias("hour_of_week"), week.alias("week"), (F.col("value") + F.lit(0.0)).alias("value"))
        .groupBy(*CELL, "week", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("bin", value_bin(F.col("value")))
    )


def moving_bins(counts: DataFrame, weeks: int) -> DataFrame:
    """(cell, week, bin, n) with n values of the bin in the ``weeks`` weeks before ``week``.

    Each summary is added one week after its own and subtracted ``weeks`` later; between two such steps n stands.
    """
    by_bin = counts.groupBy(*CELL, "week", "bin").agg(F.sum("n").alias("n"))
    steps = by_bin.select(
        *CELL, "bin",
        F.explode(F.array(
            F.struct((F.col("week") + 1).alias("week"), F.col("n").alias("step")),
            F.struct((F.col("week") + 1 + weeks).alias("week"), (-F.col("n")).alias("step")),
        )).alias("at"),
    ).groupBy(*CELL, "bin", "at.week").agg(F.sum("at.step").alias("step"))
    line = Window.partitionBy(*CELL, "bin").orderBy("week")
    held = steps.withColumn("n", F.sum("step").over(line)).withColumn("_until", F.lead("week").over(line) - 1)
    return held.where("n > 0").select(*CELL, F.explode(F.sequence("week", "_until")).alias("week"), "bin", "n")


def hour_week_baseline(points: DataFrame, weeks: int = 8, min_points: int = 2) -> DataFrame:
    """Quartiles of every cell for every week that has enough points before it.

    Columns: cell, week, points, lower_quartile, expected, upper_quartile, method, version, trained_from and
    trained_to (local Mondays, the second one exclusive).  Ranks interpolate linearly, as a continuous median does.
    """
    counts = weekly_counts(points)
    bins = moving_bins(counts, weeks)
    window = [*CELL, "week"]
    totals = bins.groupBy(*window).agg(F.sum("n").alias("points")).where(F.col("points") >= min_points)
    upto = F.sum("n").over(Window.partitionBy(*window).orderBy("bin"))
    ranked = bins.withColumn("_before", upto - F.col("n")).join(totals, window)
    ends = [f(F.lit(share) * (F.col("points") - 1)).cast("bigint") for share in QUARTILES.values() for f in (F.floor, F.ceil)]
    holds = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("n")) for r in ends]
    held = holds[0]
    for one in holds[1:]:
        held = held | one
    wanted = ranked.where(held).select(*window, "bin", "_before", "points")

    # Only now back to single values, and only to those in a bin that holds a wanted rank.
    sources = wanted.withColumnRenamed("week", "_for").withColumn("week", F.explode(F.sequence(F.col("_for") - weeks, F.col("_for") - 1)))
    values = (
        sources.join(counts.withColumnRenamed("n", "_n"), [*window, "bin"])
        .groupBy(*CELL, F.col("_for").alias("week"), "bin", "_before", "points", "value")
        .agg(F.sum("_n").alias("n"))
    )
    inside = F.sum("n").over(Window.partitionBy(*window, "bin").orderBy("value"))
    values = values.withColumn("_upto", F.col("_before") + inside).withColumn("_from", F.col("_upto") - F.col("n"))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("value")))

    picks = [at_rank(rank).alias(f"_r{k}") for k, rank in enumerate(ends)]
    found = values.groupBy(*window, "points").agg(*picks)
    shown = []
    for k, (name, share) in enumerate(QUARTILES.items()):
        place = F.lit(share) * (F.col("points") - 1)
        low, high = F.col(f"_r{2 * k}"), F.col(f"_r{2 * k + 1}")
        shown.append((low + (high - low) * (place - F.floor(place))).alias(name))
    monday = lambda week: F.date_add(F.lit(FIRST_MONDAY).cast("date"), (week * 7).cast("int"))
    return found.select(
        *window, "points", *shown, F.lit(METHOD).alias("method"), F.lit(VERSION).alias("version"),
        monday(F.col("week") - weeks).alias("trained_from"), monday(F.col("week")).alias("trained_to"),
    )


def with_expected(points: DataFrame, baseline: DataFrame) -> DataFrame:
    """Points with their cell's expectation and relative deviation; null where no baseline exists or nothing was expected."""
    week, hour = local_cell(F.col("period_start"), F.col("zone"))
    placed = points.withColumn("week", week).withColumn("hour_of_week", hour)
    joined = placed.join(baseline.select(*CELL, "week", "expected", F.col("points").alias("trained_points")), [*CELL, "week"], "left")
    return joined.withColumn("deviation", F.when(F.col("expected") != 0, (F.col("value") - F.col("expected")) / F.abs("expected")))
