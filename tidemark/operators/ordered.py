"""Order-dependent operators that survive hot keys.

A window over a whole key puts that key in one task.  Here a key is cut into buckets that
follow the order (usually a time span): each bucket is windowed on its own, and a small
per-bucket summary carries the state of all earlier buckets forward.  The summary has one row
per key and bucket, so even a key holding a third of all rows is spread over its buckets.
Keys and order columns must be non-null, and the bucket must not decrease with the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import RANK_TRIM_LIMIT

DAY = 86_400


def time_bucket(ts: Column | str, width_s: int = DAY) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(width_s)).cast("bigint")


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def carry_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, bucket: Column
) -> DataFrame:
    """Last non-null ``value`` strictly before each row; ``order`` is unique among rows that have one."""
    df = df.withColumn("_bucket", bucket)
    scope = [*keys, "_bucket"]
    local = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*scope).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order_struct(order))).alias("_end")
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*scope, F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    return (
        df.withColumn("_local", F.last(value, ignorenulls=True).over(local))
        .join(starts, scope)
        .withColumn(out, F.coalesce("_local", "_start"))
        .drop("_bucket", "_local", "_start")
    )


def running_count(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, out: str, bucket: Column
) -> DataFrame:
    """Number of flagged rows up to and including each row."""
    return running_sum(df, keys, order, F.when(flag, 1).otherwise(0).cast("bigint"), out, bucket)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str, bucket: Column
) -> DataFrame:
    """Sum of ``amount`` up to and including each row."""
    df = df.withColumn("_bucket", bucket).withColumn("_flag", amount)
    scope = [*keys, "_bucket"]
    local = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*scope).agg(F.sum("_flag").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*scope, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    return (
        df.withColumn("_local", F.sum("_flag").over(local))
        .join(starts, scope)
        .withColumn(out, F.col("_local") + F.col("_start"))
        .drop("_bucket", "_flag", "_local", "_start")
    )


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, bucket: Column) -> DataFrame:
    """Dense position 1..n of each row within its key."""
    return running_count(df, keys, order, F.lit(True), out, bucket)


def latest_before(
    facts: DataFrame, keys: Sequence[str], at: str, payloads: dict[str, Column], bucket_s: int = DAY
) -> DataFrame:
    """As-of self join: greatest payload struct at a strictly earlier ``at`` of the same key.

    ``payloads`` maps output columns to structs that start with the ordering fields and are null
    on rows that must not serve as that predecessor.  Rows sharing key and time collapse before
    the shuffle, so only distinct times are windowed; the result is joined back on (key, time).
    """
    points = (
        facts.groupBy(*keys, at)
        .agg(*[F.max(p).alias(f"_best_{n}") for n, p in payloads.items()])
        .withColumn("_micros", F.unix_micros(at))
        .withColumn("_bucket", time_bucket(at, bucket_s))
    )
    scope = [*keys, "_bucket"]
    local = Window.partitionBy(*scope).orderBy("_micros").rangeBetween(Window.unboundedPreceding, -1)
    ends = points.groupBy(*scope).agg(*[F.max(f"_best_{n}").alias(f"_end_{n}") for n in payloads])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*scope, *[F.max(f"_end_{n}").over(earlier).alias(f"_start_{n}") for n in payloads])
    # A later time always beats an earlier one, so the local best wins over the carried one.
    found = points.select(*scope, at, *[F.max(f"_best_{n}").over(local).alias(f"_local_{n}") for n in payloads]).join(starts, scope)
    found = found.select(*keys, at, *[F.coalesce(f"_local_{n}", f"_start_{n}").alias(n) for n in payloads])
    return facts.join(found, [*keys, at], "left")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rn") -> DataFrame:
    """First ``n`` rows per key; ranks are trimmed before the shuffle, so hot keys stay small."""
    by = list(keys) or [F.lit(1)]
    if n > RANK_TRIM_LIMIT:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if not _complex(df, c)]), F.lit(64))
        df = df.withColumn("_salt", salt)
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop("_salt", rank)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1).drop("_rn")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, left_id: str, right_at: str, right_id: str,
    payload: Sequence[str], out: str, forward: bool = False, strict: bool = False, width_s: int = DAY,
) -> DataFrame:
    """Nearest right row per left row: at or before ``left_at`` (at or after when ``forward``).

    Both sides merge into one timeline per key and each left row reads what is carried to it, so
    the cost is that of a sort, never of the pairs of a key.  Ties take the largest right id
    backward and the smallest forward.  A null ``left_at`` leaves that side unbounded.
    """
    sign = -1 if forward else 1
    edge = F.lit(2**62)
    seen = F.struct(*[F.col(c) for c in payload])
    kind_of_right = 1 if strict else 0
    rows = right.where(F.col(right_at).isNotNull()).select(
        *keys, (F.unix_micros(right_at) * sign).alias("_t"), F.lit(kind_of_right).alias("_kind"), (F.col(right_id) * sign).alias("_id"), seen.alias("_seen"),
        F.lit(None).cast(left.schema[left_id].dataType).alias("_ask"),
    )
    asks = left.select(
        *keys, F.coalesce(F.unix_micros(left_at) * sign, edge).alias("_t"), F.lit(1 - kind_of_right).alias("_kind"), F.lit(0).alias("_id"),
        F.lit(None).cast(rows.schema["_seen"].dataType).alias("_seen"), F.col(left_id).alias("_ask"),
    )
    line = carry_previous(
        rows.unionByName(asks), keys, ["_t", "_kind", "_id"], "_seen", out, F.floor(F.col("_t") / (width_s * 1_000_000))
    )
    found = line.where(F.col("_kind") == 1 - kind_of_right).select(F.col("_ask").alias(left_id), out)
    return left.join(found, left_id, "left")


def merged_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, bucket_s: int = 30 * DAY) -> DataFrame:
    """Each key's half-open spans [start, end) united: (keys, start, end), an open end null; keys may be null.

    A span that begins above all earlier ends begins an island.  What meets per key is one row per bucket, then one per island.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    rows = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    rows = rows.groupBy(*keys, start).agg(F.max(F.coalesce(end, far)).alias("_end")).withColumn("_bucket", time_bucket(start, bucket_s))
    scope = [*keys, "_bucket"]
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*scope).agg(F.max("_end").alias("_top"))
    carried = ends.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(scope)], F.max("_top").over(earlier).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    local = Window.partitionBy(*scope).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.withColumn("_local", F.max("_end").over(local)).join(carried, same).withColumn("_reach", F.greatest("_local", "_before"))
    heads = reached.where(F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).select(*keys, start, "_reach")
    # The last island of a key ends with the key's latest end, the others where the next one saw them end.
    last = rows.groupBy(*keys).agg(F.max("_end").alias("_reach")).select(*keys, F.lit(None).cast("timestamp").alias(start), "_reach")
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last())
    closed = heads.unionByName(last).withColumn("_until", F.lead("_reach").over(order)).where(F.col(start).isNotNull())
    return closed.select(*keys, start, F.when(F.col("_until") < far, F.col("_until")).alias(end))


def window_head(
    spans: DataFrame, facts: DataFrame, keys: Sequence[str], span_id: str, start: str, end: str, at: str, fact_id: str, n: str,
    bucket_s: int = DAY,
) -> DataFrame:
    """First facts of each span's inclusive window by (at, id), up to the bound in column ``n``.

    Facts are numbered per key once.  A span looks up the number before its start and then meets
    only the two blocks of ``n`` numbers its head can lie in, so a hot key never fans out.  The
    bound is the same for all spans and facts of a key; both sides carry it.
    """
    numbered = ordinal(facts, keys, [at, fact_id], "_no", time_bucket(at, bucket_s))
    starts = asof_join(
        spans.select(span_id, *keys, n, start, end), numbered, keys, start, span_id, at, fact_id, ["_no"], "_before",
        strict=True, width_s=bucket_s,
    )
    first = F.coalesce(F.col("_before._no"), F.lit(0)).alias("_from")
    block = lambda no: F.floor(no / F.col(n)).cast("bigint")
    asks = starts.select(span_id, *keys, n, F.col(end).alias("_end"), first).withColumn(
        "_block", F.explode(F.array_distinct(F.array(block(F.col("_from") + 1), block(F.col("_from") + F.col(n)))))
    )
    hits = asks.join(numbered.withColumn("_block", block(F.col("_no"))).drop(n), [*keys, "_block"]).where(
        (F.col("_no") > F.col("_from")) & (F.col("_no") <= F.col("_from") + F.col(n)) & (F.col(at) <= F.col("_end"))
    )
    return hits.withColumn("position", F.col("_no") - F.col("_from")).drop("_block", "_no", "_from", "_end", n)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], width: float
) -> DataFrame:
    """Interpolated percentiles per key without gathering the values of a key.

    Values are counted first, then ranked by a bucketed running sum over distinct values;
    only the two neighbours of each wanted rank are read off.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sum(counted, keys, [value], F.col("_n"), "_upto", F.floor(F.col(value) / width).cast("bigint"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    cells = ranked.join(totals, list(keys))

    def at_rank(rank: Column) -> Column:
        inside = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, share in points.items():
        place = F.lit(share) * (F.col("_total") - 1)
        aggs += [at_rank(F.floor(place)).alias(f"_{name}_lo"), at_rank(F.ceil(place)).alias(f"_{name}_hi")]
    found = cells.groupBy(*keys, "_total").agg(*aggs)
    shown = []
    for name, share in points.items():
        place = F.lit(share) * (F.col("_total") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        shown.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, F.col("_total").alias("values"), *shown)


def _complex(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("map", "variant")
