"""Line dedup by overlapping three-line windows; columns only.

Each run of three consecutive lines is hashed. A window seen before - in a smaller (doc_id, text hash, line number) - is a later
occurrence, and all lines covered by later occurrences go. Windows are judged on the input. Hashes are grouped with
a map-side minimum, and only windows that occur again are joined back, so a very common window is one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 3


def without_repeats(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """docs with text cut, and n_lines, n_removed.

    A null text stays null with zero lines; an empty text is one empty line; a text of fewer lines than a window
    keeps all. Rows that repeat doc_id and text count as one place and are cut alike. A null doc_id comes first. Other
    columns pass unchanged unless they bear one of the added names.
    """
    base = docs.drop("n_lines", "n_removed")
    lines = F.split(F.col("text"), "\n", -1)
    keyed = base.withColumn("_key", F.md5(F.coalesce("text", F.lit(""))))
    last = F.size(lines) - width
    windows = keyed.where(F.col("text").isNotNull() & (last >= 0)).select(
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_doc"),
        "_key",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(i.alias("i"), F.unhex(F.md5(F.concat_ws("\n", F.slice(lines, i + 1, width)))).alias("h")),
            )
        ).alias("w"),
    ).select("_doc", "_key", "w.i", "w.h")
    place = F.struct("_doc", "_key", "i")
    again = windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final")
    later = windows.join(again.select("h", "first"), "h").where(place > F.col("first"))
    starts = later.groupBy("_doc", "_key").agg(F.collect_set("i").alias("_starts"))
    cut = keyed.withColumn("_doc", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).join(starts, ["_doc", "_key"], "left")
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + width - 1))))
    # Lines to keep, by looking each position up in a map rather than in a list.
    gone = F.map_from_arrays(covered, F.transform(covered, lambda _: F.lit(True)))
    cut = cut.withColumns({"_gone": gone, "_lines": lines})
    kept = F.filter("_lines", lambda _, i: F.col("_gone")[i].isNull())
    text = F.when(F.col("_starts").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    counts = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long"),
        "n_removed": F.coalesce(F.size(F.map_keys("_gone")), F.lit(0)).cast("long"),
    }
    out = cut.withColumns(counts).withColumn("text", text)
    return out.select(*base.columns, "n_lines", "n_removed")
