"""Plumbing of the two exact repeat removers: from anchors to the windows that have an earlier copy.

Both cut a text into overlapping windows and give each window one anchor, a place that depends on the window's content
only.  Windows of equal content therefore have anchors of equal key, and consecutive windows of one anchor form a
segment.  What happens to segments is the same for both:

1. keys that occur once are settled: their windows have no copy;
2. segments of equal content are settled but for the first, whose windows the others repeat;
3. first segments whose key has several contents are left, and only these are looked at window by window.

Keys are fast hashes that only bring candidates together: two contents under one key cost time, not correctness.  What
is taken for equal has equal 128-bit cryptographic digests of its bytes.

All grouping is partial aggregation and equality joins, so a passage that a third of the rows hold is summed up before
it is dealt out and its join is split by Spark where it is skewed.  Each aggregate is written before it is joined: Spark
splits the skewed partitions of a join that stands straight over two exchanges, not over an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, staged

#: Rows of segments: row and v (which text), at (first window), n (windows), key, and the content's digest.
SEGMENT = "row long, v long, at int, n int, key long, c1 long, c2 long"


def told_apart(rows: DataFrame) -> DataFrame:
    """Rows (row, text) as (row, v, text): v is 0, or names the text where rows of one id have several, so that what is
    found in one of them isn't taken from another."""
    named = F.xxhash64(F.coalesce("text", F.lit("")))
    several = staged(rows.groupBy("row").agg(F.min(named).alias("a"), F.max(named).alias("z")).where("a < z").select("row", F.lit(True).alias("several")))
    if several.isEmpty():
        return rows.select("row", F.lit(0).cast("long").alias("v"), "text")
    return rows.join(several, "row", "left").select("row", F.when(F.col("several"), named).otherwise(F.lit(0).cast("long")).alias("v"), "text")


def settle(segments: DataFrame, within: bool) -> tuple[DataFrame, DataFrame]:
    """(copies, open): segments (row, v, at, n) all of whose windows have an earlier copy, and those (row, v, at, n, key,
    several) that must be looked at by window.

    within: whether an earlier place of the same text counts as earlier.
    """
    place = F.struct("row", "at") if within else F.col("row")
    counted = segments.groupBy("key").agg(F.count("*").alias("c"), F.min("row").alias("a"), F.max("row").alias("z"))
    shared = staged(counted.where("c > 1" if within else "a < z").select("key"))
    held = staged(segments.join(shared, "key"))
    first = staged(held.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.min("key").alias("key")))
    kinds = staged(first.groupBy("key").agg(F.count("*").alias("several")).where("several > 1"))
    told = staged(held.join(first.drop("key"), ["c1", "c2"]).select("row", "v", "at", "n", "key", (place > F.col("first")).alias("copy")))
    # A text's later segments of its own first content stay open only if they can't be copies (place equal to first).
    rest = staged(told.where(~F.col("copy")).join(kinds, "key").select("row", "v", "at", "n", "key", "several"))
    forget(shared, held, first, kinds)
    return told.where("copy").select("row", "v", "at", "n"), rest


def earlier(windows: DataFrame) -> DataFrame:
    """(row, v, at) of the windows (row, v, at, c1, c2) of which an earlier row has an equal one."""
    windows = staged(windows)
    first = staged(windows.groupBy("c1", "c2").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").drop("last"))
    return windows.join(first, ["c1", "c2"]).where("row > first").select("row", "v", "at")
