"""Visibility: an upper bound and half-open cancelled ranges, for all lanes or for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: More parts of ranges than this are not broadcast.
BROADCAST_RANGES = 20_000
BUCKET_BITS = 12
BUCKET = 1 << BUCKET_BITS


def merged_ranges(ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of half-open ranges ``start, end``; ranges that overlap or touch become one."""
    order = W.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        ranges.where("start < end")
        .withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy(*by, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def outside(rows: DataFrame, ranges: DataFrame, column: str = "global_sequence", lane: str | None = None) -> DataFrame:
    """Rows whose ``column`` lies in none of ``ranges`` (``start, end`` and, if ``lane`` is given, ``range_lane`` or null).

    Rows and ranges meet by bucket, an equi-join, so that a row is compared with the ranges of its bucket only.  Few ranges
    are broadcast, after a count; with more of them both sides are shuffled by bucket.
    """
    ranges = ranges.where("start < end").withColumnsRenamed({"start": "r_start", "end": "r_end"})
    inside = (F.col(column) >= F.col("r_start")) & (F.col(column) < F.col("r_end"))
    if lane:
        inside = inside & (F.col("range_lane").isNull() | (F.col("range_lane") == F.col(lane)))
    bucket = lambda at: F.shiftright(at, BUCKET_BITS)
    spread = ranges.withColumn("r_bucket", F.explode(F.sequence(bucket(F.col("r_start")), bucket(F.col("r_end") - 1))))
    if spread.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        spread = F.broadcast(spread)
    return rows.join(spread, (bucket(F.col(column)) == F.col("r_bucket")) & inside, "left_anti")


def visible(journal: DataFrame, cancelled: DataFrame, bound: int) -> DataFrame:
    """Rows below ``bound`` and outside every cancelled range."""
    return outside(journal.where(F.col("global_sequence") < bound), cancelled)


def visible_on_lane(journal: DataFrame, cancelled: DataFrame, bounds: Column, lane: int) -> DataFrame:
    """Rows of one lane below that lane's bound, outside global ranges (null lane) and the lane's own."""
    rows = journal.where((F.col("dag_lane") == lane) & (F.col("global_sequence") < bounds))
    return outside(rows, cancelled, lane="dag_lane")


def overlaps(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every (span, range) whose half-open ``[lo, hi)`` and ``[start, end)`` meet, with the shared part.

    Both sides are cut into buckets, so that the join is on equality; a pair is reported from the bucket in which its shared part starts.
    """
    lo, hi = F.greatest("lo", "start"), F.least("hi", "end")
    cut = lambda df, a, b: df.where(f"{a} < {b}").withColumn(
        "bucket", F.explode(F.sequence(F.expr(f"{a} div {BUCKET}"), F.expr(f"({b} - 1) div {BUCKET}")))
    )
    return (
        cut(spans, "lo", "hi")
        .join(cut(ranges, "start", "end"), "bucket")
        .withColumns({"shared_from": lo, "shared_to": hi})
        .where(f"shared_from < shared_to and bucket = shared_from div {BUCKET}")
        .drop("bucket")
    )
