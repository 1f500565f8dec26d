"""Hybrid clock points: (wall_ms, global_sequence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated_ms(timestamp_us: Column) -> Column:
    """Whole milliseconds, towards zero."""
    return ((timestamp_us - timestamp_us % 1000) / 1000).cast("long")


def point(wall_ms: str = "wall_ms", sequence: str = "global_sequence") -> Column:
    return F.struct(F.col(wall_ms).alias("wall_ms"), F.col(sequence).alias("sequence"))


def later(a: Column, b: Column) -> Column:
    """The point with the larger sequence; of equal ones the larger wall time."""
    key = lambda p: F.struct(p["sequence"], p["wall_ms"])
    return F.when(key(a) >= key(b), a).otherwise(b)


def earlier(a: Column, b: Column) -> Column:
    key = lambda p: F.struct(p["sequence"], p["wall_ms"])
    return F.when(key(a) <= key(b), a).otherwise(b)


def precedes(lane_a, depth_a, seq_a, lane_b, depth_b, seq_b) -> Column:
    """Positions compare only on one lane and depth, then by sequence."""
    return (lane_a == lane_b) & (depth_a == depth_b) & (seq_a < seq_b)


def position_order(lane_a, depth_a, seq_a, lane_b, depth_b, seq_b) -> Column:
    together = (lane_a == lane_b) & (depth_a == depth_b)
    return F.when(together, F.when(seq_a < seq_b, "before").when(seq_a > seq_b, "after").otherwise("equal")).otherwise(
        "unordered"
    )
