"""Cursors, gaps, acknowledgements and backpressure over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .visibility import overlaps


def gaps(seen: DataFrame, cancelled: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Jumps in a cursor's ``global_sequence`` that a cancelled range explains: ``expected, delivered, shared_from, shared_to``.

    The row before comes from a window by range of the sequence and, for the first of a range, from the maxima of the ranges before.
    """
    rows = seen.select("global_sequence", F.expr(f"global_sequence div {width}").alias("range"))
    heads = rows.groupBy("range").agg(F.max("global_sequence").alias("last"))
    heads = heads.select("range", F.lag("last").over(W.orderBy("range")).alias("before_range"))
    own = F.lag("global_sequence").over(W.partitionBy("range").orderBy("global_sequence"))
    joined = rows.withColumn("own", own).join(heads, "range")
    expected = F.coalesce("own", "before_range", F.lit(-1)) + 1
    jumps = joined.select(expected.alias("lo"), F.col("global_sequence").alias("hi")).where("hi > lo")
    return overlaps(jumps, cancelled).select(F.col("lo").alias("expected"), F.col("hi").alias("delivered"), "shared_from", "shared_to")


def newest_gaps(found: DataFrame, keep: int) -> DataFrame:
    return found.orderBy(F.col("delivered").desc(), F.col("shared_from").desc()).limit(keep)


def acks(log: DataFrame) -> DataFrame:
    """First problem of each ack (``session, nth, sent_first, sent_last, ack, route, own_route``): range, route, order."""
    before = F.max("ack").over(W.partitionBy("session").orderBy("nth").rowsBetween(W.unboundedPreceding, -1))
    rows = log.withColumn("acked_before", before)
    verdict = (
        F.when((F.col("ack") < F.col("sent_first")) | (F.col("ack") > F.col("sent_last")), "out_of_range")
        .when(F.col("route") != F.col("own_route"), "wrong_route")
        .when(F.col("ack") < F.col("acked_before"), "regression")
        .otherwise("accepted")
    )
    return rows.select("session", "nth", "ack", verdict.alias("verdict"))


def backpressure(log: DataFrame, client: int, server: int, route: int) -> DataFrame:
    """In-flight deliveries after each step (``session, nth, sent, acked``) and where the cap is reached."""
    cap = min(client, server, route)
    upto = W.partitionBy("session").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    flying = F.sum(F.col("sent") - F.col("acked")).over(upto)
    return log.select("session", "nth", flying.alias("in_flight"), (flying >= cap).alias("slow_consumer"))


def receipt_stream(journal: DataFrame, kind: int, field: str, value: str) -> DataFrame:
    """Exact kind first, then equality of a decoded field."""
    return journal.where(F.col("kind") == kind).where(F.get_json_object("payload", f"$.{field}") == value)
