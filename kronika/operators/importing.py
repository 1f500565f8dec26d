"""Idempotent keys, import of one journal into another, key eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.kinds import is_reserved

OUTCOMES = ("above_ceiling", "skipped_reserved", "skipped_filtered", "skipped_reimported", "deduplicated", "imported")


def first_by_key(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Of rows with one key the first committed: an aggregation, so that a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), "global_sequence").alias("row")).select(key, "row.*")


def batch_outcomes(items: DataFrame, known: DataFrame) -> DataFrame:
    """``batch, items, cached, outcome``: replay if all keys are known, commit if none, else refuse; no key counts as unknown."""
    hits = items.join(known.select(F.col("key"), F.lit(1).alias("hit")).distinct(), "key", "left")
    counts = hits.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.count("hit").alias("cached"))
    outcome = F.when(F.col("cached") == F.col("items"), "replay").when(F.col("cached") == 0, "commit").otherwise("partial")
    return counts.withColumn("outcome", outcome)


def classified(source: DataFrame, known: DataFrame, ceiling: int, wanted: Column, marker: Column) -> DataFrame:
    """``outcome`` of every source row, tested in the order of ``OUTCOMES``; ``known`` holds keys (``event_id``) of the target.

    ``wanted`` is the caller's filter; ``marker`` tells rows that this target wrote itself.
    """
    keys = known.select("event_id").distinct().withColumn("there", F.lit(True))
    outcome = (
        F.when(F.col("global_sequence") > ceiling, "above_ceiling")
        .when(is_reserved(F.col("kind")), "skipped_reserved")
        .when(~F.coalesce(wanted, F.lit(False)), "skipped_filtered")
        .when(F.coalesce(marker, F.lit(False)), "skipped_reimported")
        .when(F.col("there").isNotNull(), "deduplicated")
        .otherwise("imported")
    )
    return source.join(keys, "event_id", "left").withColumn("outcome", outcome).drop("there")


def import_report(rows: DataFrame) -> DataFrame:
    """One row of counts, and the last source sequence that was looked at."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES[1:]]
    seen = F.when(F.col("outcome") != "above_ceiling", F.col("global_sequence"))
    return rows.agg(*counts, F.max(seen).alias("high_watermark"))


def imported(rows: DataFrame, first_sequence: int) -> DataFrame:
    """Rows to add, renumbered in source order.

    Numbers come from counts by range of the source sequence, then within the range, so that no task holds all rows.
    """
    width = 1 << 16
    taken = rows.where(F.col("outcome") == "imported").withColumn("range", F.expr(f"global_sequence div {width}"))
    counts = taken.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy("range").orderBy("global_sequence"))
    return (
        taken.join(offsets, "range")
        .withColumn("new_sequence", F.col("before") + nth - 1 + F.lit(first_sequence))
        .drop("range", "before", "outcome")
    )


def evicted(keys: DataFrame, keep: int) -> DataFrame:
    """Keys with whether the window of the last ``keep`` sequences still holds them."""
    frontier = keys.agg(F.max("sequence").alias("frontier"))
    return keys.join(F.broadcast(frontier)).withColumn("kept", F.col("sequence") >= F.col("frontier") - keep).drop("frontier")


def admission(items: DataFrame, held: int, cap: int, policy: str) -> DataFrame:
    """Admission of each batch's new keys against ``cap``: a key twice in a batch is an error, then the policy decides."""
    counts = items.where("key is not null").groupBy("batch").agg(
        F.count(F.lit(1)).alias("keys"), F.count_distinct("key").alias("new_keys")
    )
    over = F.col("new_keys") + held > cap
    verdict = (
        F.when(F.col("keys") > F.col("new_keys"), "duplicate_key")
        .when(over & F.lit(policy == "warn"), "admitted_over_cap")
        .when(over, "refused")
        .otherwise("admitted")
    )
    return counts.withColumn("verdict", verdict)
