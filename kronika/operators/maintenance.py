"""Compaction, fences and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import TOMBSTONE, is_reserved


def with_segment(journal: DataFrame, rows: int) -> DataFrame:
    return journal.withColumn("segment", F.expr(f"global_sequence div {rows}"))


def should_compact(sealed: int, least: int = 2) -> bool:
    return sealed >= least


def compaction_plan(journal: DataFrame, by: str, least: int = 2) -> DataFrame:
    """``sealed, decision`` of every ``by``: segments but the last are sealed, and too few of them are not worth a rewrite."""
    sealed = journal.groupBy(by).agg((F.count_distinct("segment") - 1).alias("sealed"))
    return sealed.withColumn("decision", F.when(F.col("sealed") >= least, "compact").otherwise("skip"))


def merge(journal: DataFrame, path: str, files: int) -> None:
    """Rewrite as fewer files in commit order; rows do not change."""
    journal.repartitionByRange(files, "global_sequence").sortWithinPartitions("global_sequence").write.mode("overwrite").parquet(path)


def retain(journal: DataFrame, keep: Column, active_segment: int) -> DataFrame:
    """Drop rows that fail ``keep`` from sealed segments; the active one stays whole."""
    return journal.where(keep | (F.col("segment") >= active_segment))


def tombstone(journal: DataFrame, keep: Column, active_segment: int) -> DataFrame:
    """Rows that fail ``keep`` in sealed segments change kind only."""
    buried = ~keep & (F.col("segment") < active_segment)
    return journal.withColumn("kind", F.when(buried, TOMBSTONE).otherwise(F.col("kind")))


def compaction_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of every segment before and after, with what became of it."""
    count = lambda df, name: df.groupBy("segment").agg(
        F.count(F.lit(1)).alias(name), F.count_if(F.col("kind") == TOMBSTONE).alias(name + "_tombstones")
    )
    joined = count(before, "rows_before").join(count(after, "rows_after"), "segment", "left").na.fill(0)
    outcome = (
        F.when(F.col("rows_after") < F.col("rows_before"), "rows_dropped")
        .when(F.col("rows_after_tombstones") > F.col("rows_before_tombstones"), "tombstoned")
        .otherwise("unchanged")
    )
    return joined.select("segment", "rows_before", "rows_after", "rows_after_tombstones", outcome.alias("outcome"))


def fenced(journal: DataFrame, fences: DataFrame) -> DataFrame:
    """Rows outside fences that are open or were cancelled; committed ones show."""
    from .visibility import outside

    hidden = fences.where("state <> 'committed'").select("start", "end")
    return outside(journal, hidden)


def committed_batches(frames: DataFrame) -> DataFrame:
    """Frames of batches that have a commit marker (``marker = 'commit'``), without the markers."""
    done = frames.where("marker = 'commit'").select("batch").distinct()
    return frames.where("marker = 'row'").join(done, "batch", "left_semi")


def reserved_kinds(journal: DataFrame) -> DataFrame:
    return journal.where(is_reserved(F.col("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))
