"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources share a budget of words by weight.  A source's target stops at
``max_epochs`` times its size; the excess goes to the others by weight until none
is above its cap.  The filling has a closed form: with sources in the order of
cap / weight, the water level is the largest of
(budget - caps before) / (weights from here on).

A document is then taken ``floor(target / size of source)`` times whole, and once
more if it lies in the fractional part: documents of a source are ordered by a
seeded hash and taken while the running sum, to the middle of the document, is
within what is left of the target.  The running sum goes over hash buckets first, then
inside a bucket, so that a source of any size is spread over ``BUCKETS`` tasks.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; sources without words get target 0; documents of size 0 are never taken; an empty
table gives an empty result.  Only the id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
BUCKETS = 4096


def seeded_hash(column: Column, seed: int) -> Column:
    """60 bits of md5 over seed and value, so that any engine can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``source, source_size, target`` by capped water-filling over ``source, size`` rows."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth").asc())
    everything = W.partitionBy(F.lit(0))
    nth = F.col("nth")
    level = (F.lit(budget_share) * F.col("all_words") - F.col("caps_before")) / F.col("weights_left")
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weights_left", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.max(level).over(everything))
        .select(
            "source",
            "source_size",
            F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row."""
    hashed = seeded_hash(F.col("doc_id"), seed)
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).select("*", hashed.alias("h")),
        "sizes",
    )
    sizes = sizes.withColumn("bucket", F.shiftright("h", 48).cast("int"))
    goals = targets(sizes, weights, budget_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words")
    per_bucket = (
        sizes.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("bucket_from", before)
        .join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(
            F.col("source").alias("b_source"),
            F.col("bucket").alias("b_bucket"),
            "bucket_from",
            "source_size",
            "target",
            epochs.cast("long").alias("whole"),
        )
    )
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("bucket_from") + F.sum("size").over(inside) - F.col("size") / 2
    left = F.col("target") - F.col("whole") * F.col("source_size")
    return sizes.join(
        per_bucket, (F.col("bucket") == F.col("b_bucket")) & F.col("source").eqNullSafe(F.col("b_source"))
    ).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + F.when(middle <= left, 1).otherwise(0))).cast("long").alias("taken"),
    )
