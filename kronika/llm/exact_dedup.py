"""Exact dedup over a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by the SHA-256 digest of the
normalised text, one row for each distinct text.  New data is reduced to one row
for each digest, anti-joined with the index by sort-merge, and what is left is
appended.

Defined results: a null text counts as empty, and all empty texts are equal.
Rows that repeat a ``doc_id`` with equal texts get one decision.  An
empty table gives an empty result and leaves the index as it was.  Other columns
of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

#: White space that does not count when texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_points, digest`` of every row; reads only those two columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n_points"),
        F.sha2(F.regexp_replace(text, WHITE, ""), 256).alias("digest"),
    )


def groups(found: DataFrame) -> DataFrame:
    """One row for each digest: the row that stands for it and the group's size.

    Of equal texts the row with most code points, then the smallest id, stays.
    """
    return (
        found.groupBy("digest")
        .agg(
            F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .select(
            "digest",
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.less")).alias("n_points"),
            "group_size",
        )
    )


class DigestIndex:
    """A table ``digest, keep_id, n_points``, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def read(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def add(self, new: DataFrame) -> None:
        """Append the rows of ``new`` (one for each digest) that the index lacks."""
        new = new.select("digest", "keep_id", "n_points")
        if not self.spark.catalog.tableExists(self.name):
            self._append(new.limit(0))
        self._append(new.join(self.read().hint("merge"), "digest", "left_anti"))
        self.spark.catalog.refreshTable(self.name)


def dedup(
    docs: DataFrame,
    index: DigestIndex | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 32,
    hot_share: int = 200,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    ``keep_id`` is what the index holds for the text, which an earlier batch may
    have put there; ``group_size`` counts this batch.

    Groups with more than one row in ``hot_share`` number at most ``hot_share``;
    their answers are broadcast, so that a text which makes up a large part of
    the corpus never meets in one task.  All others join by sort-merge.
    """
    index = index or DigestIndex(docs.sparkSession, f"kronika_digests_{uuid.uuid4().hex}", buckets)
    found = materialize(digests(docs, id_col, text_col), "digests")
    batch = groups(found)
    index.add(batch)
    answers = batch.select("digest", "group_size").join(
        index.read().select("digest", "keep_id").hint("merge"), "digest"
    )
    hot = F.col("group_size") > max(1, found.count() // hot_share)
    few = F.broadcast(answers.where(hot))
    joined = found.join(few, "digest").unionByName(
        found.join(few.select("digest"), "digest", "left_anti").join(answers.where(~hot), "digest")
    )
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
