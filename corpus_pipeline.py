"""A corpus pipeline of training-data operators over ``documents``.

Every stage takes all rows that the one before it kept, written as Parquet and read again, and returns the columns of
documents; the last returns the encoding.  No stage reads anything but its input.

* language ID rejects texts without letters (``und``) and texts of no language, whose best mean marginal is
  below ``MIN_SCORE``;
* exact dedup keeps one row of equal texts;
* near-dedup keeps one document of each component at similarity 0.8;
* mixing repeats or drops documents so that sources come near their targets;
* byte-level BPE encodes what is left.

Rows that repeat a ``doc_id`` share its decisions; rows without one are decided as if they had an id of their own made from the
text, so that those with equal texts share theirs.  SQL cannot express the language model nor the encoding, so there is no
oracle; tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronika.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from kronika.llm.storage import materialize, table

MIN_SCORE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs.select(*COLUMNS), MIN_SCORE)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``: the id, or where there is none a number from 2^62 on by the text, so that real ids come first."""
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), own).alias("row_key"))


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` with keys less the documents that ``decided`` does not keep."""
    gone = decided.where("not kept").select(F.col("doc_id").alias("row_key"))
    return docs.join(gone, "row_key", "left_anti").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, exact_dedup.dedup(rows, id_col="row_key"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return without(rows, near_dedup.near_duplicates(rows, percent=80, id_col="row_key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    taken = mixing.mix(rows, id_col="row_key").where("taken > 0").groupBy(F.col("doc_id").alias("row_key"))
    times = taken.agg(F.max(F.expr("taken div size")).cast("int").alias("times"))
    repeated = rows.join(times, "row_key").withColumn("nth", F.explode(F.sequence(F.lit(1), "times")))
    return repeated.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
