"""Parents, ancestors, causation and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import materialize


def chain_parents(journal: DataFrame) -> DataFrame:
    """Parent by evidence: of the same entity's earlier rows with the wanted hash the one with the largest sequence.

    Wanted and own hashes are rows of one table, so that a window over (entity, hash) finds the last one before: one shuffle, and equal
    payloads do not multiply.  Also counts the matches.
    """
    wanted = journal.select("global_sequence", "entity", F.col("prev_hash").alias("hash"), F.lit(False).alias("is_parent"))
    own = journal.select("global_sequence", "entity", F.col("event_hash").alias("hash"), F.lit(True).alias("is_parent"))
    before = W.partitionBy("entity", "hash").orderBy("global_sequence", "is_parent").rowsBetween(W.unboundedPreceding, -1)
    met = wanted.unionByName(own).where("hash is not null").withColumns(
        {
            "parent": F.max(F.when(F.col("is_parent"), F.col("global_sequence"))).over(before),
            "matches": F.count(F.when(F.col("is_parent"), 1)).over(before),
        }
    )
    return met.where("not is_parent and matches > 0").select("global_sequence", "parent", "matches")


def stream_parents(journal: DataFrame) -> DataFrame:
    """Parent by ancestry: the first row in stream order with the wanted hash, earlier or not.

    One row for each (entity, hash) is kept before the join, so that it cannot multiply.
    """
    order = F.struct("wall_ms", "clock", "event_id")
    first = journal.groupBy(F.col("entity").alias("p_entity"), F.col("event_hash").alias("p_hash")).agg(
        F.min_by("global_sequence", order).alias("parent")
    )
    child = journal.select("global_sequence", "entity", "prev_hash")
    return child.join(first, (F.col("entity") == F.col("p_entity")) & (F.col("prev_hash") == F.col("p_hash"))).select(
        "global_sequence", "parent"
    )


def ancestors(edges: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """``anchor, depth, global_sequence``: up to ``limit`` rows from each anchor (depth 0) upwards.

    Edges are ``global_sequence, parent``, at most one for each row.  Walks double: with the ancestor ``n`` steps up of every row, walks of
    ``n`` rows become walks of ``2 * n``, so that a limit takes as many rounds as it has bits; each is a table.  A walk stops
    at a row without parent or one that it has met.
    """
    walk = anchors.select(F.col("global_sequence").alias("anchor"), F.lit(0).alias("depth"), "global_sequence")
    jump = edges.select(F.col("global_sequence").alias("row"), F.col("parent").alias("far")).where("far is not null")
    width = 1
    while width < limit:
        jump = materialize(jump, "jumps")
        depth = F.col("depth") + width
        met = walk.join(jump, F.col("global_sequence") == F.col("row")).where(depth < limit)
        walk = materialize(walk.unionByName(met.select("anchor", depth.alias("depth"), F.col("far").alias("global_sequence"))), "walks")
        onward = jump.select(F.col("row").alias("far"), F.col("far").alias("further"))
        jump = jump.join(onward, "far").select("row", F.col("further").alias("far"))
        width *= 2
    first = walk.groupBy("anchor", "global_sequence").agg(F.min("depth").alias("depth"))  # a walk round a cycle only repeats itself
    return first.select("anchor", "depth", "global_sequence")


def causes(journal: DataFrame) -> DataFrame:
    """Every caused row with its cause."""
    cause = journal.select(
        F.col("event_id").alias("causation_id"), F.col("global_sequence").alias("cause_sequence"), F.col("kind").alias("cause_kind")
    )
    return journal.join(cause, "causation_id")


def correlation_groups(journal: DataFrame) -> DataFrame:
    return journal.groupBy("correlation_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("global_sequence").alias("first_sequence"),
        F.max("global_sequence").alias("last_sequence"),
    )


def upgraded(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with their entries; a hit without one is dropped."""
    return hits.join(entries, "event_id")


def chain_problems(journal: DataFrame) -> DataFrame:
    """Rows whose hash or previous hash is not what payload and order say."""
    chain = W.partitionBy("entity", "dag_lane").orderBy("global_sequence")
    want = F.coalesce(F.lag("event_hash").over(chain), F.lit("0" * 64))
    return journal.select(
        "global_sequence",
        (F.sha2("payload", 256) == F.col("event_hash")).alias("hash_ok"),
        (want == F.col("prev_hash")).alias("prev_ok"),
    )


def chain_walk(journal: DataFrame, start: int, limit: int, end: int | None = None) -> DataFrame:
    """Evidence of a walk from ``start`` by evidence parents: one row for each step with its finding, if any.

    Only the start's entity is read.  Findings are ``entry_hash_mismatch``, ``parent_hash_ambiguous``, ``missing_parent_link`` (a row that is
    not a chain's start finds no parent), and at the last row ``truncated_by_limit`` or ``end_not_reached`` when nothing else was found.
    """
    own = journal.where(F.col("global_sequence") == start).select(F.col("entity").alias("own_entity"))
    rows = journal.join(F.broadcast(own.limit(1)), F.col("entity") == F.col("own_entity")).drop("own_entity")
    parents = chain_parents(rows)
    walk = ancestors(parents.select("global_sequence", "parent"), rows.where(F.col("global_sequence") == start), limit)
    facts = rows.select("global_sequence", "prev_hash", (F.sha2("payload", 256) == F.col("event_hash")).alias("hash_ok"))
    steps = walk.join(facts, "global_sequence").join(parents, "global_sequence", "left")
    genesis = F.col("prev_hash") == "0" * 64
    found = (
        F.when(~F.col("hash_ok"), "entry_hash_mismatch")
        .when(~genesis & F.col("parent").isNull(), "missing_parent_link")
        .when(F.col("matches") > 1, "parent_hash_ambiguous")
    )
    whole = W.partitionBy("anchor")
    last = F.col("depth") == F.max("depth").over(whole)
    clean = F.max(found.isNotNull()).over(whole) == F.lit(False)
    at_end = F.col("parent").isNotNull()
    closing = F.when(last & clean & at_end & (F.col("depth") == limit - 1), "truncated_by_limit")
    if end is not None:
        reached = F.max(F.col("global_sequence") == end).over(whole)
        closing = F.coalesce(closing, F.when(last & clean & ~reached, "end_not_reached"))
    return steps.withColumn("finding", F.coalesce(found, closing)).select(
        "depth", "global_sequence", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), "finding"
    )
