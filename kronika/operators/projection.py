"""Typed folds over one entity's events, fused and incremental; statistics and frontiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevant(journal: DataFrame, kinds: Iterable[int]) -> DataFrame:
    """Rows of these kinds; no kinds means all."""
    kinds = sorted(set(kinds))
    return journal.where(F.col("kind").isin(kinds)) if kinds else journal


def kind_union(*sets: Iterable[int]) -> list[int]:
    """Kinds that fused folds read together; any empty set asks for all."""
    found = [set(s) for s in sets]
    return [] if any(not s for s in found) else sorted(set().union(*found))


def folds(number: Column, kind: int) -> dict[str, Column]:
    """A family of folds as aggregates over ``kind`` and ``global_sequence``."""
    own = F.col("kind") == kind
    return {
        "count_all": F.count(F.lit(1)),
        "count_kind": F.count_if(own),
        "sum_kind": F.coalesce(F.sum(F.when(own, number)), F.lit(0)),
        "last_index": F.max(F.when(own, F.col("global_sequence"))),
        "xor_kind": F.coalesce(F.bit_xor(F.when(own, number)), F.lit(0)),
    }


def project(journal: DataFrame, kinds: Iterable[int] = (), **aggregates: Column) -> DataFrame:
    """An algebraic fold for every entity: one aggregation, combined before the shuffle."""
    return relevant(journal, kinds).groupBy("entity").agg(*(c.alias(n) for n, c in aggregates.items()))


def project_fused(journal: DataFrame, *parts: tuple[Iterable[int], dict[str, Callable[[Column], Column]]]) -> DataFrame:
    """Several folds in one scan: each part has its kinds and, by name, a function from a filter to an aggregate."""
    named = []
    for kinds, makers in parts:
        kinds = sorted(set(kinds))
        mine = F.col("kind").isin(kinds) if kinds else F.lit(True)
        named += [make(mine).alias(name) for name, make in makers.items()]
    return relevant(journal, kind_union(*(k for k, _ in parts))).groupBy("entity").agg(*named)


def fold_in_order(journal: DataFrame, schema: str, step: Callable, start: Callable, kinds: Iterable[int] = ()) -> DataFrame:
    """A fold that is no aggregate: ``step(state, row)`` over each entity's rows in commit order.

    A group is one entity; its rows come to one worker.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state = start()
        for row in rows.sort_values("global_sequence").itertuples(index=False):
            state = step(state, row)
        return pd.DataFrame([{"entity": rows["entity"].iloc[0], **state}])

    return relevant(journal, kinds).groupBy("entity").applyInPandas(run, schema)


def merge_sums(saved: DataFrame, delta: DataFrame, sums: tuple[str, ...], latest: tuple[str, ...] = ()) -> DataFrame:
    """Saved state plus the state of newer rows, by entity."""
    both = saved.unionByName(delta)
    return both.groupBy("entity").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in latest))


def generation(journal: DataFrame) -> DataFrame:
    """Rows of every entity, visible or not."""
    return journal.groupBy("entity").agg(F.count(F.lit(1)).alias("generation"))


def strategy(relevant_rows: int, cached: bool, current: bool, incremental: bool, external: bool) -> str:
    """How a projection is to be had."""
    if not relevant_rows:
        return "empty"
    if cached:
        return "group_local_hit" if current else "group_local_incremental" if incremental else "direct_replay"
    return "external_cache_then_replay" if external else "direct_replay"


def fresh(cache: DataFrame, watermarks: DataFrame, max_age_ms: int | None, now_ms: int) -> DataFrame:
    """Cache rows that may be used: at the entity's watermark, or young enough if staleness is allowed."""
    joined = cache.join(watermarks, "entity")
    ok = F.col("watermark") == F.col("cached_watermark")
    if max_age_ms is not None:
        ok = ok | (F.lit(now_ms) - F.col("cached_ms") < max_age_ms)
    return joined.withColumn("usable", ok)


def state_contract(size: Column, extent: str, most: int | None = None) -> Column:
    """What a projection's declared extent says about a state of ``size``."""
    if extent == "bounded":
        return F.when(size <= most, "ok").otherwise("exceeds_bound")
    return F.lit({"unbounded": "ok"}.get(extent, "unspecified"))


def stats(journal: DataFrame) -> DataFrame:
    return journal.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.max("global_sequence").alias("global_sequence"),
        F.count_distinct("entity").alias("entities"),
        F.count_distinct("dag_lane").alias("lanes"),
    )


def lane_frontier(journal: DataFrame, durable: int) -> DataFrame:
    """Each lane's written point, and its durable one: what is written, if all of it is durable."""
    heads = journal.groupBy("dag_lane").agg(
        F.max_by(F.struct("wall_ms", "global_sequence"), "global_sequence").alias("written"),
        F.max(F.when(F.col("global_sequence") <= durable, F.col("global_sequence"))).alias("durable_below"),
    )
    covered = F.col("written.global_sequence") <= durable
    return heads.select(
        "dag_lane",
        F.col("written.wall_ms").alias("written_ms"),
        F.col("written.global_sequence").alias("written_sequence"),
        F.when(covered, F.col("written.global_sequence")).otherwise(F.col("durable_below")).alias("durable_sequence"),
        covered.alias("covered"),
    )


def applied_frontier(progress: DataFrame) -> DataFrame:
    """The least over projections of the furthest that each has come."""
    furthest = progress.groupBy("projection").agg(F.max("sequence").alias("sequence"))
    return furthest.agg(F.min("sequence").alias("applied"), F.count(F.lit(1)).alias("projections"))


def axes(journal: DataFrame) -> DataFrame:
    """Counts by entity, scope, kind and category in one pass."""
    rows = journal.select("entity", "scope", "kind", F.shiftright("kind", 12).alias("category"))
    return rows.groupingSets(
        [[rows.entity], [rows.scope], [rows.kind], [rows.category], []], rows.entity, rows.scope, rows.kind, rows.category
    ).agg(F.count(F.lit(1)).alias("events"))


def lag(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """What subscribers have yet to consume, never below zero, with findings."""
    joined = produced.join(consumed, "entity", "left")
    behind = F.greatest(F.lit(0), F.col("available") - F.coalesce("consumed", F.lit(0)))
    finding = (
        F.when(F.col("consumed").isNull(), "never_polled")
        .when(F.col("consumed") > F.col("available"), "ahead_of_source")
        .when(behind > 0, "lagging")
        .otherwise("current")
    )
    return joined.select("entity", "available", "consumed", behind.alias("lag"), finding.alias("finding"))
