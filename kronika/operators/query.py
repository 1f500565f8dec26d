"""Scans, filters, order and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.region import Region

#: Order of one entity's stream, which is not commit order.
STREAM_ORDER = ("wall_ms", "clock", "event_id")


def region(journal: DataFrame, where: Region) -> DataFrame:
    return journal.where(where.predicate())


def page(journal: DataFrame, where: Region, after: int | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in commit order strictly after ``after``; None starts before sequence 0."""
    rows = region(journal, where)
    if after is not None:
        rows = rows.where(F.col("global_sequence") > after)
    return rows.orderBy("global_sequence").limit(limit)


def newest(journal: DataFrame, where: Region, limit: int) -> DataFrame:
    """The last ``limit`` rows of a region: every task holds ``limit`` rows, no more, and only those are merged."""
    return region(journal, where).orderBy(F.col("global_sequence").desc()).limit(limit)


def newest_by(journal: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The last ``limit`` rows of every key; tasks drop the others before the shuffle."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("global_sequence").desc()))
    return journal.withColumn("nth", nth).where(F.col("nth") <= limit)


def payloads(journal: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` (``nth, event_id``) with the payload of each event, in one scan; null where there is none."""
    return plan.join(journal.select("event_id", "payload"), "event_id", "left").select("nth", "event_id", "payload")


def metadata(journal: DataFrame) -> DataFrame:
    return journal.drop("payload")


def stream(journal: DataFrame, entity: str, lane: int | None = None) -> DataFrame:
    """Rows of exactly this entity in stream order."""
    rows = journal.where(F.col("entity") == entity)
    return (rows if lane is None else rows.where(F.col("dag_lane") == lane)).orderBy(*STREAM_ORDER)


def at_coordinate(journal: DataFrame, entity: str, scope: str) -> DataFrame:
    """Exact entity and scope, not the namespace below the entity."""
    return journal.where((F.col("entity") == entity) & (F.col("scope") == scope))


def point(journal: DataFrame, event_id: str) -> DataFrame:
    return journal.where(F.col("event_id") == event_id)


def latest(journal: DataFrame, *columns: str) -> DataFrame:
    """The head of every (entity, lane) by sequence: one aggregation, no sort."""
    picked = F.max_by(F.struct("global_sequence", *columns), "global_sequence").alias("head")
    return journal.groupBy("entity", "dag_lane").agg(picked).select("entity", "dag_lane", "head.*")


def causal_flags(journal: DataFrame) -> DataFrame:
    return journal.withColumns(
        {
            "is_correlated": F.col("correlation_id") != F.col("event_id"),
            "is_root_cause": F.col("causation_id").isNull(),
        }
    )


def pipeline(rows: DataFrame, *steps) -> DataFrame:
    """Filters first, then maps (a null result is skipped), then a limit in commit order.

    Steps are ("filter", Column), ("map", name, Column) and ("take", n).
    """
    for step in (s for s in steps if s[0] == "filter"):
        rows = rows.where(step[1])
    for step in (s for s in steps if s[0] == "map"):
        rows = rows.withColumn(step[1], step[2]).where(F.col(step[1]).isNotNull())
    for step in (s for s in steps if s[0] == "take"):
        rows = rows.orderBy("global_sequence").limit(step[1])
    return rows


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A fold that gives its state after every row, per entity in commit order."""
    upto = W.partitionBy("entity").orderBy("global_sequence").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(upto))


def gate_columns(*gates: tuple[str, Column]) -> dict[str, Column]:
    """First denial, all denials and the trace of ordered gates (a gate that is not true denies)."""
    denied = [(name, ~F.coalesce(ok, F.lit(False))) for name, ok in gates]
    first = F.coalesce(*(F.when(d, F.lit(name)) for name, d in denied))
    trace, so_far = [], F.lit(False)
    for name, d in denied:
        state = F.when(so_far, "skipped").when(d, "deny").otherwise("permit")
        trace.append(F.concat(F.lit(name + "="), state))
        so_far = so_far | d
    return {
        "first_denial": first,
        "denials": F.concat_ws(",", *(F.when(d, F.lit(name)) for name, d in denied)),
        "trace": F.concat_ws(",", *trace),
    }


def checked_effects(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The first undeclared target: ``observed_x`` less ``declared_x`` over ``fields`` in order."""
    extra = lambda f: F.array_sort(F.array_except(f"observed_{f}", f"declared_{f}"))
    violation = F.coalesce(*(F.when(F.size(extra(f)) > 0, F.concat(F.lit(f + ":"), F.element_at(extra(f), 1))) for f in fields))
    return rows.withColumn("violation", violation)


def effect_problem(cls: Column, reads: Column, writes: Column, emits: Column, controls: Column) -> Column:
    """What an operation's class forbids it, or null."""
    return (
        F.when((cls == "inspect") & (writes | emits | controls), "inspect_must_only_read")
        .when((cls == "compute") & (reads | writes | emits | controls), "compute_must_be_pure")
        .when((cls == "persist") & ~writes, "persist_must_write")
        .when((cls == "emit") & ~emits, "emit_must_emit")
        .when((cls == "control") & ~controls, "control_must_control")
    )
