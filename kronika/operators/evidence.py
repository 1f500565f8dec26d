"""Evidence reports and decisions: deterministic tables of findings."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.coordinates import all_of, first_of
from ..sources.tables import materialize


def drift(expected: DataFrame, observed: DataFrame, key: str, digest: str, labels=("missing", "extra", "mismatch")) -> DataFrame:
    """Full outer join on ``key``: rows that one side lacks, or whose digests differ."""
    one = expected.select(key, F.col(digest).alias("expected"), F.lit(True).alias("in_expected"))
    two = observed.select(key, F.col(digest).alias("observed"), F.lit(True).alias("in_observed"))
    finding = (
        F.when(F.col("in_observed").isNull(), labels[0])
        .when(F.col("in_expected").isNull(), labels[1])
        .when(~F.col("expected").eqNullSafe(F.col("observed")), labels[2])
    )
    return one.join(two, key, "full_outer").select(key, finding.alias("finding")).where("finding is not null")


def id_audit(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Ids that occur more than once: ``duplicate`` with one digest, ``inconsistent`` with several."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(digest).alias("digests"))
    return counts.where("copies > 1").withColumn("finding", F.when(F.col("digests") > 1, "inconsistent").otherwise("duplicate"))


def ledger(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reservations from ``schema_version, sequence, ordinal, reservation_id, op, units, has_subject``.

    ``op``: 0 reserve, 1 commit, 2 refund, 3 expire, 4 orphan.  Per id in order of (sequence, ordinal) the first valid reserve opens, the
    first of the others after it closes.  Returns entries (``reservation_id, state, units, opened_at``) and findings
    (``reservation_id, sequence, ordinal, finding``).
    """
    order = W.partitionBy("reservation_id").orderBy("sequence", "ordinal")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("reservation_id")
    known = ops.where("schema_version = 1")
    opens = (F.col("op") == 0) & F.col("has_subject") & (F.col("units") > 0)
    opened = F.coalesce(F.max(opens).over(before), F.lit(False))
    rows = known.withColumns({"opened": opened, "opens": opens & ~opened})
    closes = F.col("opened") & F.col("op").between(1, 4)
    closed_by = F.first(F.when(F.col("closes"), F.col("op")), ignorenulls=True)
    rows = rows.withColumn("closes", closes).withColumn("closed_before", closed_by.over(before))
    rows = rows.withColumn("closing", F.col("closes") & F.col("closed_before").isNull())
    entries = (
        rows.where("opens or closing")
        .groupBy("reservation_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("closing"), F.col("op"))), F.lit(0)).alias("state"),
            F.max(F.when(F.col("opens"), F.col("units"))).alias("units"),
            F.max(F.when(F.col("opens"), F.col("sequence"))).alias("opened_at"),
        )
    )
    state = F.when(F.col("opened"), F.coalesce("closed_before", F.lit(0)))
    op = F.col("op")
    unopened = F.element_at(F.array(*map(F.lit, (8, 2, 3, 5, 6))), op + 1)
    reason = (
        F.when((op > 4) | (op < 0), 9)
        .when(state.isNull(), F.when((op >= 0) & (op <= 4), unopened))
        .when(op == 0, 7)
        .when(op == 1, F.when(state == 1, 1).otherwise(9))
        .when(op == 2, F.when(state == 1, 4).otherwise(3))
        .when(op == 3, 5)
        .otherwise(6)
    )
    bad = rows.where("not opens and not closing").select(
        "reservation_id", "sequence", "ordinal", F.concat(F.lit("reason_"), reason.cast("string")).alias("finding")
    )
    foreign = ops.where("schema_version <> 1").select(
        "reservation_id", "sequence", "ordinal", F.lit("unsupported_version").alias("finding")
    )
    return entries, bad.unionByName(foreign)


def reconciliation(entries: DataFrame) -> DataFrame:
    """Ids in order, by state.  Lists are as long as the ledger's states are full; use ``entries`` where that is too much."""
    return entries.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("reservation_id")), ",").alias("ids"))


def operation_status(facts: DataFrame) -> DataFrame:
    """Counters and the last terminal of each operation, from ``operation, sequence, lifecycle, code``.

    A denial without an open attempt counts as an attempt of its own.
    """
    before = W.partitionBy("operation").orderBy("sequence").rowsBetween(W.unboundedPreceding, -1)
    is_ = {s: (F.col("lifecycle") == s).cast("int") for s in ("started", "completed", "failed", "denied")}
    ends = is_["completed"] + is_["failed"] + is_["denied"]
    open_ = F.coalesce(F.sum(is_["started"] - ends).over(before), F.lit(0))
    rows = facts.withColumn("lone_denial", (F.col("lifecycle") == "denied") & (open_ <= 0))
    terminal = F.when(ends == 1, F.col("sequence"))
    return rows.groupBy("operation").agg(
        (F.sum(is_["started"]) + F.count_if("lone_denial")).alias("attempts_seen"),
        *(F.sum(is_[s]).alias(s) for s in ("completed", "failed", "denied")),
        F.max_by("lifecycle", terminal).alias("last_terminal"),
        F.max_by("code", terminal).alias("last_code"),
    )


#: Later ones lose; ok is what is left.
PRIORITY = ("err", "cancelled", "retry", "pending", "batch", "ok")


def join_all(outcomes: DataFrame) -> DataFrame:
    """The weightiest outcome of each group, the first of equals (``grp, position, status``)."""
    weight = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status"))
    return outcomes.groupBy("grp").agg(F.min_by(F.struct("status", "position"), F.struct(weight, "position")).alias("x")).select("grp", "x.*")


def join_any(outcomes: DataFrame) -> DataFrame:
    """The first outcome that is no error decides; else the last error."""
    rank = F.when(F.col("status") != "err", F.struct(F.lit(0).alias("a"), F.col("position").cast("long").alias("b"))).otherwise(
        F.struct(F.lit(1).alias("a"), (-F.col("position")).cast("long").alias("b"))
    )
    return outcomes.groupBy("grp").agg(F.min_by(F.struct("status", "position"), rank).alias("x")).select("grp", "x.*")


def transitions(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings on state transitions: version, order of causes, and whether the edge is allowed.

    ``edges`` (``prev, next``) is a machine's table; a left join keeps every transition.
    """
    allowed = edges.select(F.col("prev"), F.col("next"), F.lit(True).alias("allowed")).distinct()
    joined = rows.join(allowed, ["prev", "next"], "left")
    found = all_of(
        ("unsupported_version", F.col("schema_version") != 1),
        ("unsorted_causes", F.array_sort("causes") != F.col("causes")),
        ("invalid_edge", F.col("allowed").isNull()),
    )
    return joined.select("transition_id", F.array_join(found, ",").alias("findings"))


def supersession(rows: DataFrame) -> DataFrame:
    """``row_id, finding`` over ``row_id, supersedes, lifecycle``: dangling targets, cycles and lifecycles out of range.

    Every row has at most one outgoing edge; pointers double each round, and rows whose chain ends drop out.  A longer chain would
    hold rows of every lesser length, so once a round loses none all that are left never end.  ``cycle`` is reported of rows on a
    cycle and of rows that lead into one.  Each round is written and read again.
    """
    ids = rows.select(F.col("row_id").alias("target"), F.lit(True).alias("known"))
    linked = rows.where("supersedes is not null").join(ids, F.col("supersedes") == F.col("target"), "left")
    dangling = linked.where("known is null").select("row_id", F.lit("dangling_supersedes").alias("finding"))
    lifecycle = rows.where("lifecycle not between 0 and 3").select("row_id", F.lit("unknown_lifecycle").alias("finding"))
    jump = materialize(linked.where("known").select("row_id", F.col("supersedes").alias("to")))
    before, left = None, jump.count()
    while left and left != before:
        hop = jump.select(F.col("row_id").alias("to"), F.col("to").alias("further"))
        jump = materialize(jump.join(hop, "to").select("row_id", F.col("further").alias("to")))
        before, left = left, jump.count()
    cycles = jump.select("row_id", F.lit("cycle").alias("finding"))
    return dangling.unionByName(lifecycle).unionByName(cycles)


def receipts(claims: DataFrame, index: DataFrame) -> DataFrame:
    """First failing check of each receipt: missing, sequence, content hash, signature verdict."""
    entry = index.select("event_id", F.col("global_sequence").alias("i_seq"), F.col("event_hash").alias("i_hash"))
    verdict = first_of(
        ("missing", F.col("i_seq").isNull()),
        ("sequence_mismatch", F.col("global_sequence") != F.col("i_seq")),
        ("content_hash_mismatch", F.col("event_hash") != F.col("i_hash")),
        ("signature_invalid", ~F.col("signature_ok")),
    )
    return claims.join(entry, "event_id", "left").select("event_id", F.coalesce(verdict, F.lit("valid")).alias("verdict"))


def collisions(rows: DataFrame, keys: tuple[str, ...], value: str, order: str) -> DataFrame:
    """Keys with more than one distinct ``value``, and the first owner by ``order``."""
    counts = rows.groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.min_by(value, order).alias("first_owner"))
    return counts.where("values > 1")


def mount_problems(rows: DataFrame) -> DataFrame:
    """Names claimed twice on an axis (``axis, name, ref, mount``): with one ref a duplicate, else a conflict."""
    counts = rows.groupBy("axis", "name").agg(
        F.count(F.lit(1)).alias("claims"), F.count_distinct("ref").alias("refs"), F.min_by("ref", "mount").alias("owner")
    )
    return counts.where("claims > 1").select("axis", "name", "owner", F.when(F.col("refs") > 1, "conflict").otherwise("duplicate").alias("finding"))


def health(requested: DataFrame, mounted: DataFrame) -> DataFrame:
    known = mounted.select("name", F.lit(True).alias("there")).distinct()
    return requested.join(known, "name", "left").select("name", F.when(F.col("there"), "mounted").otherwise("missing").alias("state"))


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings on schema snapshots with one stable key, in a fixed order; none means unchanged."""
    b = after.select("stable_key", *(F.col(c).alias("n_" + c) for c in ("name", "version", "layout", "body_hash")))
    joined = before.join(b, "stable_key")
    found = all_of(*((f"{c}_mismatch", ~F.col(c).eqNullSafe(F.col("n_" + c))) for c in ("name", "version", "layout", "body_hash")))
    return joined.select("stable_key", F.array_join(found, ",").alias("findings"), F.when(F.size(found) == 0, "unchanged").otherwise("unknown").alias("state"))


def lanes(value: Column, width: int, count: int) -> list[Column]:
    """``count`` fields of ``width`` bits."""
    mask = (1 << width) - 1
    return [F.shiftright(value, width * i).bitwiseAND(mask) for i in range(count)]


def admission(profile_ok: Column, supported: Column, evidence_ok: Column, budget_problem: Column, conflict: Column, scheduled: Column) -> Column:
    """Six membranes in order; the first that fails decides."""
    return F.coalesce(
        F.when(~profile_ok, "profile_drift"),
        F.when(~supported, "support"),
        F.when(~evidence_ok, "evidence"),
        F.when(budget_problem.isNotNull(), F.concat(F.lit("budget:"), budget_problem)),
        F.when(conflict, "conflict"),
        F.when(~scheduled, "schedule"),
        F.lit("admitted"),
    )


def budget_by_dimension(dims: Column) -> Column:
    """First problem, dimension by dimension (structs with limit, available, least, guaranteed)."""
    problem = lambda d, i: F.when(
        d["limit"] < d["least"], F.concat(i.cast("string"), F.lit(":limit_below_minimum"))
    ).when(d["available"] < d["least"], F.concat(i.cast("string"), F.lit(":capacity"))).when(
        ~d["guaranteed"], F.concat(i.cast("string"), F.lit(":guarantee"))
    )
    return F.element_at(F.concat(F.array_compact(F.transform(dims, problem)), F.array(F.lit(None).cast("string"))), 1)


def budget_by_phase(rows: DataFrame) -> DataFrame:
    """First problem by phase, then dimension: all limits are judged before any capacity (``request, dim, limit, available, least, guaranteed``)."""
    code = (
        F.when(F.col("limit") < F.col("least"), F.struct(F.lit(1).alias("phase"), F.col("dim"), F.lit("limit_below_minimum").alias("reason")))
        .when(F.col("available") < F.col("least"), F.struct(F.lit(2).alias("phase"), F.col("dim"), F.lit("capacity").alias("reason")))
        .when(~F.col("guaranteed"), F.struct(F.lit(2).alias("phase"), F.col("dim"), F.lit("guarantee").alias("reason")))
    )
    return rows.withColumn("code", code).groupBy("request").agg(F.min("code").alias("first")).select("request", "first.phase", "first.dim", "first.reason")


def schedule_problems(declared: DataFrame, scheduled: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """First failing check of each plan: duplicate, undeclared, missing prerequisite, order, phase, coverage.

    ``declared``: plan, op, phase; ``scheduled``: plan, position, op; ``prerequisites``: plan, op, needs.
    """
    at = scheduled.groupBy("plan", "op").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("times"))
    known = declared.select("plan", "op", "phase")
    placed = at.join(known, ["plan", "op"], "left")
    duplicate = at.where("times > 1").select("plan", F.lit(1).alias("rank"), F.lit("duplicate").alias("problem"))
    undeclared = placed.where("phase is null").select("plan", F.lit(2).alias("rank"), F.lit("undeclared").alias("problem"))
    need = prerequisites.join(at.select("plan", "op", F.col("position").alias("own")), ["plan", "op"]).join(
        at.select("plan", F.col("op").alias("needs"), F.col("position").alias("other")), ["plan", "needs"], "left"
    )
    closure = need.where("other is null").select("plan", F.lit(3).alias("rank"), F.lit("missing_prerequisite").alias("problem"))
    order = need.where("other >= own").select("plan", F.lit(4).alias("rank"), F.lit("order").alias("problem"))
    walk = W.partitionBy("plan").orderBy("position", "op")
    phase = placed.withColumn("last_phase", F.lag("phase").over(walk)).where("last_phase > phase").select("plan", F.lit(5).alias("rank"), F.lit("phase").alias("problem"))
    coverage = known.join(at, ["plan", "op"], "left_anti").select("plan", F.lit(6).alias("rank"), F.lit("coverage").alias("problem"))
    every = [duplicate, undeclared, closure, order, phase, coverage]
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)
    first = found.groupBy("plan").agg(F.min_by("problem", "rank").alias("problem"))
    return declared.select("plan").distinct().join(first, "plan", "left").select("plan", F.coalesce("problem", F.lit("admitted")).alias("verdict"))


def recovery(events: DataFrame, probes: DataFrame) -> DataFrame:
    """What to do about each attempt, from its lifecycle events (``attempt, step``) and a probe (``attempt, alive``)."""
    steps = events.groupBy("attempt").agg(*(F.max(F.col("step") == s).alias(s) for s in ("prepared", "started", "completed", "disposed")))
    joined = steps.join(probes, "attempt", "left")
    verdict = (
        F.when(F.col("disposed") & ~F.col("completed"), "refuse")
        .when(F.col("disposed"), "completed")
        .when(F.col("completed"), "finish_disposition")
        .when(F.col("started") & ~F.col("prepared"), "refuse")
        .when(F.col("started"), "roll_back")
        .when(F.coalesce("alive", F.lit(False)), "roll_back")
        .otherwise("absent")
    )
    return joined.select("attempt", verdict.alias("verdict"))


def checkout(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Status facts of each call (``call, operation, guard_ok, handler, succeeds``): a denial, or a start and its end."""
    known = catalog.select("operation", F.lit(True).alias("known")).distinct()
    joined = calls.join(known, "operation", "left")
    end = F.when(~F.col("handler"), "failed:missing_handler").when(F.col("succeeds"), "completed").otherwise("failed:handler")
    facts = (
        F.when(F.col("known").isNull(), F.array(F.lit("denied:unknown_operation")))
        .when(~F.col("guard_ok"), F.array(F.lit("denied:guard")))
        .otherwise(F.array(F.lit("started"), end))
    )
    return joined.select("call", "operation", F.posexplode(facts).alias("step", "fact"))


def read_walk(rows: DataFrame, limit: int) -> DataFrame:
    """Counts of a region read: matched, returned, dropped, and how far it got."""
    first = rows.select("global_sequence").orderBy("global_sequence").limit(limit)
    got = first.agg(F.count(F.lit(1)).alias("returned"), F.max("global_sequence").alias("last_returned"))
    return rows.agg(F.count(F.lit(1)).alias("matched"), F.max("global_sequence").alias("last_matched")).join(F.broadcast(got)).select(
        "matched", "returned", (F.col("matched") - F.col("returned")).alias("dropped"), "last_returned", "last_matched"
    )


def canonical_order(declared: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """Levels of a dependency order: each round places operations all of whose needs are placed, until a round places none.

    ``level`` is null for what is left: operations on a cycle, and those that need one of them or one that is not declared.
    ``declared``: op, phase; ``prerequisites``: op, needs.
    """
    placed = declared.join(prerequisites, "op", "left_anti").select("op", F.lit(0).alias("level"))
    for level in itertools.count(1):
        placed = materialize(placed)
        waiting = declared.join(placed, "op", "left_anti")
        blocked = prerequisites.join(placed.select(F.col("op").alias("needs")), "needs", "left_anti").select("op").distinct()
        ready = materialize(waiting.join(blocked, "op", "left_anti").select("op", F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        placed = placed.unionByName(ready)
    return declared.join(placed, "op", "left").select("op", "phase", "level")


def finding_order(variants: tuple[str, ...], *fields: str) -> list[Column]:
    """Findings by variant as listed, unknown ones last, then by their fields with nulls first."""
    place = F.array_position(F.array(*map(F.lit, variants)), F.col("finding"))
    return [F.when(place > 0, place).otherwise(len(variants) + 1), "finding", *(F.col(f).asc_nulls_first() for f in fields)]


def numbered_findings(findings: DataFrame, report: str, variants: tuple[str, ...], *fields: str) -> DataFrame:
    """``findings`` with ``nth``: their place in the report (a column) that they belong to."""
    return findings.withColumn("nth", F.row_number().over(W.partitionBy(report).orderBy(*finding_order(variants, *fields))))
