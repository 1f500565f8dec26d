"""Laws: fusion, increments, clocks, ranges, imports, retention, permutation."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kronika.functions import clocks, coordinates, kinds, payloads
from kronika.operators import evidence, importing, lineage, maintenance, projection, sessions, visibility
from kronika.sources import journal as source

SF = "/root/testdata/sf0.001"
few = settings(max_examples=8, deadline=None)


@pytest.fixture(scope="module")
def journal(spark):
    rows = source.events_journal(spark, SF).cache()
    yield rows
    rows.unpersist()


def number():
    return F.get_json_object("payload", "$.k").cast("long")


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_fused_equals_separate(journal):
    fused = projection.project_fused(journal, ((0x1001,), {"a": F.count_if}), ((0x2001, 0x2002), {"b": F.count_if}))
    a = projection.project(journal, (0x1001,), a=F.count(F.lit(1)))
    b = projection.project(journal, (0x2001, 0x2002), b=F.count(F.lit(1)))
    both = a.join(b, "entity", "full_outer").na.fill(0)
    assert rows_of(fused) == rows_of(both)
    assert projection.kind_union((1,), ()) == [] and projection.kind_union((2, 1), (2,)) == [1, 2]


@few
@given(cut=st.integers(-1, 1001))
def test_incremental_equals_replay(spark, cut):
    journal = source.events_journal(spark, SF)
    state = {"n": F.count(F.lit(1)), "total": F.sum(number()), "mark": F.max("global_sequence")}
    parts = [projection.project(journal.where(c), **state) for c in (F.col("global_sequence") <= cut, F.col("global_sequence") > cut)]
    assert rows_of(projection.merge_sums(*parts, ("n", "total"), ("mark",))) == rows_of(projection.project(journal, **state))


def test_ordered_fold(spark):
    rows = spark.createDataFrame([("a", 2, 5), ("a", 1, -9), ("b", 3, 4)], "entity string, global_sequence long, n long")
    step = lambda s, r: {"floor": max(0, s["floor"] + r.n)}
    got = projection.fold_in_order(rows.withColumn("kind", F.lit(1)), "entity string, floor long", step, lambda: {"floor": 0})
    assert rows_of(got) == [("a", 5), ("b", 4)]


def test_clock_lattice(spark):
    points = [(1, 5), (9, 2), (3, 5), (0, 0)]
    df = spark.createDataFrame([(*a, *b, *c) for a in points for b in points for c in points], "a1 long, a2 long, b1 long, b2 long, c1 long, c2 long")
    a, b, c = (F.struct(F.col(x + "1").alias("wall_ms"), F.col(x + "2").alias("sequence")) for x in "abc")
    for op in (clocks.later, clocks.earlier):
        laws = [op(a, b) == op(b, a), op(op(a, b), c) == op(a, op(b, c)), op(a, a) == a]
        assert df.select(*(F.min(law) for law in laws)).first()[:] == (True, True, True)


@few
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=12), st.randoms())
def test_range_union(spark, ranges, rnd):
    spans = [(a, a + n) for a, n in ranges]
    shuffled = list(spans)
    rnd.shuffle(shuffled)
    schema = "start long, end long"
    once = visibility.merged_ranges(spark.createDataFrame(shuffled, schema))
    covered = {x for a, b in spans for x in range(a, b)}
    got = [(r.start, r.end) for r in once.collect()]
    assert {x for a, b in got for x in range(a, b)} == covered
    assert len(got) == sum(x - 1 not in covered for x in covered)
    assert rows_of(visibility.merged_ranges(once)) == rows_of(once)


def test_ranges_by_bucket_equal_broadcast(spark, journal, monkeypatch):
    ranges = spark.range(40).select((F.col("id") * 23).alias("start"), (F.col("id") * 23 + F.col("id") % 9).alias("end"))
    few_ranges = rows_of(visibility.outside(journal.select("global_sequence"), ranges))
    monkeypatch.setattr(visibility, "BROADCAST_RANGES", 3)
    monkeypatch.setattr(visibility, "BUCKET", 7)
    assert rows_of(visibility.outside(journal.select("global_sequence"), ranges)) == few_ranges
    spans = spark.createDataFrame([(0, 30), (29, 31), (5, 5), (90, 200)], "lo long, hi long")
    got = {(r.lo, r.start, r.shared_from, r.shared_to) for r in visibility.overlaps(spans, ranges).collect()}
    brute = {
        (lo, s, max(lo, s), min(hi, e))
        for lo, hi in ((0, 30), (29, 31), (90, 200))
        for s, e in ((i * 23, i * 23 + i % 9) for i in range(40))
        if max(lo, s) < min(hi, e)
    }
    assert got == brute


def test_importing_twice_adds_nothing(spark, journal):
    yes, no = F.lit(True), F.lit(False)
    first = importing.classified(journal, journal.limit(0), 500, yes, no)
    added = importing.imported(first, 0)
    again = importing.import_report(importing.classified(journal, added, 500, yes, no)).first()
    assert again.imported == 0 and again.deduplicated == added.count() == 501
    sequences = sorted(r.new_sequence for r in added.select("new_sequence").collect())
    assert sequences == list(range(501))


def test_retention_splits_the_journal(journal):
    cut = maintenance.with_segment(journal, 100)
    keep = F.col("kind") != 0x1001
    kept = maintenance.retain(cut, keep, 9)
    dropped = cut.where(~keep & (F.col("segment") < 9))
    assert rows_of(kept.unionByName(dropped).select("global_sequence")) == rows_of(cut.select("global_sequence"))
    assert maintenance.tombstone(cut, keep, 9).count() == cut.count()


def test_reports_do_not_depend_on_input_order(spark):
    rng = random.Random(1)
    ops = [(1, i, 0, rng.randint(0, 5), rng.randint(0, 6), rng.randint(0, 3), rng.random() < 0.8) for i in range(200)]
    schema = "schema_version int, sequence long, ordinal int, reservation_id int, op int, units int, has_subject boolean"
    want = None
    for _ in range(2):
        rng.shuffle(ops)
        got = tuple(rows_of(x) for x in evidence.ledger(spark.createDataFrame(ops, schema)))
        assert want in (None, got)
        want = got


def test_ledger_as_a_state_machine(spark):
    """The window form against a walk through each reservation's operations."""
    rng = random.Random(2)
    ops = [(rng.choice([1, 1, 1, 2]), i, 0, rng.randint(0, 9), rng.randint(0, 5), rng.randint(0, 2), rng.random() < 0.8) for i in range(400)]
    state, entries, findings = {}, {}, set()
    for version, seq, _, rid, op, units, subject in ops:
        now = state.get(rid)
        if version != 1:
            findings.add((rid, seq, "unsupported_version"))
        elif op > 4:
            findings.add((rid, seq, "reason_9"))
        elif now is None and op == 0 and subject and units:
            state[rid], entries[rid] = 0, [0, units, seq]
        elif now == 0 and 1 <= op <= 4:
            state[rid] = entries[rid][0] = op
        else:
            if now is None:
                reason = (8, 2, 3, 5, 6)[op]
            else:
                reason = {0: 7, 1: 1 if now == 1 else 9, 2: 4 if now == 1 else 3, 3: 5, 4: 6}[op]
            findings.add((rid, seq, f"reason_{reason}"))
    schema = "schema_version int, sequence long, ordinal int, reservation_id int, op int, units int, has_subject boolean"
    rng.shuffle(ops)
    got_entries, got_findings = evidence.ledger(spark.createDataFrame(ops, schema))
    assert {r.reservation_id: [r.state, r.units, r.opened_at] for r in got_entries.collect()} == entries
    assert {(r.reservation_id, r.sequence, r.finding) for r in got_findings.collect()} == findings


def test_append_continues_chains(spark, tmp_path):
    schema = "ordinal long, entity string, scope string, kind int, wall_ms long, dag_lane int, payload string"
    path = str(tmp_path / "journal")
    source.append(None, spark.createDataFrame([(0, "a", "s", 4097, 50, 0, "x"), (1, "b", "s", 4097, 60, 0, "y")], schema), path)
    source.append(source.open_journal(spark, path), spark.createDataFrame([(0, "a", "s", 4097, 40, 0, "z"), (1, "a", "s", 4097, 70, 1, "z")], schema), path)
    got = {r.global_sequence: r for r in source.open_journal(spark, path).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[2].clock, got[2].prev_hash, got[2].wall_ms) == (1, got[0].event_hash, 50)
    assert (got[3].clock, got[3].prev_hash) == (0, source.ZERO_HASH)


def test_ancestors_stop_at_cycles(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (1, 3)], "global_sequence long, parent long")
    anchors = spark.createDataFrame([(3,)], "global_sequence long")
    got = lineage.ancestors(edges, anchors, 10).orderBy("depth").collect()
    assert [(r.depth, r.global_sequence) for r in got] == [(0, 3), (1, 2), (2, 1)]


def test_gaps(spark):
    seen = spark.createDataFrame([(0,), (1,), (5,), (6,), (200,)], "global_sequence long")
    ranges = spark.createDataFrame([(2, 5), (100, 120), (150, 160), (300, 400)], "start long, end long")
    want = [(2, 5, 2, 5), (7, 200, 100, 120), (7, 200, 150, 160)]
    for width in (1 << 16, 3):
        found = sessions.gaps(seen, ranges, width)
        assert sorted(tuple(r) for r in found.select("expected", "delivered", "shared_from", "shared_to").collect()) == want


def test_long_chains_are_no_cycles(spark):
    """Chains longer than any fixed number of rounds end; what leads into a cycle does not."""
    n = (1 << 16) + 100
    rows = spark.range(n + 3).selectExpr("id as row_id", f"case when id < {n} then nullif(id + 1, {n}) when id = {n + 2} then {n} else id + 1 end as supersedes", "0 as lifecycle")
    assert {r.row_id for r in evidence.supersession(rows).collect()} == {n, n + 1, n + 2}
    declared = spark.range(14).selectExpr("id as op", "0 as phase")
    needs = declared.where("op > 0").selectExpr("op", "case when op = 11 then 13 else op - 1 end as needs")
    got = {r.op: r.level for r in evidence.canonical_order(declared, needs).collect()}
    assert got == {i: i if i < 11 else None for i in range(14)}


def test_supersession(spark):
    rows = [(1, 2, 0), (2, 1, 0), (3, 4, 0), (4, None, 9), (5, 99, 1), (6, 6, 2), (7, 1, 0)]
    got = evidence.supersession(spark.createDataFrame(rows, "row_id long, supersedes long, lifecycle int")).collect()
    assert {(r.row_id, r.finding) for r in got if r.finding != "cycle"} == {(5, "dangling_supersedes"), (4, "unknown_lifecycle")}
    assert {r.row_id for r in got if r.finding == "cycle"} >= {1, 2, 6}


def test_kinds_and_upcasts():
    assert kinds.pack(2, 5) == 0x2005
    for bad in ((0, 1), (13, 1), (16, 1), (1, 0x1000)):
        with pytest.raises(ValueError):
            kinds.pack(*bad)
    steps = payloads.Upcasts().add(1, 1, lambda c: c)
    assert len(steps.chain(1, 1, 2)) == 1 and steps.chain(1, 0, 3) == []
    for wrong in (lambda: steps.chain(1, 3, 2), lambda: steps.chain(1, 1, 3), lambda: steps.add(1, 1, lambda c: c)):
        with pytest.raises(ValueError):
            wrong()


def test_coordinates(spark):
    parts = ["a", "", None, "é" * 513, "x\x00", "x\n", "a/b", "..", "a|b", "a=b", "x" * 1024]
    want = [None, "entity_empty", "entity_empty", "entity_too_long", "entity_nul", "entity_control", "entity_path", "entity_path", "entity_separator", "entity_separator", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p string")
    got = df.select("i", coordinates.coordinate_problem(F.col("p"), F.lit("s")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want
