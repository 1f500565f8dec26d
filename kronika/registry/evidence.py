"""Evidence reports, ledgers, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, lineage, projection, query
from ..plans.region import Region
from ..sources.journal import events_journal as journal
from .base import Registry, sql
from .scans import PARENTS

R = Registry()


def orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet")


def lineitem(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet")


@R.add("d6_registry_drift", "SELECT coalesce(d.doc_id, l.doc_id) AS row_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'mismatch' END AS finding FROM (SELECT doc_id, (doc_id % 2)::INTEGER AS h FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR d.h IS DISTINCT FROM l.quality")
def d6(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 2).cast("int").alias("h"))
    labels = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("h"))
    return evidence.drift(docs, labels, "row_id", "h")


@R.add("d7_restore_proof", "SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, CASE WHEN b.segment_id IS NULL THEN 'missing' WHEN a.segment_id IS NULL THEN 'unexpected' ELSE 'digest_mismatch' END AS finding FROM (SELECT l_orderkey // 64 AS segment_id, sum(l_linenumber) AS t FROM lineitem WHERE l_orderkey % 640 < 576 GROUP BY 1) a FULL JOIN (SELECT l_orderkey // 64 AS segment_id, sum(l_linenumber) AS t FROM lineitem WHERE l_orderkey % 640 >= 64 AND l_orderkey % 97 <> 0 GROUP BY 1) b ON a.segment_id = b.segment_id WHERE a.segment_id IS NULL OR b.segment_id IS NULL OR a.t IS DISTINCT FROM b.t")
def d7(s, d):
    rows = lineitem(s, d).select("l_orderkey", F.expr("l_orderkey div 64").alias("segment_id"), "l_linenumber")
    digest = F.sum("l_linenumber").alias("digest")
    expected = rows.where("l_orderkey % 640 < 576").groupBy("segment_id").agg(digest)
    observed = rows.where("l_orderkey % 640 >= 64 and l_orderkey % 97 <> 0").groupBy("segment_id").agg(digest)
    return evidence.drift(expected, observed, "segment_id", "digest", ("missing", "unexpected", "digest_mismatch"))


@R.add("k8_manifest_audit", "SELECT segment_id, count(*) AS copies, count(DISTINCT digest) AS digests, CASE WHEN count(DISTINCT digest) > 1 THEN 'inconsistent' ELSE 'duplicate' END AS finding FROM (SELECT o_custkey AS segment_id, o_orderstatus AS digest FROM orders) GROUP BY 1 HAVING count(*) > 1")
def k8(s, d):
    rows = orders(s, d).select(F.col("o_custkey").alias("segment_id"), F.col("o_orderstatus").alias("digest"))
    return evidence.id_audit(rows, "segment_id", "digest")


@R.add("d10_receipts", sql("SELECT event_id, CASE WHEN global_sequence % 29 = 0 THEN 'missing' WHEN global_sequence % 23 = 0 THEN 'sequence_mismatch' WHEN global_sequence % 19 = 0 THEN 'content_hash_mismatch' WHEN global_sequence % 17 = 0 THEN 'signature_invalid' ELSE 'valid' END AS verdict FROM j"))
def d10(s, d):
    rows, seq = journal(s, d).select("event_id", "global_sequence", "event_hash"), F.col("global_sequence")
    claims = rows.select(
        "event_id",
        F.when(seq % 23 == 0, seq + 1).otherwise(seq).alias("global_sequence"),
        F.when(seq % 19 == 0, F.lit("0")).otherwise(F.col("event_hash")).alias("event_hash"),
        (seq % 17 != 0).alias("signature_ok"),
    )
    return evidence.receipts(claims, rows.where(seq % 29 != 0))


@R.add("d11_forbidden_edges", "SELECT l_orderkey, l_linenumber, l_returnflag AS prev, l_linestatus AS next FROM lineitem WHERE NOT ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O'))")
def d11(s, d):
    rows = lineitem(s, d).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("prev"), F.col("l_linestatus").alias("next"))
    allowed = s.createDataFrame([("A", "F"), ("N", "O")], "prev string, next string")
    return rows.join(F.broadcast(allowed), ["prev", "next"], "left_anti").select("l_orderkey", "l_linenumber", "prev", "next")


@R.add("k10_transitions", "SELECT l_orderkey * 10 + l_linenumber AS transition_id, concat_ws(',', CASE WHEN l_orderkey % 40 = 0 THEN 'unsupported_version' END, CASE WHEN l_orderkey % 6 > l_linenumber THEN 'unsorted_causes' END, CASE WHEN NOT ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O')) THEN 'invalid_edge' END) AS findings FROM lineitem")
def k10(s, d):
    rows = lineitem(s, d).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transition_id"),
        F.when(F.col("l_orderkey") % 40 == 0, 2).otherwise(1).alias("schema_version"),
        F.array(F.col("l_orderkey") % 6, F.col("l_linenumber").cast("long")).alias("causes"),
        F.col("l_returnflag").alias("prev"),
        F.col("l_linestatus").alias("next"),
    )
    return evidence.transitions(rows, s.createDataFrame([("A", "F"), ("N", "O")], "prev string, next string"))


@R.add(
    "d12_supersession",
    """WITH RECURSIVE r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 50 = 4 THEN o_orderkey + 1 WHEN o_orderkey % 7 = 0 THEN o_orderkey + 100000000 END AS to_id, o_orderkey % 6 AS life FROM orders),
c AS (SELECT a.id FROM r a JOIN r b ON a.to_id = b.id AND b.to_id = a.id)
SELECT id AS row_id, 'dangling_supersedes' AS finding FROM r WHERE to_id IS NOT NULL AND to_id NOT IN (SELECT id FROM r)
UNION ALL SELECT id, 'unknown_lifecycle' FROM r WHERE life > 3 UNION ALL SELECT id, 'cycle' FROM c""",
)
def d12(s, d):
    key = F.col("o_orderkey")
    to = F.when(key % 5 == 0, key - 1).when(key % 50 == 4, key + 1).when(key % 7 == 0, key + 100000000)
    rows = orders(s, d).select(key.alias("row_id"), to.alias("supersedes"), (key % 6).alias("lifecycle"))
    return evidence.supersession(rows)


@R.add("d13_collisions", "SELECT p_brand, count(DISTINCT p_type) AS values, arg_min(p_type, p_partkey) AS first_owner FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def d13(s, d):
    return evidence.collisions(s.read.parquet(f"{d}/part.parquet"), ("p_brand",), "p_type", "p_partkey")


LEDGER = """
WITH o AS (SELECT o_orderkey % 400 AS id, o_orderkey AS seq, (o_orderkey // 400) % 6 AS op, o_orderkey % 4 AS units, o_orderkey % 7 <> 0 AS subj, CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END AS v FROM orders),
k AS (SELECT *, op = 0 AND subj AND units > 0 AS can FROM o WHERE v = 1),
p AS (SELECT *, coalesce(max(can::INT) OVER w, 0) = 1 AS opened FROM k WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, can AND NOT opened AS opens, min(CASE WHEN opened AND op BETWEEN 1 AND 4 THEN seq END) OVER (PARTITION BY id) AS close_seq,
             arg_min(op, CASE WHEN opened AND op BETWEEN 1 AND 4 THEN seq END) OVER (PARTITION BY id) AS close_op FROM p),
z AS (SELECT *, CASE WHEN opened THEN CASE WHEN close_seq < seq THEN close_op ELSE 0 END END AS b FROM q)
"""


def _ledger(s, d):
    key = F.col("o_orderkey")
    rows = orders(s, d).select(
        F.when(key % 50 == 0, 2).otherwise(1).alias("schema_version"), key.alias("sequence"), F.lit(0).alias("ordinal"), (key % 400).alias("reservation_id"),
        (F.expr("o_orderkey div 400") % 6).cast("int").alias("op"), (key % 4).alias("units"), (key % 7 != 0).alias("has_subject"),
    )
    return evidence.ledger(rows)


@R.add("e13_ledger_entries", LEDGER + "SELECT id AS reservation_id, coalesce(max(close_op), 0)::INTEGER AS state, max(units) FILTER (opens) AS units, max(seq) FILTER (opens) AS opened_at FROM z GROUP BY id HAVING count(*) FILTER (opens) > 0")
def e13(s, d):
    return _ledger(s, d)[0]


@R.add(
    "e13_ledger_findings",
    LEDGER
    + """SELECT id AS reservation_id, seq AS sequence, 0 AS ordinal, 'reason_' || CASE WHEN op > 4 THEN 9
  WHEN b IS NULL THEN [8, 2, 3, 5, 6][op + 1] WHEN op = 0 THEN 7 WHEN op = 1 THEN CASE WHEN b = 1 THEN 1 ELSE 9 END
  WHEN op = 2 THEN CASE WHEN b = 1 THEN 4 ELSE 3 END WHEN op = 3 THEN 5 ELSE 6 END AS finding
FROM z WHERE NOT opens AND seq IS DISTINCT FROM close_seq UNION ALL SELECT id, seq, 0, 'unsupported_version' FROM o WHERE v <> 1""",
)
def e13_findings(s, d):
    return _ledger(s, d)[1]


@R.add("e14_reconciliation", LEDGER + "SELECT state, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id, coalesce(max(close_op), 0)::INTEGER AS state FROM z GROUP BY id HAVING count(*) FILTER (opens) > 0) GROUP BY 1")
def e14(s, d):
    return evidence.reconciliation(_ledger(s, d)[0])


STATUS = """
f AS (SELECT global_sequence % 40 AS operation, global_sequence AS sequence, CASE kind WHEN 4097 THEN 'started' WHEN 4098 THEN 'completed' WHEN 8193 THEN 'failed' ELSE 'denied' END AS lifecycle, flags AS code FROM j WHERE kind <> 61441),
h AS (SELECT *, lifecycle = 'denied' AND coalesce(sum(CASE WHEN lifecycle = 'started' THEN 1 ELSE -1 END) OVER (PARTITION BY operation ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0 AS lone FROM f)
"""


@R.add("e12_operation_status", sql("SELECT operation, count(*) FILTER (lifecycle = 'started') + count(*) FILTER (lone) AS attempts_seen, count(*) FILTER (lifecycle = 'completed') AS completed, count(*) FILTER (lifecycle = 'failed') AS failed, count(*) FILTER (lifecycle = 'denied') AS denied, arg_max(lifecycle, sequence) FILTER (lifecycle <> 'started') AS last_terminal, arg_max(code, sequence) FILTER (lifecycle <> 'started') AS last_code FROM h GROUP BY 1", STATUS))
def e12(s, d):
    kind = F.col("kind")
    lifecycle = F.when(kind == 0x1001, "started").when(kind == 0x1002, "completed").when(kind == 0x2001, "failed").otherwise("denied")
    facts = journal(s, d).where(kind != 0xF001).select(
        (F.col("global_sequence") % 40).alias("operation"), F.col("global_sequence").alias("sequence"), lifecycle.alias("lifecycle"), F.col("flags").alias("code")
    )
    return evidence.operation_status(facts)


OUTCOMES = "o AS (SELECT global_sequence // 3 AS grp, global_sequence % 3 AS position, CASE kind WHEN 4097 THEN 'ok' WHEN 4098 THEN 'err' WHEN 8193 THEN 'retry' WHEN 8194 THEN 'pending' ELSE 'cancelled' END AS status FROM j)"


def _outcomes(s, d):
    kind, seq = F.col("kind"), F.col("global_sequence")
    status = F.when(kind == 0x1001, "ok").when(kind == 0x1002, "err").when(kind == 0x2001, "retry").when(kind == 0x2002, "pending").otherwise("cancelled")
    return journal(s, d).select(F.expr("global_sequence div 3").alias("grp"), (seq % 3).alias("position"), status.alias("status"))


@R.add("e19_join_all", sql("SELECT grp, arg_min(status, (w, position)) AS status, arg_min(position, (w, position)) AS position FROM (SELECT *, list_position(['err', 'cancelled', 'retry', 'pending', 'batch', 'ok'], status) AS w FROM o) GROUP BY 1", OUTCOMES))
def e19_all(s, d):
    return evidence.join_all(_outcomes(s, d))


@R.add("e19_join_any", sql("SELECT grp, arg_min(status, r) AS status, arg_min(position, r) AS position FROM (SELECT *, CASE WHEN status <> 'err' THEN position ELSE 100 - position END AS r FROM o) GROUP BY 1", OUTCOMES))
def e19_any(s, d):
    return evidence.join_any(_outcomes(s, d))


@R.add("e20_log_digest", sql("SELECT entity, sha256(string_agg(finding, '|' ORDER BY global_sequence)) AS digest FROM (SELECT entity, global_sequence, CASE WHEN matches > 1 THEN 'ambiguous' ELSE 'single' END AS finding FROM j JOIN chain USING (global_sequence)) GROUP BY 1", PARENTS))
def e20(s, d):
    from ..functions.payloads import digest_of

    rows = journal(s, d)
    found = lineage.chain_parents(rows).join(rows.select("global_sequence", "entity"), "global_sequence")
    return found.groupBy("entity").agg(digest_of(F.when(F.col("matches") > 1, "ambiguous").otherwise("single"), F.col("global_sequence")).alias("digest"))


@R.add(
    "k1_chain_walk",
    sql(
        """SELECT depth, seq AS global_sequence, coalesce(chain.matches, 0) AS matches,
  CASE WHEN chain.parent IS NULL AND j.prev_hash <> repeat('0', 64) THEN 'missing_parent_link' WHEN chain.matches > 1 THEN 'parent_hash_ambiguous'
       WHEN depth = max(depth) OVER () AND depth = 7 AND chain.parent IS NOT NULL AND max(CASE WHEN chain.matches > 1 OR (chain.parent IS NULL AND j.prev_hash <> repeat('0', 64)) THEN 1 ELSE 0 END) OVER () = 0 THEN 'truncated_by_limit' END AS finding
FROM walk JOIN j ON j.global_sequence = walk.seq LEFT JOIN chain ON chain.global_sequence = walk.seq""",
        PARENTS,
        "walk(seq, depth) AS (SELECT 900, 0 UNION ALL SELECT chain.parent, depth + 1 FROM walk JOIN chain ON chain.global_sequence = walk.seq WHERE depth < 7)",
    ),
)
def k1(s, d):
    return lineage.chain_walk(journal(s, d), 900, 8)


@R.add("k2_read_walk", sql("SELECT count(*) AS matched, least(count(*), 30) AS returned, count(*) - least(count(*), 30) AS dropped, (SELECT max(g) FROM (SELECT global_sequence AS g FROM j WHERE kind >> 12 = 1 ORDER BY 1 LIMIT 30)) AS last_returned, max(global_sequence) AS last_matched FROM j WHERE kind >> 12 = 1"))
def k2(s, d):
    return evidence.read_walk(query.region(journal(s, d), Region(category=1)), 30)


@R.add("k4_resources", sql("SELECT (SELECT count(*) FROM j) AS event_count, dag_lane, max(global_sequence) AS written_sequence, max(global_sequence) <= 800 AS covered FROM j GROUP BY dag_lane"))
def k4(s, d):
    rows = journal(s, d)
    lanes = projection.lane_frontier(rows, 800).select("dag_lane", "written_sequence", "covered")
    return lanes.join(F.broadcast(projection.stats(rows).select("event_count")))


@R.add("k9_schema_changes", "SELECT stable_key, concat_ws(',', CASE WHEN v THEN 'version_mismatch' END, CASE WHEN l THEN 'layout_mismatch' END, CASE WHEN h THEN 'body_hash_mismatch' END) AS findings, CASE WHEN v OR l OR h THEN 'unknown' ELSE 'unchanged' END AS state FROM (SELECT p_partkey AS stable_key, p_partkey % 5 = 0 AS v, p_partkey % 7 = 0 AS l, p_partkey % 11 = 0 AS h FROM part)")
def k9(s, d):
    key = F.col("p_partkey")
    part = s.read.parquet(f"{d}/part.parquet")
    before = part.select(key.alias("stable_key"), F.col("p_name").alias("name"), F.lit(1).alias("version"), F.lit(1).alias("layout"), F.col("p_type").alias("body_hash"))
    after = before.select(
        "stable_key", "name", F.when(F.col("stable_key") % 5 == 0, 2).otherwise(1).alias("version"), F.when(F.col("stable_key") % 7 == 0, 2).otherwise(1).alias("layout"),
        F.when(F.col("stable_key") % 11 == 0, F.lit("changed")).otherwise(F.col("body_hash")).alias("body_hash"),
    )
    return evidence.schema_changes(before, after)


@R.add(
    "k13_admission",
    """SELECT o_orderkey AS request, CASE WHEN p & 15 <> (p >> 4) & 15 THEN 'profile_drift' WHEN p % 5 = 0 THEN 'support' WHEN p % 9 = 1 THEN 'evidence'
  WHEN a < 3 THEN 'budget:0:limit_below_minimum' WHEN b < 2 THEN 'budget:0:capacity' WHEN p % 4 = 3 THEN 'budget:1:guarantee' WHEN p % 6 = 2 THEN 'conflict' WHEN p % 8 = 4 THEN 'schedule' ELSE 'admitted' END AS verdict
FROM (SELECT o_orderkey, (o_orderkey * 17) & 255 AS p, o_orderkey % 10 + (CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END) AS a, o_orderkey % 12 AS b FROM (SELECT o_orderkey FROM orders WHERE true))""".replace("(o_orderkey * 17) & 255", "(o_orderkey * (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 17 END)) & 255").replace("b < 2", "b < 3"),
)
def k13(s, d):
    key = F.col("o_orderkey")
    p = (key * F.when(key % 3 == 0, 1).otherwise(17)).bitwiseAND(255)
    planned, live = evidence.lanes(p, 4, 2)
    dim = lambda limit, available, ok: F.struct(limit.cast("long").alias("limit"), available.cast("long").alias("available"), F.lit(3).cast("long").alias("least"), ok.alias("guaranteed"))
    dims = F.array(dim(key % 10 + F.when(key % 2 == 0, 3).otherwise(0), key % 12, F.lit(True)), dim(F.lit(9), F.lit(9), p % 4 != 3))
    verdict = evidence.admission(planned == live, p % 5 != 0, p % 9 != 1, evidence.budget_by_dimension(dims), p % 6 == 2, p % 8 != 4)
    return orders(s, d).select(key.alias("request"), verdict.alias("verdict"))


@R.add("k14_budget_phases", "SELECT request, c.phase AS phase, c.dim AS dim, c.reason AS reason FROM (SELECT l_orderkey AS request, min(CASE WHEN l_quantity < 5 THEN {'phase': 1, 'dim': l_linenumber, 'reason': 'limit_below_minimum'} WHEN l_discount < 0.02 THEN {'phase': 2, 'dim': l_linenumber, 'reason': 'capacity'} WHEN l_returnflag = 'R' THEN {'phase': 2, 'dim': l_linenumber, 'reason': 'guarantee'} END) AS c FROM lineitem GROUP BY 1)")
def k14(s, d):
    rows = lineitem(s, d).select(
        F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("dim"), F.col("l_quantity").alias("limit"),
        F.when(F.col("l_discount") < 0.02, 0).otherwise(100).alias("available"), F.lit(5).alias("least"), (F.col("l_returnflag") != "R").alias("guaranteed"),
    )
    return evidence.budget_by_phase(rows)


PLANS = """
WITH s0 AS (SELECT l_orderkey AS plan, l_linenumber AS position, l_partkey % 6 AS op, l_orderkey FROM lineitem),
de AS (SELECT DISTINCT plan, op, op // 3 AS phase FROM s0 WHERE op <> 5 UNION SELECT plan, 2, 0 FROM s0 WHERE plan % 3 = 0),
pr AS (SELECT plan, op, op - 1 AS needs FROM de WHERE op IN (1, 4)),
pl AS (SELECT plan, op, min(position) AS position, count(*) AS times FROM s0 GROUP BY 1, 2),
x AS (
  SELECT plan, 1 AS rank, 'duplicate' AS problem FROM pl WHERE times > 1
  UNION ALL SELECT pl.plan, 2, 'undeclared' FROM pl LEFT JOIN de USING (plan, op) WHERE de.phase IS NULL
  UNION ALL SELECT pr.plan, CASE WHEN b.position IS NULL THEN 3 ELSE 4 END, CASE WHEN b.position IS NULL THEN 'missing_prerequisite' ELSE 'order' END
    FROM pr JOIN pl a ON a.plan = pr.plan AND a.op = pr.op LEFT JOIN pl b ON b.plan = pr.plan AND b.op = pr.needs WHERE b.position IS NULL OR b.position >= a.position
  UNION ALL SELECT plan, 5, 'phase' FROM (SELECT pl.plan, phase, lag(phase) OVER (PARTITION BY pl.plan ORDER BY position, op) AS l FROM pl LEFT JOIN de USING (plan, op)) WHERE l > phase
  UNION ALL SELECT de.plan, 6, 'coverage' FROM de ANTI JOIN pl USING (plan, op))
SELECT de.plan, coalesce(arg_min(x.problem, x.rank), 'admitted') AS verdict FROM (SELECT DISTINCT plan FROM de) de LEFT JOIN x USING (plan) GROUP BY 1
"""


def schedules(lines, every):
    """Verdicts on one plan for each order of ``lines``; every so many declare an operation more."""
    rows = lines.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("position"), (F.col("l_partkey") % 6).alias("op"))
    own = rows.where("op <> 5").select("plan", "op", F.expr("op div 3").alias("phase"))
    extra = rows.where(F.col("plan") % every == 0).select("plan", F.lit(2).cast("long").alias("op"), F.lit(0).cast("long").alias("phase"))
    declared = own.unionByName(extra).distinct()
    needs = declared.where("op in (1, 4)").select("plan", "op", (F.col("op") - 1).alias("needs"))
    return evidence.schedule_problems(declared, rows, needs)


@R.add("k15_schedules", PLANS)
def k15(s, d):
    return schedules(lineitem(s, d), 3)


#: Parts in groups of eight, each in need of the one before; of every fifth group that is whole, the first needs the last.
LEVELS = """
WITH p AS (SELECT p_partkey AS op, p_size AS phase, p_partkey // 8 AS g FROM part),
s AS (SELECT g, min(op) AS first, max(op) AS last FROM p GROUP BY 1)
SELECT op, phase, CASE WHEN g % 5 <> 0 OR last - first < 7 THEN (op - first)::INTEGER END AS level FROM p JOIN s USING (g)
"""


@R.add("k16_schedule_levels", LEVELS)
def k16(s, d):
    declared = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("op"), F.col("p_size").alias("phase"))
    key = F.col("op")
    ring = (key % 8 == 0) & (F.expr("op div 8") % 5 == 0)
    needs = declared.select("op", F.when(key % 8 != 0, key - 1).when(ring, key + 7).alias("needs")).where("needs is not null")
    known = declared.select(key.alias("needs"))
    return evidence.canonical_order(declared, needs.join(known, "needs", "left_semi").select("op", "needs"))


def recoveries(some):
    """Verdicts on one attempt for each customer of ``some`` orders."""
    key = F.col("o_orderkey")
    steps = F.array_compact(F.array(F.when(key % 5 == 0, "prepared"), F.when(key % 7 == 1, "started"), F.when(key % 11 == 2, "completed"), F.when(key % 13 == 3, "disposed"), F.lit("seen")))
    events = some.select(F.col("o_custkey").alias("attempt"), F.explode(steps).alias("step"))
    probes = events.select("attempt").distinct().withColumn("alive", F.col("attempt") % 3 == 0)
    return evidence.recovery(events, probes)


RECOVERIES = """
SELECT o_custkey AS attempt, CASE WHEN d AND NOT c THEN 'refuse' WHEN d THEN 'completed' WHEN c THEN 'finish_disposition'
  WHEN s AND NOT p THEN 'refuse' WHEN s THEN 'roll_back' WHEN o_custkey % 3 = 0 THEN 'roll_back' ELSE 'absent' END AS verdict
FROM (SELECT o_custkey, bool_or(o_orderkey % 5 = 0) AS p, bool_or(o_orderkey % 7 = 1) AS s, bool_or(o_orderkey % 11 = 2) AS c,
        bool_or(o_orderkey % 13 = 3) AS d FROM orders GROUP BY 1)
"""


@R.add("k17_recovery", RECOVERIES)
def k17(s, d):
    return recoveries(orders(s, d))


@R.add("k18_budget_witness", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 30 THEN 'within' ELSE 'exceeded' END AS verdict FROM lineitem")
def k18(s, d):
    verdict = F.when(F.col("l_quantity") <= 30, "within").otherwise("exceeded")
    return lineitem(s, d).select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@R.add("k19_manifest_digest", "SELECT n_regionkey, sha256(string_agg(n_name, '|' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def k19(s, d):
    from ..functions.payloads import digest_of

    return s.read.parquet(f"{d}/nation.parquet").groupBy("n_regionkey").agg(digest_of(F.col("n_name"), F.col("n_nationkey")).alias("digest"))


@R.add("k22_kind_collisions", sql("SELECT kind, count(DISTINCT role) AS values, arg_min(role, (ordinal)) AS first_owner FROM (SELECT CASE role WHEN 'user' THEN 1 ELSE 2 END AS kind, role, conv_id * 1000 + turn AS ordinal FROM conversations) GROUP BY 1 HAVING count(DISTINCT role) > 1"))
def k22(s, d):
    rows = s.read.parquet(f"{d}/conversations.parquet").select(
        F.when(F.col("role") == "user", 1).otherwise(2).alias("kind"), "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal")
    )
    return evidence.collisions(rows, ("kind",), "role", "ordinal")


@R.add("k23_mount_problems", "SELECT axis, name, arg_min(ref, mount) AS owner, CASE WHEN count(DISTINCT ref) > 1 THEN 'conflict' ELSE 'duplicate' END AS finding FROM (SELECT p_brand AS axis, p_size AS name, p_type AS ref, p_partkey AS mount FROM part) GROUP BY 1, 2 HAVING count(*) > 1")
def k23(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("axis"), F.col("p_size").alias("name"), F.col("p_type").alias("ref"), F.col("p_partkey").alias("mount"))
    return evidence.mount_problems(rows)


@R.add("k24_interface_fingerprint", "SELECT p_brand, sha256(string_agg(p_type || ':' || p_size, '|' ORDER BY p_partkey)) AS fingerprint FROM part GROUP BY 1")
def k24(s, d):
    from ..functions.payloads import digest_of

    line = F.concat_ws(":", "p_type", "p_size")
    return s.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(digest_of(line, F.col("p_partkey")).alias("fingerprint"))


@R.add("k25_health", "SELECT c.c_name AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'mounted' ELSE 'missing' END AS state FROM customer c")
def k25(s, d):
    customers = s.read.parquet(f"{d}/customer.parquet")
    active = customers.join(orders(s, d), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_name").alias("name"))
    return evidence.health(customers.select(F.col("c_name").alias("name")), active)


@R.add(
    "k26_checkout",
    """WITH c AS (SELECT o_orderkey AS call, (o_orderkey % 9)::INTEGER AS operation FROM orders)
SELECT call, operation, 0 AS step, CASE WHEN operation = 8 THEN 'denied:unknown_operation' WHEN call % 5 = 0 THEN 'denied:guard' ELSE 'started' END AS fact FROM c
UNION ALL SELECT call, operation, 1, CASE WHEN call % 7 = 0 THEN 'failed:missing_handler' WHEN call % 3 <> 0 THEN 'completed' ELSE 'failed:handler' END FROM c WHERE operation <> 8 AND call % 5 <> 0""",
)
def k26(s, d):
    key = F.col("o_orderkey")
    calls = orders(s, d).select(key.alias("call"), (key % 9).cast("int").alias("operation"), (key % 5 != 0).alias("guard_ok"), (key % 7 != 0).alias("handler"), (key % 3 != 0).alias("succeeds"))
    return evidence.checkout(calls, s.range(8).select(F.col("id").cast("int").alias("operation")))


QUERIES, ORACLES = R.queries, R.oracles
