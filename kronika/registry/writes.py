"""Batches, outboxes, waits and reports on runs, copies and envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import evidence, maintenance, projection, writes
from ..sources.journal import events_journal as journal
from .base import Registry, sql

R = Registry()
ITEMS = "b AS (SELECT global_sequence // 12 AS batch, global_sequence % 12 AS nth, event_id, length(payload) AS bytes, global_sequence % 131 = 0 AS cas, CASE WHEN global_sequence % 5 = 0 THEN global_sequence % 12 - 1 + (CASE WHEN global_sequence % 95 = 0 THEN 3 ELSE 0 END) END AS prior FROM j)"


def items(s, d):
    seq = F.col("global_sequence")
    nth = seq % 12
    prior = F.when(seq % 5 == 0, nth - 1 + F.when(seq % 95 == 0, 3).otherwise(0))
    return journal(s, d).select(
        F.expr("global_sequence div 12").alias("batch"), nth.alias("nth"), "event_id", F.length("payload").alias("bytes"), (seq % 131 == 0).alias("cas"), prior.alias("prior")
    )


@R.add("a6_batch_verdicts", sql("SELECT batch, count(*) AS items, sum(bytes)::BIGINT AS bytes, CASE WHEN count(*) > 12 THEN 'too_many_items' WHEN sum(bytes) > 106 THEN 'too_many_bytes' WHEN bool_or(cas) THEN 'cas_in_batch' WHEN bool_or(coalesce(prior >= nth OR prior < 0, false)) THEN 'bad_prior_item' ELSE 'commit' END AS verdict FROM b GROUP BY 1", ITEMS))
def a6(s, d):
    return writes.batch_verdicts(items(s, d), 12, 106)


@R.add("d4_prior_items", sql("SELECT x.batch, x.nth, x.event_id, y.event_id AS causation_id FROM b x LEFT JOIN b y ON y.batch = x.batch AND y.nth = x.prior", ITEMS))
def d4_prior(s, d):
    return writes.prior_causes(items(s, d))


@R.add("a7_outbox", sql("SELECT entity AS outbox, (row_number() OVER (PARTITION BY entity ORDER BY global_sequence) - 1)::INTEGER AS nth, payload FROM j WHERE kind = 8193"))
def a7(s, d):
    rows = journal(s, d).where(F.col("kind") == 0x2001)
    listed = rows.groupBy(F.col("entity").alias("outbox")).agg(F.array_sort(F.collect_list(F.struct("global_sequence", "payload"))).alias("x"))
    return writes.staged(listed.select("outbox", F.col("x.payload").alias("staged")))


@R.add("i13_covers", sql("SELECT j.global_sequence, j.global_sequence <= f.durable AS durable FROM j JOIN (SELECT dag_lane, max(global_sequence) FILTER (global_sequence <= 800) AS durable FROM j GROUP BY 1) f USING (dag_lane)"))
def i13(s, d):
    rows = journal(s, d).select("global_sequence", "dag_lane", "wall_ms")
    frontier = projection.lane_frontier(rows, 800).select("dag_lane", "durable_sequence")
    return rows.join(frontier, "dag_lane").select("global_sequence", writes.covers(F.col("durable_sequence"), F.col("global_sequence")).alias("durable"))


@R.add("k3_projection_run", sql("SELECT count(*) AS source_rows, max(global_sequence) AS watermark, count(DISTINCT entity) AS output_rows, CASE WHEN max(global_sequence) = 500 THEN 'hit' WHEN max(global_sequence) > 500 THEN 'stale' ELSE 'ahead' END AS cache_status FROM j WHERE kind = 8194"))
def k3(s, d):
    bought = projection.relevant(journal(s, d), (0x2002,))
    state = projection.project(bought, n=F.count(F.lit(1)))
    return writes.projection_run(state, bought, "entity", ("n",), 500).drop("output_hash")


@R.add("k7_copy_report", sql("SELECT CASE WHEN segment % 10 = 3 THEN 'missing' WHEN segment % 10 = 7 THEN 'changed' ELSE 'copied' END AS state, count(*) AS segments FROM (SELECT DISTINCT global_sequence // 50 AS segment FROM j) GROUP BY 1"))
def k7(s, d):
    seg = maintenance.with_segment(journal(s, d), 50).groupBy("segment").agg(F.bit_xor(F.xxhash64("global_sequence", "event_hash")).alias("digest"))
    after = seg.where("segment % 10 <> 3").withColumn("digest", F.when(F.col("segment") % 10 == 7, F.lit(0).cast("long")).otherwise(F.col("digest")))
    return writes.copy_report(seg, after)


@R.add(
    "k12_envelopes",
    """SELECT p_partkey AS artifact, sha256(p_name) AS body_hash, sha256(sha256(p_name) || coalesce(h, '')) AS envelope_hash,
  CASE WHEN p_partkey % 9 = 0 THEN 'body_hash_mismatch' WHEN h IS NULL THEN 'unsigned' WHEN bad > 0 THEN 'invalid_signature' END AS finding
FROM part LEFT JOIN (SELECT l_partkey, sha256(string_agg(s, '|' ORDER BY s)) AS h, count(*) FILTER (s % 40 = 0) AS bad FROM (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem WHERE l_partkey % 4 <> 0) GROUP BY 1) ON l_partkey = p_partkey""",
)
def k12(s, d):
    bodies = s.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("artifact"), F.col("p_name").alias("body"), F.when(F.col("p_partkey") % 9 == 0, "0").otherwise(F.sha2("p_name", 256)).alias("claimed_body_hash")
    )
    lines = s.read.parquet(f"{d}/lineitem.parquet").where("l_partkey % 4 <> 0")
    signed = lines.select(F.col("l_partkey").alias("artifact"), F.col("l_suppkey").alias("signer")).distinct()
    return writes.envelopes(bodies, signed.withColumn("verdict", F.when(F.col("signer") % 40 == 0, "invalid").otherwise("valid")))


MACHINE = """
t AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 9 THEN 'refund' ELSE 'order' END AS machine,
        coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'O') AS from_state, o_orderstatus AS to_state FROM orders)
"""


@R.add(
    "l_apply_transition",
    f"WITH {MACHINE} SELECT o_orderkey, machine, from_state, to_state, CASE WHEN machine = 'refund' THEN 'unknown_machine' WHEN from_state || to_state IN ('OO', 'OF', 'OP', 'PF') THEN 'accepted' ELSE 'forbidden_edge' END AS verdict FROM t",
)
def l_transition(s, d):
    """Every order's change of status, told before it is written whether the machine has that edge."""
    before = F.lag("o_orderstatus").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    new = s.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", F.when(F.col("o_custkey") % 10 == 9, "refund").otherwise("order").alias("machine"), F.coalesce(before, F.lit("O")).alias("from_state"), F.col("o_orderstatus").alias("to_state")
    )
    edges = s.createDataFrame([("order", *e) for e in ("OO", "OF", "OP", "PF")], "machine string, from_state string, to_state string")
    return writes.checked_transitions(new, edges)


@R.add(
    "c8_finding_order",
    "SELECT l_orderkey AS report, l_linenumber AS line, finding, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE finding WHEN 'missing' THEN 1 WHEN 'late' THEN 2 ELSE 3 END, finding, l_suppkey NULLS FIRST, l_linenumber))::INTEGER AS nth "
    "FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'late' WHEN l_returnflag = 'A' THEN 'missing' ELSE 'other' END AS finding FROM lineitem)",
)
def c8(s, d):
    kind = F.when(F.col("l_returnflag") == "R", "late").when(F.col("l_returnflag") == "A", "missing").otherwise("other")
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("line"), "l_suppkey", kind.alias("finding"))
    return evidence.numbered_findings(rows, "report", ("missing", "late"), "l_suppkey", "line").select("report", "line", "finding", "nth")


QUERIES, ORACLES = R.queries, R.oracles
