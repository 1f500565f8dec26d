"""Projections, statistics, frontiers, import, maintenance and cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, importing, maintenance, projection, sessions, visibility
from ..sources.journal import events_journal as journal
from ..sources.journal import talks_journal
from ..sources.tables import new_path as stored
from .base import CANCELLED, Registry, cancelled, sql

R = Registry()


def number():
    return F.get_json_object("payload", "$.k").cast("long")


NUMBER = "json_extract(payload, '$.k')::BIGINT"


@R.add("e1_project", sql(f"SELECT entity, count(*) AS events, sum({NUMBER})::BIGINT AS total, max(global_sequence) AS last_sequence FROM j WHERE kind IN (4097, 8194) GROUP BY 1"))
def e1(s, d):
    return projection.project(journal(s, d), (0x1001, 0x2002), events=F.count(F.lit(1)), total=F.sum(number()), last_sequence=F.max("global_sequence"))


@R.add("e2_relevant_kinds", sql("SELECT global_sequence, kind FROM j WHERE kind IN (8193, 61441)"))
def e2(s, d):
    return projection.relevant(journal(s, d), (0x2001, 0xF001)).select("global_sequence", "kind")


@R.add("e3_fused", sql(f"SELECT entity, count(*) FILTER (kind = 4097) AS views, coalesce(sum({NUMBER}) FILTER (kind IN (8193, 8194)), 0)::BIGINT AS bought FROM j WHERE kind IN (4097, 8193, 8194) GROUP BY 1"))
def e3(s, d):
    views = ((0x1001,), {"views": F.count_if})
    bought = ((0x2001, 0x2002), {"bought": lambda mine: F.coalesce(F.sum(F.when(mine, number())), F.lit(0))})
    return projection.project_fused(journal(s, d), views, bought)


@R.add("e4_incremental", sql(f"SELECT entity, count(*) AS events, sum({NUMBER})::BIGINT AS total, max(global_sequence) AS watermark FROM j GROUP BY 1"))
def e4(s, d):
    """State saved at a watermark, plus the state of what came after."""
    rows = journal(s, d)
    state = {"events": F.count(F.lit(1)), "total": F.sum(number()), "watermark": F.max("global_sequence")}
    saved = projection.project(rows.where(F.col("global_sequence") <= 600), **state)
    delta = projection.project(rows.where(F.col("global_sequence") > 600), **state)
    return projection.merge_sums(saved, delta, ("events", "total"), ("watermark",))


STRATEGY = """
SELECT *, CASE WHEN relevant = 0 THEN 'empty' WHEN cached AND current THEN 'group_local_hit' WHEN cached AND incremental THEN 'group_local_incremental'
  WHEN cached THEN 'direct_replay' WHEN external THEN 'external_cache_then_replay' ELSE 'direct_replay' END AS strategy
FROM (VALUES (0), (5)) r(relevant), (VALUES (true), (false)) c(cached), (VALUES (true), (false)) k(current), (VALUES (true), (false)) i(incremental), (VALUES (true), (false)) x(external)
"""


@R.add("e5_strategy", STRATEGY)
def e5(s, d):
    cases = [(n, c, k, i, x) for n in (0, 5) for c in (True, False) for k in (True, False) for i in (True, False) for x in (True, False)]
    return s.createDataFrame([(*c, projection.strategy(*c)) for c in cases], "relevant int, cached boolean, current boolean, incremental boolean, external boolean, strategy string")


@R.add("e6_freshness", sql("SELECT entity, watermark, watermark = cached OR 1000 - age < 400 AS usable FROM (SELECT entity, max(global_sequence) AS watermark, max(global_sequence) FILTER (global_sequence % 5 <> 0) AS cached, max(global_sequence) % 1000 AS age FROM j GROUP BY 1) WHERE cached IS NOT NULL"))
def e6(s, d):
    rows = journal(s, d)
    cache = rows.groupBy("entity").agg(
        F.max(F.when(F.col("global_sequence") % 5 != 0, F.col("global_sequence"))).alias("cached_watermark"), (F.max("global_sequence") % 1000).alias("cached_ms")
    )
    marks = rows.groupBy("entity").agg(F.max("global_sequence").alias("watermark"))
    return projection.fresh(cache.where("cached_watermark is not null"), marks, 400, 1000).select("entity", "watermark", "usable")


@R.add("e7_if_changed", sql(f"SELECT entity, generation, total FROM (SELECT entity, count(*) AS generation, sum({NUMBER})::BIGINT AS total, count(*) FILTER (global_sequence < 9900) AS seen FROM j GROUP BY 1) WHERE generation <> seen"))
def e7(s, d):
    """Entities whose generation moved since sequence 9900, with the new state."""
    return (
        projection.project(journal(s, d), generation=F.count(F.lit(1)), total=F.sum(number()), seen=F.count_if(F.col("global_sequence") < 9900))
        .where("generation <> seen")
        .drop("seen")
    )


@R.add("e8_generation", sql("SELECT entity, count(*) AS generation FROM j GROUP BY 1"))
def e8(s, d):
    return projection.generation(journal(s, d))


@R.add("e9_replay_watermark", sql("SELECT entity, max(global_sequence) AS watermark FROM j WHERE kind = 4098 GROUP BY 1"))
def e9(s, d):
    return projection.project(journal(s, d), (0x1002,), watermark=F.max("global_sequence"))


@R.add("e10_state_contract", sql("SELECT entity, size, CASE WHEN size <= 60 THEN 'ok' ELSE 'exceeds_bound' END AS bounded, 'unspecified' AS unspecified FROM (SELECT entity, count(*) AS size FROM j GROUP BY 1)"))
def e10(s, d):
    size = F.col("size")
    rows = projection.project(journal(s, d), size=F.count(F.lit(1)))
    return rows.select("entity", "size", projection.state_contract(size, "bounded", 60).alias("bounded"), projection.state_contract(size, "").alias("unspecified"))


@R.add("e11_fold_family", sql(f"SELECT entity, count(*) AS count_all, count(*) FILTER (kind = 8194) AS count_kind, coalesce(sum({NUMBER}) FILTER (kind = 8194), 0)::BIGINT AS sum_kind, max(global_sequence) FILTER (kind = 8194) AS last_index, coalesce(bit_xor({NUMBER}) FILTER (kind = 8194), 0) AS xor_kind FROM j GROUP BY 1"))
def e11(s, d):
    return projection.project(journal(s, d), **projection.folds(number(), 0x2002))


def _balance(state, row):
    """A clamped balance: order matters, so no aggregate gives it."""
    amount = 10 if row.kind == 0x1001 else -15
    return {"balance": max(0, state["balance"] + amount), "floor_hits": state["floor_hits"] + (state["balance"] + amount < 0)}


@R.add(
    "e1_ordered_fold",
    sql(
        "SELECT entity, b - least(0, low) AS balance FROM (SELECT entity, sum(a)::BIGINT AS b, min(run)::BIGINT AS low FROM (SELECT *, sum(a) OVER (PARTITION BY entity ORDER BY global_sequence ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT entity, global_sequence, CASE WHEN kind = 4097 THEN 10 ELSE -15 END AS a FROM j WHERE kind IN (4097, 8194))) GROUP BY 1)"
    ),
)
def e1_fold(s, d):
    rows = journal(s, d).select("entity", "global_sequence", "kind")
    start = lambda: {"balance": 0, "floor_hits": 0}
    return projection.fold_in_order(rows, "entity string, balance long, floor_hits long", _balance, start, (0x1001, 0x2002)).drop("floor_hits")


@R.add("e16_stats", sql("SELECT count(*) AS event_count, max(global_sequence) AS global_sequence, count(DISTINCT entity) AS entities, count(DISTINCT dag_lane) AS lanes FROM j"))
def e16(s, d):
    return projection.stats(journal(s, d))


@R.add("e17_lane_frontier", sql("SELECT dag_lane, arg_max(wall_ms, global_sequence) AS written_ms, max(global_sequence) AS written_sequence, CASE WHEN max(global_sequence) <= 800 THEN max(global_sequence) ELSE max(global_sequence) FILTER (global_sequence <= 800) END AS durable_sequence, max(global_sequence) <= 800 AS covered FROM j GROUP BY 1"))
def e17(s, d):
    return projection.lane_frontier(journal(s, d), 800)


@R.add("e18_applied_frontier", sql("SELECT min(m) AS applied, count(*) AS projections FROM (SELECT kind, max(global_sequence) AS m FROM j GROUP BY 1)"))
def e18(s, d):
    return projection.applied_frontier(journal(s, d).select(F.col("kind").alias("projection"), F.col("global_sequence").alias("sequence")))


@R.add("e21_axes", sql("SELECT entity, scope, kind, category, count(*) AS events FROM (SELECT entity, scope, kind, (kind >> 12)::INTEGER AS category FROM j) GROUP BY GROUPING SETS ((entity), (scope), (kind), (category), ())"))
def e21(s, d):
    return projection.axes(journal(s, d))


@R.add("i14_subscriber_lag", sql("SELECT entity, available, consumed, greatest(0, available - coalesce(consumed, 0)) AS lag, CASE WHEN consumed IS NULL THEN 'never_polled' WHEN consumed > available THEN 'ahead_of_source' WHEN available > consumed THEN 'lagging' ELSE 'current' END AS finding FROM (SELECT entity, max(global_sequence) AS available, max(global_sequence) FILTER (kind = 8194) AS consumed FROM j GROUP BY 1)"))
def lag_by_entity(s, d):
    produced = projection.project(journal(s, d), available=F.max("global_sequence"))
    consumed = projection.project(journal(s, d), (0x2002,), consumed=F.max("global_sequence"))
    return projection.lag(produced, consumed)



KEYED = "k AS (SELECT payload AS key, global_sequence, entity FROM j)"


@R.add("g1_first_by_key", sql("SELECT key, min(global_sequence) AS global_sequence, arg_min(entity, global_sequence) AS entity FROM k GROUP BY 1", KEYED))
def g1(s, d):
    rows = journal(s, d).select(F.col("payload").alias("key"), "global_sequence", "entity")
    return importing.first_by_key(rows, "key")


BATCHES = "b AS (SELECT global_sequence // 20 AS batch, CASE WHEN global_sequence % 9 <> 0 THEN entity END AS key FROM j), known AS (SELECT DISTINCT entity AS key FROM j WHERE global_sequence < 120)"


@R.add("g2_batch_idempotency", sql("SELECT batch, count(*) AS items, count(known.key) AS cached, CASE WHEN count(known.key) = count(*) THEN 'replay' WHEN count(known.key) = 0 THEN 'commit' ELSE 'partial' END AS outcome FROM b LEFT JOIN known USING (key) GROUP BY 1", BATCHES))
def g2(s, d):
    rows = journal(s, d)
    items = rows.select(F.expr("global_sequence div 20").alias("batch"), F.when(F.col("global_sequence") % 9 != 0, F.col("entity")).alias("key"))
    return importing.batch_outcomes(items, rows.where(F.col("global_sequence") < 120).select(F.col("entity").alias("key")))


IMPORT = """
t AS (SELECT conv_id * 1000 + turn AS global_sequence, sha256('talk:' || conv_id || ':' || turn)[1:32] AS event_id, 'conv:' || conv_id AS entity, 'role:' || role AS scope,
             CASE role WHEN 'user' THEN 12289 WHEN 'assistant' THEN 12290 ELSE 15 END AS kind, turn::INTEGER AS clock FROM conversations),
i AS (SELECT t.*, CASE WHEN global_sequence > 80000 THEN 'above_ceiling' WHEN kind >> 12 IN (0, 13) THEN 'skipped_reserved' WHEN NOT clock < 6 THEN 'skipped_filtered'
             WHEN global_sequence % 17 = 0 THEN 'skipped_reimported' WHEN global_sequence % 4 = 0 THEN 'deduplicated' ELSE 'imported' END AS outcome FROM t)
"""


def _import(s, d):
    talks = talks_journal(s, d)
    known = talks.where(F.col("global_sequence") % 4 == 0)
    return importing.classified(talks, known, 80000, F.col("clock") < 6, F.col("global_sequence") % 17 == 0)


@R.add("g3_import_report", sql("SELECT count(*) FILTER (outcome = 'skipped_reserved') AS skipped_reserved, count(*) FILTER (outcome = 'skipped_filtered') AS skipped_filtered, count(*) FILTER (outcome = 'skipped_reimported') AS skipped_reimported, count(*) FILTER (outcome = 'deduplicated') AS deduplicated, count(*) FILTER (outcome = 'imported') AS imported, max(global_sequence) FILTER (outcome <> 'above_ceiling') AS high_watermark FROM i", IMPORT))
def g3(s, d):
    return importing.import_report(_import(s, d))


@R.add("a12_import", sql("SELECT event_id, entity, kind, 5000 + row_number() OVER (ORDER BY global_sequence) - 1 AS new_sequence FROM i WHERE outcome = 'imported'", IMPORT))
def a12(s, d):
    return importing.imported(_import(s, d), 5000).select("event_id", "entity", "kind", "new_sequence")


@R.add("d8_unknown_keys", sql("SELECT event_id FROM t WHERE global_sequence % 4 <> 0", IMPORT))
def d8(s, d):
    talks = talks_journal(s, d)
    return talks.join(talks.where(F.col("global_sequence") % 4 == 0).select("event_id"), "event_id", "left_anti").select("event_id")


@R.add("g4_eviction", sql("SELECT key, sequence, sequence >= max(sequence) OVER () - 300 AS kept FROM (SELECT payload AS key, max(global_sequence) AS sequence FROM j GROUP BY 1)"))
def g4(s, d):
    keys = journal(s, d).groupBy(F.col("payload").alias("key")).agg(F.max("global_sequence").alias("sequence"))
    return importing.evicted(keys, 300)


@R.add("g5_admission", sql("SELECT batch, count(key) AS keys, count(DISTINCT key) AS new_keys, CASE WHEN count(key) > count(DISTINCT key) THEN 'duplicate_key' WHEN count(DISTINCT key) + 40 > 55 THEN 'refused' ELSE 'admitted' END AS verdict FROM b WHERE key IS NOT NULL GROUP BY 1", BATCHES))
def g5(s, d):
    items = journal(s, d).select(F.expr("global_sequence div 20").alias("batch"), F.when(F.col("global_sequence") % 9 != 0, F.col("entity")).alias("key"))
    return importing.admission(items, 40, 55, "fail_closed")


RANGES = """
r AS (SELECT lo + (CASE WHEN lo % 300 = 0 THEN 95 ELSE 0 END) AS s, hi + (CASE WHEN lo % 300 = 0 THEN 95 ELSE 0 END) AS e FROM cancelled),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (ORDER BY s, e) AS island FROM (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r))
"""


@R.add("g7_merged_ranges", sql('SELECT min(s) AS start, max(e) AS "end" FROM g GROUP BY island', CANCELLED, RANGES))
def g7(s, d):
    move = F.when(F.col("start") % 300 == 0, 95).otherwise(0)
    return visibility.merged_ranges(cancelled(journal(s, d)).select((F.col("start") + move).alias("start"), (F.col("end") + move).alias("end")))


def segments(s, d):
    """All rows with their segment, and the segment that is still written to, which is the last."""
    rows = maintenance.with_segment(journal(s, d), 250)
    return rows, rows.agg(F.max("segment")).first()[0] or 0


SEG = "s AS (SELECT *, global_sequence // 250 AS segment, (SELECT max(event_id) // 250 FROM events) AS active FROM j)"


@R.add("h1_merge", sql("SELECT global_sequence, event_hash FROM j"))
def h1(s, d):
    path = stored(s)
    maintenance.merge(journal(s, d).select("global_sequence", "event_hash"), path, 2)
    return s.read.parquet(path)


@R.add("h2_retention", sql("SELECT global_sequence, kind FROM s WHERE kind <> 4097 OR segment >= active", SEG))
def h2(s, d):
    rows, active = segments(s, d)
    return maintenance.retain(rows, F.col("kind") != 0x1001, active).select("global_sequence", "kind")


@R.add("h3_tombstone", sql("SELECT global_sequence, (CASE WHEN kind = 61441 AND segment < active THEN 4094 ELSE kind END)::INTEGER AS kind, event_hash FROM s", SEG))
def h3(s, d):
    rows, active = segments(s, d)
    return maintenance.tombstone(rows, F.col("kind") != 0xF001, active).select("global_sequence", "kind", "event_hash")


@R.add("k6_compaction_report", sql("SELECT segment, count(*) AS rows_before, count(*) FILTER (kind <> 4097 OR segment >= active) AS rows_after, 0::BIGINT AS rows_after_tombstones, CASE WHEN count(*) FILTER (kind <> 4097 OR segment >= active) < count(*) THEN 'rows_dropped' ELSE 'unchanged' END AS outcome FROM s GROUP BY 1", SEG))
def k6(s, d):
    before, active = segments(s, d)
    return maintenance.compaction_report(before, maintenance.retain(before, F.col("kind") != 0x1001, active))


@R.add("h4_compaction_plan", sql("SELECT entity, count(DISTINCT segment) - 1 AS sealed, CASE WHEN count(DISTINCT segment) - 1 >= 2 THEN 'compact' ELSE 'skip' END AS decision FROM s GROUP BY 1", SEG.replace("FROM j)", "FROM j WHERE entity IS NOT NULL)")))
def h4(s, d):
    return maintenance.compaction_plan(segments(s, d)[0].where("entity is not null"), "entity")


@R.add("g8_kind_union", sql("SELECT 'two' AS folds, kind, count(*) AS rows FROM j WHERE kind IN (4097, 8193, 8194) GROUP BY ALL UNION ALL SELECT 'one_reads_all', kind, count(*) FROM j GROUP BY ALL"))
def g8(s, d):
    """What fused folds read together: the union of their kinds, or all where one reads all."""
    rows = journal(s, d).select("kind")
    sets = {"two": ((0x2001, 0x2002), (0x2002, 0x1001)), "one_reads_all": ((0x2002,), ())}
    parts = [projection.relevant(rows, projection.kind_union(*x)).groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).withColumn("folds", F.lit(n)) for n, x in sets.items()]
    return parts[0].unionByName(parts[1]).select("folds", "kind", "rows")


@R.add("l_projection_cache", sql("SELECT entity AS key, max(global_sequence) FILTER (kind = 8194 OR entity NOT LIKE 'user:1%') AS watermark, (count(*) FILTER (kind = 8194 OR entity NOT LIKE 'user:1%'))::VARCHAR AS state FROM j WHERE kind = 8194 OR entity NOT LIKE 'user:1%' GROUP BY 1"))
def l_cache(s, d):
    """All states put, those of a prefix dropped, some of these put again from purchases only, and the cache rewritten."""
    rows = journal(s, d)
    state = lambda df: df.groupBy(F.col("entity").alias("key")).agg(F.max("global_sequence").alias("watermark"), F.count(F.lit(1)).cast("string").alias("state"))
    kept = cache.ProjectionCache(s, stored(s))
    kept.put(state(rows))
    kept.delete_prefix("user:1")
    kept.put(state(rows.where((F.col("kind") == 0x2002) & F.startswith("entity", F.lit("user:1")))))
    kept.sync()
    return kept.get()


@R.add("h5_fences", sql("SELECT global_sequence FROM j WHERE NOT EXISTS (SELECT 1 FROM cancelled c WHERE global_sequence >= c.lo AND global_sequence < c.hi AND (c.lo // 100) % 3 <> 0)", CANCELLED))
def h5(s, d):
    rows = journal(s, d).select("global_sequence")
    state = F.when(F.expr("start div 100") % 3 == 0, "committed").when(F.expr("start div 100") % 3 == 1, "open").otherwise("cancelled")
    return maintenance.fenced(rows, cancelled(rows).withColumn("state", state))


@R.add("h6_batch_recovery", sql("SELECT global_sequence, batch FROM (SELECT global_sequence, global_sequence // 16 AS batch FROM j) WHERE batch % 5 <> 0"))
def h6(s, d):
    rows = journal(s, d).select("global_sequence", F.expr("global_sequence div 16").alias("batch"), F.lit("row").alias("marker"))
    marks = rows.where("batch % 5 <> 0").select(F.lit(None).cast("long").alias("global_sequence"), "batch", F.lit("commit").alias("marker")).distinct()
    return maintenance.committed_batches(rows.unionByName(marks)).select("global_sequence", "batch")


@R.add("h7_reserved_kinds", sql("SELECT kind, count(*) AS rows FROM t WHERE kind >> 12 IN (0, 13) GROUP BY 1", IMPORT))
def h7(s, d):
    return maintenance.reserved_kinds(talks_journal(s, d))


SEEN = """
v AS (SELECT global_sequence AS g FROM j WHERE NOT EXISTS (SELECT 1 FROM cancelled c WHERE global_sequence >= c.lo AND global_sequence < c.hi)),
jumps AS (SELECT * FROM (SELECT coalesce(lag(g) OVER (ORDER BY g), -1) + 1 AS expected, g AS delivered FROM v) WHERE delivered > expected),
gaps AS (SELECT expected, delivered, greatest(expected, lo) AS shared_from, least(delivered, hi) AS shared_to FROM jumps JOIN cancelled ON greatest(expected, lo) < least(delivered, hi))
"""


@R.add("f6_cursor_gaps", sql("SELECT * FROM gaps", CANCELLED, SEEN))
def f6(s, d):
    return seen_gaps(journal(s, d).select("global_sequence"))


def seen_gaps(rows):
    ranges = cancelled(rows).drop("range_lane")
    return sessions.gaps(visibility.outside(rows, ranges), ranges)


@R.add("i5_newest_gaps", sql("SELECT * FROM gaps ORDER BY delivered DESC, shared_from DESC LIMIT 8", CANCELLED, SEEN))
def i5(s, d):
    return sessions.newest_gaps(seen_gaps(journal(s, d).select("global_sequence")), 8)


ACKS = """
a AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, event_id FROM events),
l AS (SELECT session, nth, CASE WHEN event_id % 11 = 0 THEN nth - 3 WHEN event_id % 13 = 0 THEN nth + 500 ELSE nth END AS ack, CASE WHEN event_id % 7 = 0 THEN 'b' ELSE 'a' END AS route FROM a)
"""


def _acks(s, d):
    from pyspark.sql import Window as W

    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session"), "event_id")
    nth = F.row_number().over(W.partitionBy("session").orderBy("event_id")).cast("long")
    return rows.withColumn("nth", nth)


@R.add("i10_acks", sql("SELECT session, nth, ack, CASE WHEN ack < 1 OR ack > nth THEN 'out_of_range' WHEN route <> 'a' THEN 'wrong_route' WHEN ack < max(ack) OVER (PARTITION BY session ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'regression' ELSE 'accepted' END AS verdict FROM l", ACKS))
def i10(s, d):
    ack = F.when(F.col("event_id") % 11 == 0, F.col("nth") - 3).when(F.col("event_id") % 13 == 0, F.col("nth") + 500).otherwise(F.col("nth"))
    route = F.when(F.col("event_id") % 7 == 0, "b").otherwise("a")
    log = _acks(s, d).select("session", "nth", F.lit(1).alias("sent_first"), F.col("nth").alias("sent_last"), ack.alias("ack"), route.alias("route"), F.lit("a").alias("own_route"))
    return sessions.acks(log)


@R.add("i11_backpressure", sql("SELECT session, nth, f AS in_flight, f >= 4 AS slow_consumer FROM (SELECT session, nth, (sum(1 - CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END) OVER (PARTITION BY session ORDER BY nth ROWS UNBOUNDED PRECEDING))::BIGINT AS f FROM a)", ACKS))
def i11(s, d):
    log = _acks(s, d).withColumns({"sent": F.lit(1), "acked": F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)})
    return sessions.backpressure(log, 16, 8, 4)


@R.add("i12_receipt_stream", sql("SELECT global_sequence, entity FROM j WHERE kind = 8194 AND json_extract_string(payload, '$.k') = '7'"))
def i12(s, d):
    return sessions.receipt_stream(journal(s, d), 0x2002, "k", "7").select("global_sequence", "entity")


@R.add("i9_session_replay", sql("SELECT 'category' AS route, global_sequence FROM j WHERE kind >> 12 = 2 AND global_sequence > 500 UNION ALL SELECT 'entity', global_sequence FROM j WHERE entity = 'user:7' AND scope = 'day:2024-01-03' AND global_sequence > 500 UNION ALL SELECT 'receipt', global_sequence FROM j WHERE kind = 61441 AND json_extract_string(payload, '$.k') = '7' AND global_sequence > 500"))
def i9(s, d):
    """Replay of three session routes from a cursor."""
    rows = journal(s, d).where(F.col("global_sequence") > 500)
    routes = {
        "category": rows.where(F.shiftright("kind", 12) == 2),
        "entity": rows.where((F.col("entity") == "user:7") & (F.col("scope") == "day:2024-01-03")),
        "receipt": sessions.receipt_stream(rows, 0xF001, "k", "7"),
    }
    parts = [df.select(F.lit(name).alias("route"), "global_sequence") for name, df in routes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES, ORACLES = R.queries, R.oracles
