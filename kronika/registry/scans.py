"""Scans, filters, order, pages, chain columns, lineage and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clocks, coordinates, kinds, payloads
from ..operators import lineage, query, visibility
from ..plans.region import Region
from ..sources import journal as source
from ..sources.journal import events_journal as journal
from ..sources.tables import new_path as stored
from .base import CANCELLED, Registry, cancelled, sql

R = Registry()
SHOWN = ("global_sequence", "entity", "scope", "kind", "clock")
COLS = ", ".join(SHOWN)


def shown(df):
    return df.select(*SHOWN)


@R.add("a1_open_journal", sql("SELECT global_sequence, event_id, entity, scope, kind, wall_ms, clock, dag_lane, event_hash, prev_hash FROM j"))
def a1(s, d):
    return journal(s, d).select("global_sequence", "event_id", "entity", "scope", "kind", "wall_ms", "clock", "dag_lane", "event_hash", "prev_hash")


@R.add("a3_point_get", sql(f"SELECT {COLS}, payload FROM j WHERE event_id = lpad('2a', 32, '0')"))
def a3(s, d):
    return query.point(journal(s, d), "2a".zfill(32)).select(*SHOWN, "payload")


@R.add("a5_append_roundtrip", sql("SELECT global_sequence, event_id, entity, kind, clock, event_hash, prev_hash FROM j"))
def a5(s, d):
    """Two appends of the events, stored and read again."""
    rows = journal(s, d).select(F.col("global_sequence").alias("ordinal"), "entity", "scope", "kind", "wall_ms", "dag_lane", "payload")
    half = rows.agg((F.max("ordinal") / 2).cast("long")).first()[0] or 0
    path = stored(s)
    source.append(None, rows.where(F.col("ordinal") <= half), path)
    second = rows.where(F.col("ordinal") > half).withColumn("ordinal", F.col("ordinal") - half - 1)
    source.append(source.open_journal(s, path), second, path)
    return source.open_journal(s, path).select("global_sequence", "event_id", "entity", "kind", "clock", "event_hash", "prev_hash")


@R.add("a9_reactions", sql("SELECT global_sequence, entity, 61442 AS kind, event_id AS causation_id, correlation_id FROM j WHERE kind = 8194"))
def a9(s, d):
    bought = journal(s, d).where(F.col("kind") == 0x2002)
    return bought.select("global_sequence", "entity", F.lit(0xF002).alias("kind"), F.col("event_id").alias("causation_id"), "correlation_id")


#: Sequences that readers with a lag do not see yet.
LAG = 50
LAGGED = f"global_sequence < (SELECT max(global_sequence) - {LAG} FROM j)"


def lagged(rows):
    """The visibility bound: the last sequence less the lag."""
    return (rows.agg(F.max("global_sequence")).first()[0] or 0) - LAG


@R.add("a11_snapshot", sql(f"SELECT count(*) AS rows, max(global_sequence) AS last_sequence FROM j WHERE {LAGGED}"))
def a11(s, d):
    rows = journal(s, d).select("global_sequence", "event_hash")
    return source.snapshot(rows, stored(s), lagged(rows)).select("rows", "last_sequence")


@R.add("a10_fork", sql("SELECT count(*) AS rows, max(global_sequence) AS last_sequence FROM j"))
def a10(s, d):
    rows = journal(s, d).select("global_sequence", "event_hash", "dag_lane", "dag_depth")
    return source.fork(rows, stored(s), 7).select("rows", "last_sequence")


REGIONS = {
    "b1_all": (Region(), "true"),
    "b2_namespace": (Region(entity="user:1"), "(entity = 'user:1' OR starts_with(entity, 'user:1:'))"),
    "b2_namespace_root": (Region(entity="user"), "(entity = 'user' OR starts_with(entity, 'user:'))"),
    "b3_scope": (Region(scope="day:2024-01-02"), "scope = 'day:2024-01-02'"),
    "b4_kind": (Region(kind=0x2002), "kind = 8194"),
    "b5_category": (Region(category=0x2), "kind >> 12 = 2"),
    "b6_any_kind": (Region(any_kind=True), "true"),
    "b7_clock": (Region(category=0x1, clock=(2, 4)), "kind >> 12 = 1 AND clock BETWEEN 2 AND 4"),
    "b8_lane": (Region(lane=1), "dag_lane = 1"),
}


def add_region(name, where, condition):
    @R.add(name, sql(f"SELECT {COLS} FROM j WHERE {condition}"))
    def q(s, d):
        return shown(query.region(journal(s, d), where))


for _name, (_where, _condition) in REGIONS.items():
    add_region(_name, _where, _condition)

HIDDEN = "EXISTS (SELECT 1 FROM cancelled c WHERE global_sequence >= c.lo AND global_sequence < c.hi)"


@R.add("b9_visible", sql(f"SELECT {COLS} FROM j WHERE {LAGGED} AND NOT {HIDDEN}", CANCELLED))
def b9(s, d):
    rows = journal(s, d)
    return shown(visibility.visible(rows, cancelled(rows).drop("range_lane"), lagged(rows)))


@R.add("b9_visible_on_lane", sql(f"SELECT {COLS}, dag_lane FROM j WHERE dag_lane = 2 AND {LAGGED} AND NOT EXISTS (SELECT 1 FROM cancelled c WHERE global_sequence >= c.lo AND global_sequence < c.hi AND (c.lane IS NULL OR c.lane = dag_lane))", CANCELLED))
def b9_lane(s, d):
    rows = journal(s, d)
    return visibility.visible_on_lane(rows, cancelled(rows), F.lit(lagged(rows)), 2).select(*SHOWN, "dag_lane")


@R.add("b10_conjunction", sql(f"SELECT {COLS} FROM j WHERE {LAGGED} AND NOT {HIDDEN} AND kind >> 12 = 1 AND clock BETWEEN 0 AND 9 AND dag_lane = 0", CANCELLED))
def b10(s, d):
    rows = journal(s, d)
    seen = visibility.visible(rows, cancelled(rows).drop("range_lane"), lagged(rows))
    return shown(query.region(seen, Region(category=1, clock=(0, 9), lane=0)))


@R.add("b11_stream", sql("SELECT global_sequence, wall_ms, clock, event_id FROM j WHERE entity = 'user:7' ORDER BY wall_ms, clock, event_id"))
def b11(s, d):
    return query.stream(journal(s, d), "user:7").select("global_sequence", "wall_ms", "clock", "event_id")


@R.add("b11_latest", sql("SELECT entity, dag_lane, max(global_sequence) AS global_sequence, arg_max(kind, global_sequence) AS kind FROM j GROUP BY 1, 2"))
def b11_latest(s, d):
    return query.latest(journal(s, d), "kind")


@R.add("b11_exact_coordinate", sql(f"SELECT {COLS} FROM j WHERE entity = 'user:7' AND scope = 'day:2024-01-03'"))
def b11_exact(s, d):
    return shown(query.at_coordinate(journal(s, d), "user:7", "day:2024-01-03"))


@R.add("b12_causal_flags", sql("SELECT global_sequence, correlation_id <> event_id AS is_correlated, causation_id IS NULL AS is_root_cause FROM j"))
def b12(s, d):
    return query.causal_flags(journal(s, d)).select("global_sequence", "is_correlated", "is_root_cause")


@R.add("b13_metadata", sql("SELECT global_sequence, entity, kind, event_hash FROM j WHERE kind = 4098"))
def b13(s, d):
    return query.metadata(query.region(journal(s, d), Region(kind=0x1002))).select("global_sequence", "entity", "kind", "event_hash")


@R.add("b14_map_payload", sql("SELECT global_sequence, (json_extract(payload, '$.k'))::BIGINT * 2 AS doubled FROM j"))
def b14(s, d):
    return payloads.with_json(journal(s, d), "k long").select("global_sequence", (F.col("decoded.k") * 2).alias("doubled"))


@R.add(
    "b15_gates",
    sql(
        """
SELECT global_sequence,
  CASE WHEN kind = 61441 THEN 'kind' WHEN NOT value < 90 THEN 'amount' WHEN NOT clock < 20 THEN 'clock' END AS first_denial,
  concat_ws(',', CASE WHEN kind = 61441 THEN 'kind' END, CASE WHEN NOT value < 90 THEN 'amount' END, CASE WHEN NOT clock < 20 THEN 'clock' END) AS denials,
  concat_ws(',', 'kind=' || CASE WHEN kind = 61441 THEN 'deny' ELSE 'permit' END,
    'amount=' || CASE WHEN kind = 61441 THEN 'skipped' WHEN NOT value < 90 THEN 'deny' ELSE 'permit' END,
    'clock=' || CASE WHEN kind = 61441 OR NOT value < 90 THEN 'skipped' WHEN NOT clock < 20 THEN 'deny' ELSE 'permit' END) AS trace
FROM (SELECT * REPLACE (coalesce(value, 1e9) AS value) FROM j)"""
    ),
)
def b15(s, d):
    gates = query.gate_columns(("kind", F.col("kind") != 0xF001), ("amount", F.col("value") < 90), ("clock", F.col("clock") < 20))
    return journal(s, d).select("global_sequence", *(c.alias(n) for n, c in gates.items()))


@R.add("b16_write_policy", sql("SELECT global_sequence, CASE WHEN kind = 61441 AND global_sequence % 10 = 0 THEN 'bypassed' WHEN kind = 61441 THEN 'denied' ELSE 'accepted' END AS disposition FROM j"))
def b16(s, d):
    denied = query.gate_columns(("kind", F.col("kind") != 0xF001))["first_denial"].isNotNull()
    bypass = F.col("global_sequence") % 10 == 0
    out = F.when(denied & bypass, "bypassed").when(denied, "denied").otherwise("accepted")
    return journal(s, d).select("global_sequence", out.alias("disposition"))


IDENTITIES = """
SELECT * FROM (VALUES
  ('b1_all', 'entity=-|scope=-|fact=-|clock=-'), ('b2_namespace', 'entity=6:user:1|scope=-|fact=-|clock=-'),
  ('b2_namespace_root', 'entity=4:user|scope=-|fact=-|clock=-'), ('b3_scope', 'entity=-|scope=14:day:2024-01-02|fact=-|clock=-'),
  ('b4_kind', 'entity=-|scope=-|fact=kind:8194|clock=-'), ('b5_category', 'entity=-|scope=-|fact=category:2|clock=-'),
  ('b6_any_kind', 'entity=-|scope=-|fact=any|clock=-'), ('b7_clock', 'entity=-|scope=-|fact=category:1|clock=2..4'),
  ('b8_lane', 'entity=-|scope=-|fact=-|clock=-|lane=1')) t(region, identity)
"""


@R.add("b17_region_identity", IDENTITIES)
def b17(s, d):
    rows = [(name, where.identity()) for name, (where, _) in sorted(REGIONS.items())]
    return s.createDataFrame(rows, "region string, identity string")


@R.add("b18_filter_map_take", sql("SELECT global_sequence, round(value * 2, 6) AS doubled FROM j WHERE kind = 8194 AND CASE WHEN value > 20 THEN value END IS NOT NULL ORDER BY global_sequence LIMIT 25"))
def b18(s, d):
    steps = (("take", 25), ("map", "doubled", F.when(F.col("value") > 20, F.round(F.col("value") * 2, 6))), ("filter", F.col("kind") == 0x2002))
    return query.pipeline(journal(s, d), *steps).select("global_sequence", "doubled")


@R.add("b18_running", sql("SELECT global_sequence, entity, (sum(clock) OVER (PARTITION BY entity ORDER BY global_sequence ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM j"))
def b18_scan(s, d):
    return query.running(journal(s, d), F.col("clock"), "running").select("global_sequence", "entity", "running")


EFFECTS = """
x AS (SELECT o_orderkey AS id, o_orderkey % 4 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS c FROM orders)
"""


@R.add("b19_effects", sql("SELECT id, CASE WHEN a = 3 THEN 'reads:r3' WHEN b = 2 THEN 'writes:w2' WHEN c = 4 THEN 'emits:e4' END AS violation FROM x", EFFECTS))
def b19(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    name = lambda letter, n: F.concat(F.lit(letter), (F.col("id") % n).cast("string"))
    rows = orders.select(
        "id",
        F.array(name("r", 4)).alias("observed_reads"), F.array(*map(F.lit, ("r0", "r1", "r2"))).alias("declared_reads"),
        F.array(name("w", 3)).alias("observed_writes"), F.array(*map(F.lit, ("w0", "w1"))).alias("declared_writes"),
        F.array(name("e", 5)).alias("observed_emits"), F.array(*map(F.lit, ("e0", "e1", "e2", "e3"))).alias("declared_emits"),
    )
    return query.checked_effects(rows, ("reads", "writes", "emits")).select("id", "violation")


@R.add(
    "b20_effect_classes",
    """SELECT o_orderkey AS id, CASE
  WHEN c = 0 AND (w OR e OR k) THEN 'inspect_must_only_read' WHEN c = 1 AND (r OR w OR e OR k) THEN 'compute_must_be_pure'
  WHEN c = 2 AND NOT w THEN 'persist_must_write' WHEN c = 3 AND NOT e THEN 'emit_must_emit' WHEN c = 4 AND NOT k THEN 'control_must_control' END AS problem
FROM (SELECT *, o_orderkey % 5 AS c, o_orderkey % 2 = 0 AS r, o_orderkey % 3 = 0 AS w, o_orderkey % 7 = 0 AS e, o_orderkey % 11 = 0 AS k FROM orders)""",
)
def b20(s, d):
    key = F.col("o_orderkey")
    cls = F.element_at(F.array(*map(F.lit, ("inspect", "compute", "persist", "emit", "control"))), (key % 5 + 1).cast("int"))
    problem = query.effect_problem(cls, key % 2 == 0, key % 3 == 0, key % 7 == 0, key % 11 == 0)
    return s.read.parquet(f"{d}/orders.parquet").select(key.alias("id"), problem.alias("problem"))


@R.add("c1_commit_order", sql(f"SELECT {COLS} FROM j WHERE kind = 61441 ORDER BY global_sequence"))
def c1(s, d):
    return shown(query.region(journal(s, d), Region(kind=0xF001)).orderBy("global_sequence"))


@R.add("c2_page", sql(f"SELECT {COLS} FROM j WHERE kind >> 12 = 2 AND global_sequence > 250 ORDER BY global_sequence LIMIT 40"))
def c2(s, d):
    return shown(query.page(journal(s, d), Region(category=2), 250, 40))


@R.add("c2_first_page", sql(f"SELECT {COLS} FROM j ORDER BY global_sequence LIMIT 10"))
def c2_first(s, d):
    return shown(query.page(journal(s, d), Region(), None, 10))


@R.add("c3_empty_page", sql(f"SELECT {COLS} FROM j LIMIT 0"))
def c3(s, d):
    return shown(query.page(journal(s, d), Region(), None, 0))


@R.add("c3_top_k", sql(f"SELECT {COLS} FROM j ORDER BY global_sequence DESC LIMIT 40"))
def c3_top(s, d):
    return shown(query.newest(journal(s, d), Region(), 40))


@R.add("c3_top_k_by_entity", sql("SELECT entity, global_sequence, nth FROM (SELECT entity, global_sequence, (row_number() OVER (PARTITION BY entity ORDER BY global_sequence DESC))::INTEGER AS nth FROM j) WHERE nth <= 3"))
def c3_by_entity(s, d):
    return query.newest_by(journal(s, d).select("entity", "global_sequence"), 3, "entity").select("entity", "global_sequence", "nth")


@R.add("a4_payloads", sql("SELECT p.nth, p.event_id, j.payload FROM (SELECT event_id AS nth, lpad(lower(to_hex(event_id * 7)), 32, '0') AS event_id FROM events) p LEFT JOIN j ON j.event_id = p.event_id"))
def a4(s, d):
    """A plan that asks for every seventh event, in which ids beyond the last have no payload."""
    rows = journal(s, d)
    plan = rows.select(F.col("global_sequence").alias("nth"), source.id_of(F.col("global_sequence") * 7).alias("event_id"))
    return query.payloads(rows, plan)


@R.add("c6_position_order", sql("SELECT a.global_sequence AS a, b.global_sequence AS b, CASE WHEN a.dag_lane = b.dag_lane AND a.dag_depth = b.dag_depth THEN CASE WHEN a.global_sequence < b.global_sequence THEN 'before' WHEN a.global_sequence > b.global_sequence THEN 'after' ELSE 'equal' END ELSE 'unordered' END AS relation FROM j a JOIN j b ON b.event_id = a.causation_id"))
def c6(s, d):
    """Every event of the table that has a cause, against that cause."""
    rows = journal(s, d).select("event_id", "causation_id", "dag_lane", "dag_depth", "global_sequence")
    a, b = rows.alias("a"), rows.alias("b")
    sides = [F.col(f"{x}.{c}") for x in "ab" for c in ("dag_lane", "dag_depth", "global_sequence")]
    pairs = a.join(b, F.col("a.causation_id") == F.col("b.event_id"))
    return pairs.select(F.col("a.global_sequence").alias("a"), F.col("b.global_sequence").alias("b"), clocks.position_order(*sides).alias("relation"))


@R.add("c7_clock_points", sql("SELECT entity, max(global_sequence) AS sequence, arg_max(wall_ms, global_sequence) AS wall_ms FROM j GROUP BY entity"))
def c7(s, d):
    top = journal(s, d).groupBy("entity").agg(F.max_by(clocks.point(), "global_sequence").alias("p"))
    return top.select("entity", F.col("p.sequence").alias("sequence"), F.col("p.wall_ms").alias("wall_ms"))


PARENTS = """
m AS (SELECT c.global_sequence, p.global_sequence AS p FROM j c JOIN j p ON c.entity = p.entity AND p.event_hash = c.prev_hash AND p.global_sequence < c.global_sequence),
chain AS (SELECT global_sequence, max(p) AS parent, count(*) AS matches FROM m GROUP BY 1)
"""
STREAM_PARENTS = """
f AS (SELECT entity, event_hash, arg_min(global_sequence, (wall_ms, clock, event_id)) AS parent FROM j GROUP BY 1, 2),
sp AS (SELECT c.global_sequence, f.parent FROM j c JOIN f ON f.entity = c.entity AND f.event_hash = c.prev_hash)
"""


@R.add("d1_hit_upgrade", sql("SELECT event_id, global_sequence, kind FROM j WHERE global_sequence % 50 = 0"))
def d1(s, d):
    rows = journal(s, d)
    hits = rows.where(F.col("global_sequence") % 50 == 0).select("event_id")
    return query_join(hits, rows)


def query_join(hits, rows):
    return lineage.upgraded(hits, rows.select("event_id", "global_sequence", "kind"))


@R.add("d2_chain_parents", sql("SELECT * FROM chain", PARENTS))
def d2(s, d):
    return lineage.chain_parents(journal(s, d))


@R.add(
    "d3_ancestors",
    sql(
        "SELECT anchor, depth, seq AS global_sequence FROM walk",
        STREAM_PARENTS,
        """walk(anchor, depth, seq, path) AS (
  SELECT global_sequence, 0, global_sequence, [global_sequence] FROM j WHERE global_sequence % 100 = 99
  UNION ALL
  SELECT anchor, depth + 1, sp.parent, list_append(path, sp.parent) FROM walk JOIN sp ON sp.global_sequence = walk.seq
  WHERE depth < 5 AND NOT list_contains(path, sp.parent))""",
    ),
)
def d3(s, d):
    rows = journal(s, d)
    return lineage.ancestors(lineage.stream_parents(rows), rows.where(F.col("global_sequence") % 100 == 99), 6)


@R.add("d4_causes", sql("SELECT a.global_sequence, b.global_sequence AS cause_sequence, b.kind AS cause_kind FROM j a JOIN j b ON a.causation_id = b.event_id"))
def d4(s, d):
    return lineage.causes(journal(s, d)).select("global_sequence", "cause_sequence", "cause_kind")


@R.add("d5_correlation_groups", sql("SELECT correlation_id, count(*) AS events, min(global_sequence) AS first_sequence, max(global_sequence) AS last_sequence FROM j GROUP BY 1"))
def d5(s, d):
    return lineage.correlation_groups(journal(s, d))


@R.add(
    "d9_range_overlap",
    sql(
        "SELECT w.lo, w.hi, c.lo AS start, c.hi AS \"end\", greatest(w.lo, c.lo) AS shared_from, least(w.hi, c.hi) AS shared_to FROM w JOIN cancelled c ON greatest(w.lo, c.lo) < least(w.hi, c.hi)",
        CANCELLED,
        "w AS (SELECT global_sequence AS lo, global_sequence + 7 AS hi FROM j WHERE kind = 8194)",
    ),
)
def d9(s, d):
    rows = journal(s, d)
    spans = rows.where(F.col("kind") == 0x2002).select(F.col("global_sequence").alias("lo"), (F.col("global_sequence") + 7).alias("hi"))
    return visibility.overlaps(spans, cancelled(rows).drop("range_lane"))


@R.add("d14_scope_entities", sql("SELECT DISTINCT entity, scope FROM j WHERE scope = 'day:2024-01-02'"))
def d14(s, d):
    return query.region(journal(s, d), Region(scope="day:2024-01-02")).select("entity", "scope").distinct()


@R.add("f1_clock", sql("SELECT global_sequence, clock FROM j"))
def f1(s, d):
    return journal(s, d).select("global_sequence", "clock")


@R.add("f2_prev_hash", sql("SELECT global_sequence, prev_hash FROM j"))
def f2(s, d):
    return journal(s, d).select("global_sequence", "prev_hash")


@R.add("f3_monotone_wall", sql("SELECT global_sequence, max(wall_ms - (global_sequence % 7) * 1000000) OVER (PARTITION BY entity, dag_lane ORDER BY global_sequence ROWS UNBOUNDED PRECEDING) AS wall_ms FROM j"))
def f3(s, d):
    raw = journal(s, d).withColumn("raw", F.col("wall_ms") - (F.col("global_sequence") % 7) * 1000000)
    return raw.select("global_sequence", source.monotone_wall("raw").alias("wall_ms"))


@R.add("f5_chain_check", sql("SELECT global_sequence, sha256(payload) = event_hash AS hash_ok, true AS prev_ok FROM j"))
def f5(s, d):
    return lineage.chain_problems(journal(s, d))


@R.add("f7_cas", sql("SELECT global_sequence, greatest(clock - 1, 0)::INTEGER AS latest, greatest(clock - 1, 0) = expected AS passes FROM (SELECT *, (global_sequence % 3)::INTEGER AS expected FROM j)"))
def f7(s, d):
    chain = source.chain_window()
    held = F.coalesce(F.lag("clock").over(chain), F.lit(0))
    return journal(s, d).select("global_sequence", held.alias("latest"), (held == F.col("global_sequence") % 3).alias("passes"))


@R.add("f8_branch_root", sql("SELECT global_sequence, 9 AS dag_lane, (dag_depth + 1)::INTEGER AS dag_depth FROM j WHERE clock = 0"))
def f8(s, d):
    roots = journal(s, d).where(F.col("clock") == 0)
    return roots.select("global_sequence", F.lit(9).alias("dag_lane"), (F.col("dag_depth") + 1).alias("dag_depth"))


@R.add("f9_order_regressions", sql("SELECT global_sequence, parent FROM sp WHERE parent >= global_sequence", STREAM_PARENTS))
def f9(s, d):
    return lineage.stream_parents(journal(s, d)).where("parent >= global_sequence")


@R.add("j_kind_bits", sql("SELECT global_sequence, (kind >> 12)::INTEGER AS category, kind & 4095 AS type_id, kind >> 12 IN (0, 13) AS reserved, flags & 2 <> 0 AS transactional FROM j"))
def j_kind(s, d):
    kind = F.col("kind")
    return journal(s, d).select("global_sequence", kinds.category(kind).alias("category"), kinds.type_id(kind).alias("type_id"), kinds.is_reserved(kind).alias("reserved"), kinds.has_flag(F.col("flags"), "transactional").alias("transactional"))


@R.add("j_time", sql("SELECT global_sequence, timestamp_us // 1000 AS ms, 1800000000000000 - timestamp_us AS age_us FROM j"))
def j_time(s, d):
    us = F.col("timestamp_us")
    return journal(s, d).select("global_sequence", clocks.truncated_ms(us).alias("ms"), (F.lit(1800000000000000) - us).alias("age_us"))


@R.add("j_strings", sql("SELECT global_sequence, entity || '@' || scope AS coordinate, dag_lane || '/' || dag_depth || ':' || global_sequence AS position FROM j"))
def j_strings(s, d):
    position = F.format_string("%d/%d:%d", "dag_lane", "dag_depth", "global_sequence")
    return journal(s, d).select("global_sequence", coordinates.shown(F.col("entity"), F.col("scope")).alias("coordinate"), position.alias("position"))


@R.add("j_hex", sql("SELECT global_sequence, hex(entity) AS hexed, entity AS back FROM j"))
def j_hex(s, d):
    return journal(s, d).select("global_sequence", F.hex("entity").alias("hexed"), F.unhex(F.hex("entity")).cast("string").alias("back"))


@R.add("j_operation_key", sql("SELECT global_sequence, sha256('4:demo' || length(entity) || ':' || entity || length(scope) || ':' || scope)[1:32] AS key FROM j"))
def j_key(s, d):
    return journal(s, d).select("global_sequence", payloads.operation_key("demo", F.col("entity"), F.col("scope")).alias("key"))


@R.add("j_upcast", sql("SELECT global_sequence, CASE WHEN payload_version IN (0, 2) THEN k WHEN payload_version = 1 THEN k * 10 END AS k, CASE WHEN payload_version IN (0, 2) THEN 'current' WHEN payload_version > 2 THEN 'future_version' ELSE 'upcast' END AS state FROM (SELECT *, json_extract(payload, '$.k')::BIGINT AS k FROM j)"))
def j_upcast(s, d):
    steps = payloads.Upcasts().add(1, 1, lambda k: k * 10)
    rows = payloads.with_json(journal(s, d), "k long")
    version = F.col("payload_version")
    return rows.select("global_sequence", steps.apply(1, 2, version, F.col("decoded.k")).alias("k"), payloads.version_state(version, 2).alias("state"))


@R.add(
    "j_coordinate_rules",
    "SELECT doc_id, CASE WHEN t = '' THEN 'entity_empty' WHEN strlen(t) > 1024 THEN 'entity_too_long' WHEN contains(t, chr(0)) THEN 'entity_nul' WHEN regexp_matches(t, '[\\x01-\\x1F\\x7F]') THEN 'entity_control' WHEN contains(t, '/') OR contains(t, '..') THEN 'entity_path' WHEN regexp_matches(t, '[|=]') THEN 'entity_separator' WHEN source IS NULL THEN 'scope_empty' END AS problem FROM (SELECT doc_id, coalesce(text, '') AS t, source FROM documents)",
)
def j_rules(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", coordinates.coordinate_problem(F.col("text"), F.col("source")).alias("problem"))


@R.add("j_digest", sql("SELECT entity, sha256(string_agg(event_hash, '|' ORDER BY global_sequence)) AS digest FROM j GROUP BY entity"))
def j_digest(s, d):
    return journal(s, d).groupBy("entity").agg(payloads.digest_of(F.col("event_hash"), F.col("global_sequence")).alias("digest"))


@R.add("j_clock_lattice", sql("SELECT global_sequence, greatest(global_sequence, 500) AS later, least(global_sequence, 500) AS earlier FROM j"))
def j_lattice(s, d):
    own, other = clocks.point(), F.struct(F.lit(0).cast("long").alias("wall_ms"), F.lit(500).cast("long").alias("sequence"))
    return journal(s, d).select("global_sequence", clocks.later(own, other)["sequence"].alias("later"), clocks.earlier(own, other)["sequence"].alias("earlier"))


QUERIES, ORACLES = R.queries, R.oracles
