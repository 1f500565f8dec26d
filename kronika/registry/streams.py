"""Streaming operators run to the end of a stored journal; each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.region import Region
from ..sources.journal import events_journal as journal
from ..streaming import cursors
from ..sources.tables import new_path as stored
from .base import Registry, sql

R = Registry()
SCHEMA = "global_sequence long, event_id string, correlation_id string, entity string, kind int, payload string, clock int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def in_files(s, d, files: int = 4) -> str:
    """The journal as a few files in commit order."""
    path = stored(s)
    journal(s, d).select(*NAMES).repartitionByRange(files, "global_sequence").write.parquet(path)
    return path


@R.add("i2_cursor_poll", sql("SELECT global_sequence, entity, kind FROM j WHERE kind >> 12 = 2"))
def i2(s, d):
    path, out, checkpoint = in_files(s, d), stored(s), stored(s)
    cursors.poll(s, path, SCHEMA, Region(category=2), checkpoint, out)
    return s.read.parquet(out).select("global_sequence", "entity", "kind")


@R.add("i7_typed_reactor", sql("SELECT event_id AS causation_id, correlation_id, entity, json_extract(payload, '$.k')::BIGINT * 3 AS tripled FROM j WHERE kind = 8194"))
def i7(s, d):
    path, out = in_files(s, d), stored(s)
    triple = lambda rows: rows.select("event_id", "correlation_id", "entity", (F.col("decoded.k") * 3).alias("tripled"))
    cursors.react(s, path, SCHEMA, 0x2002, "k long", triple, stored(s), out)
    return s.read.parquet(out).select("causation_id", "correlation_id", "entity", "tripled")


@R.add("i8_watch_projection", sql("SELECT entity, count(*) AS generation, max(global_sequence) AS last_sequence FROM j WHERE kind IN (4097, 8194) GROUP BY 1"))
def i8(s, d):
    path, out = in_files(s, d), stored(s)
    cursors.watch(s, path, SCHEMA, [0x1001, 0x2002], stored(s), out, last_sequence=F.max("global_sequence"))
    return cursors.newest(s.read.parquet(out))


@R.add("g1_stream_first_by_key", sql("SELECT payload, count(*) AS deliveries FROM (SELECT DISTINCT payload FROM j) GROUP BY 1"))
def g1_stream(s, d):
    path, out = in_files(s, d), stored(s)
    cursors.first_deliveries(s, path, SCHEMA, "payload", stored(s), out)
    return s.read.parquet(out).groupBy("payload").agg(F.count(F.lit(1)).alias("deliveries"))


@R.add("a16_cursor_resume", sql("SELECT global_sequence, entity FROM j WHERE kind >> 12 = 1"))
def a16(s, d):
    """A cursor polled, stopped, and polled again after the rest was written: nothing is lost or given twice."""
    path, out, checkpoint = stored(s), stored(s), stored(s)
    rows = journal(s, d).select(*NAMES)
    half = (rows.agg(F.max("global_sequence")).first()[0] or 0) // 2
    for part in (F.col("global_sequence") <= half, F.col("global_sequence") > half):
        rows.where(part).write.mode("append").parquet(path)
        cursors.poll(s, path, SCHEMA, Region(category=1), checkpoint, out)
    return s.read.parquet(out).select("global_sequence", "entity")


@R.add("i3_bound_cursor", "SELECT * FROM (VALUES ('same', 'resumed'), ('other_lane', 'refused'), ('other_kinds', 'refused')) t(asked, outcome)")
def i3(s, d):
    """A checkpoint is used again with its own region and with others."""
    checkpoint, where = stored(s), Region(category=2, lane=1)
    cursors.guard(s, checkpoint, where)

    def outcome(asked):
        try:
            cursors.guard(s, checkpoint, asked)
        except ValueError:
            return "refused"
        return "resumed"

    asked = {"same": where, "other_lane": Region(category=2, lane=2), "other_kinds": Region(category=1, lane=1)}
    return s.createDataFrame([(n, outcome(r)) for n, r in asked.items()], "asked string, outcome string")


@R.add("i4_cursor_worker", sql("SELECT global_sequence, entity FROM j WHERE kind = 8194"))
def i4(s, d):
    """A worker that fails at a batch and is started again: the batch is replayed, and its rows are there once."""
    path, out, checkpoint, failed = in_files(s, d), stored(s), stored(s), []

    def handle(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("the handler stops with a rollback")

    rows = lambda: cursors.source(s, path, SCHEMA).where(Region(kind=0x2002).predicate(live=True))
    cursors.with_restarts(lambda: cursors.drain(s, rows(), checkpoint, handle), 2)
    return s.read.parquet(out).select("global_sequence", "entity")


@R.add("i15_committed_batches", sql("SELECT global_sequence, global_sequence // 16 AS batch FROM j WHERE (global_sequence // 16) % 5 <> 0"))
def i15(s, d):
    """Batches of a stream show once their commit marker, which is in a later file for some, has come; others never."""
    path, out = stored(s), stored(s)
    batch = F.expr("global_sequence div 16")
    rows = journal(s, d).select("global_sequence", batch.alias("batch"), F.lit("row").alias("marker"), (batch % 7 == 0).alias("late"))
    marks = rows.where("batch % 5 <> 0").select(F.lit(None).cast("long").alias("global_sequence"), "batch", F.lit("commit").alias("marker"), "late").distinct()
    frames = "global_sequence long, batch long, marker string"
    rows.drop("late").write.parquet(path)
    for late in (False, True):
        marks.where(F.col("late") == late).drop("late").coalesce(1).write.mode("append").parquet(path)
    cursors.committed(s, path, frames, stored(s), out)
    return s.read.parquet(out).select("global_sequence", "batch")


QUERIES, ORACLES = R.queries, R.oracles
