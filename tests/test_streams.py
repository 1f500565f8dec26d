"""Streams: resumption, region guard, failing reactors."""

import pytest
from pyspark.sql import functions as F

from kronika.plans.region import Region
from kronika.streaming import cursors

SCHEMA = "global_sequence long, event_id string, correlation_id string, entity string, kind int, payload string, clock int"


def add(spark, path, sequences, payload='{"k": 1}'):
    rows = [(i, f"{i:032x}", f"{i:032x}", f"user:{i % 3}", 0x2002 if i % 2 else 0x1001, payload, i) for i in sequences]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_cursor_resumes_and_guards(spark, tmp_path):
    path, check, out = (str(tmp_path / n) for n in ("j", "c", "o"))
    where = Region(kind=0x2002)
    add(spark, path, range(10))
    cursors.poll(spark, path, SCHEMA, where, check, out)
    add(spark, path, range(10, 20))
    cursors.poll(spark, path, SCHEMA, where, check, out)
    cursors.poll(spark, path, SCHEMA, where, check, out)
    assert sorted(r.global_sequence for r in spark.read.parquet(out).collect()) == list(range(1, 20, 2))
    with pytest.raises(ValueError):
        cursors.poll(spark, path, SCHEMA, Region(kind=0x1001), check, out)


def test_reactor_stops_at_what_it_cannot_decode(spark, tmp_path):
    path, check, out = (str(tmp_path / n) for n in ("j", "c", "o"))
    add(spark, path, range(4))
    react = lambda rows: rows.select("event_id", F.col("decoded.k").alias("k"))
    cursors.react(spark, path, SCHEMA, 0x2002, "k long", react, check, out)
    assert spark.read.parquet(out).count() == 2
    add(spark, path, range(4, 6), payload="not json")
    with pytest.raises(Exception):
        cursors.react(spark, path, SCHEMA, 0x2002, "k long", react, check, out)
    assert spark.read.parquet(out).count() == 2


def test_watched_projection_emits_rising_generations(spark, tmp_path):
    path, check, out = (str(tmp_path / n) for n in ("j", "c", "o"))
    add(spark, path, range(6))
    add(spark, path, range(6, 8))
    cursors.watch(spark, path, SCHEMA, [], check, out, last=F.max("global_sequence"))
    emitted = spark.read.parquet(out)
    assert emitted.count() == 5
    assert {(r.entity, r.generation, r.last) for r in cursors.newest(emitted).collect()} == {("user:0", 3, 6), ("user:1", 3, 7), ("user:2", 2, 5)}


def test_worker_replays_the_failed_batch(spark, tmp_path):
    path, check, out = (str(tmp_path / n) for n in ("j", "c", "o"))
    add(spark, path, range(6))
    failures = [2]

    def handle(batch, number):
        if failures[0]:
            failures[0] -= 1
            raise RuntimeError("handler")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = lambda: cursors.drain(spark, cursors.source(spark, path, SCHEMA), check, handle)
    assert cursors.with_restarts(run, 3) == 2
    assert spark.read.parquet(out).count() == 6
    failures[0] = 5
    add(spark, path, range(6, 8))
    with pytest.raises(Exception):
        cursors.with_restarts(run, 1)
