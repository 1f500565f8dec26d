"""Every registered query with SQL gives the rows of that SQL; plans push filters and columns down."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from kronika import registry
from kronika.operators import query
from kronika.plans.region import Region
from kronika.sources.journal import events_journal

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def same_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert same_rows(df.columns, df.collect()) == same_rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def far_events(spark, path, ids):
    """A folder whose events have the given expression of ``event_id``."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("event_id", F.expr(ids).cast(events.schema["event_id"].dataType)).write.parquet(f"{path}/events.parquet")
    return str(path)


def over(path, sql):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return db.execute(sql)


@pytest.mark.parametrize("name", ["a11_snapshot", "b9_visible", "b9_visible_on_lane", "b10_conjunction", "c6_position_order"])
def test_bounds_follow_the_table(spark, tmp_path, name):
    """No sequence is too high for the visibility bound, the cancelled ranges and the pairs."""
    path = far_events(spark, tmp_path / "far", "event_id + 300000")
    df, want = registry.QUERIES[name](spark, path), over(path, registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = df.collect()
    assert len(rows) and (name.startswith("a11") or max(r[0] for r in rows) > 300_000)
    assert same_rows(df.columns, rows) == same_rows(columns, want.fetchall())
    if name.startswith("b9"):
        assert not any(r.global_sequence % 200 < 5 for r in rows)


def test_hits_have_no_last_sequence(spark, tmp_path):
    path = far_events(spark, tmp_path / "far", "event_id + 1048600")
    got = registry.QUERIES["d1_hit_upgrade"](spark, path)
    want = over(path, registry.ORACLES["d1_hit_upgrade"])
    columns = [c[0] for c in want.description]
    rows = got.collect()
    assert len(rows) and same_rows(got.columns, rows) == same_rows(columns, want.fetchall())


def test_scan_reads_what_it_needs(spark):
    plan = query.region(events_journal(spark, SF), Region(kind=0x2002)).select("global_sequence", "entity")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    assert "Window" not in plan and "Exchange" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
