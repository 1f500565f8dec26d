"""Registration, the journal as SQL, and side relations in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The journal of ``sources.journal.events_journal`` as DuckDB common table expressions.
JOURNAL = """
e AS (
  SELECT *, CASE event_type WHEN 'view' THEN 4097 WHEN 'click' THEN 4098 WHEN 'signup' THEN 8193
                            WHEN 'purchase' THEN 8194 WHEN 'error' THEN 61441 ELSE 0 END AS kind
  FROM events),
j AS (
  SELECT e.event_id AS global_sequence, lpad(lower(to_hex(e.event_id)), 32, '0') AS event_id,
         lpad(lower(to_hex(first_value(e.event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY e.event_id))), 32, '0') AS correlation_id,
         CASE WHEN e.event_id % 4 <> 0 THEN lpad(lower(to_hex(lag(e.event_id) OVER (PARTITION BY user_id ORDER BY e.event_id))), 32, '0') END AS causation_id,
         'user:' || user_id AS entity, 'day:' || strftime(ts, '%Y-%m-%d') AS scope, kind::INTEGER AS kind,
         epoch_us(ts) // 1000 AS wall_ms, (e.event_id % 3)::INTEGER AS dag_lane, 0 AS dag_depth,
         (e.event_id % 16)::INTEGER AS flags, (e.event_id % 4)::INTEGER AS payload_version, epoch_us(ts) AS timestamp_us,
         props AS payload, value, sha256(props) AS event_hash,
         (row_number() OVER c - 1)::INTEGER AS clock,
         coalesce(lag(sha256(props)) OVER c, repeat('0', 64)) AS prev_hash
  FROM e WINDOW c AS (PARTITION BY user_id, e.event_id % 3 ORDER BY e.event_id))
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([JOURNAL.strip(), *ctes]) + "\n" + body.strip()


#: The ranges of ``cancelled`` as a common table expression, to follow JOURNAL.
CANCELLED = """
cancelled AS (
  SELECT i * 100 AS lo, i * 100 + 5 AS hi, CASE WHEN i % 2 = 0 THEN NULL ELSE (i % 3)::INTEGER END AS lane
  FROM (SELECT unnest(range((SELECT coalesce(max(event_id), -1) // 100 + 1 FROM events))) AS i))
"""


def cancelled(journal: DataFrame) -> DataFrame:
    """``start, end, range_lane``: the first five of every hundred sequences of ``journal``, up to its last; every other range holds for one lane only."""
    last = journal.agg(F.max("global_sequence")).first()[0]
    lane = F.when(F.col("id") % 2 != 0, F.col("id") % 3).cast("int")
    ids = journal.sparkSession.range(0 if last is None else last // 100 + 1)
    return ids.select((F.col("id") * 100).alias("start"), (F.col("id") * 100 + 5).alias("end"), lane.alias("range_lane"))


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def keep(f):
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return keep
