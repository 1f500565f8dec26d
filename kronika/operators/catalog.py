"""The operation catalog: put, update, delete and supersede rows folded to what is registered.

Names affect each other through supersession, so a catalog is one ordered fold: one group for each catalog coordinate.
A catalog holds the operations of one host; rows of different catalogs are folded apart, each by one worker.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RESULT = "catalog string, name string, title string, state string, conflict string, sequence long"


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    live: dict[str, dict] = {}
    conflicts: list[dict] = []
    for row in rows.sort_values("sequence").itertuples(index=False):
        entry = {"catalog": row.catalog, "name": row.name, "title": row.title, "state": "live", "conflict": None, "sequence": row.sequence}
        there = row.name in live
        problem = None
        if row.action == "put":
            problem = "already_registered" if there else None
        elif row.action in ("update", "delete"):
            problem = None if there else "not_registered"
        elif row.action == "supersede":
            problem = "already_registered" if there else None if row.supersedes in live else "superseded_not_registered"
        else:
            problem = "unknown_action"
        if problem:
            conflicts.append({**entry, "state": "conflict", "conflict": problem})
            continue
        if row.action == "supersede":
            del live[row.supersedes]
        if row.action == "delete":
            del live[row.name]
        else:
            live[row.name] = entry
    columns = [c.split()[0] for c in RESULT.split(", ")]
    return pd.DataFrame([*live.values(), *conflicts], columns=columns)


def register(rows: DataFrame) -> DataFrame:
    """Live entries and conflicts of every catalog, from ``catalog, sequence, action, name, supersedes, title``."""
    return rows.groupBy("catalog").applyInPandas(_fold, RESULT)


def last_rows(rows: DataFrame) -> DataFrame:
    """What is live where no row conflicts and none supersedes: the last row of each name, unless it deletes."""
    last = rows.groupBy("catalog", "name").agg(F.max_by(F.struct("action", "title", "sequence"), "sequence").alias("r"))
    return last.where("r.action <> 'delete'").select("catalog", "name", "r.title", "r.sequence")


def puts_and_updates(rows: DataFrame) -> DataFrame:
    """A conflict-free stream: the first row of a name puts, later ones update."""
    nth = F.row_number().over(W.partitionBy("catalog", "name").orderBy("sequence"))
    return rows.withColumn("action", F.when(nth == 1, "put").otherwise("update"))
