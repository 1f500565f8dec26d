"""The operation catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from .base import Registry

R = Registry()


@R.add("e15_catalog", "SELECT 'brand:' || p_brand AS catalog, 'op:' || p_size AS name, arg_max(p_type, p_partkey) AS title, max(p_partkey) AS sequence FROM part GROUP BY 1, 2")
def e15(s, d):
    """A conflict-free catalog, folded in order."""
    part = s.read.parquet(f"{d}/part.parquet")
    rows = part.select(
        F.concat(F.lit("brand:"), "p_brand").alias("catalog"), F.col("p_partkey").alias("sequence"), F.concat(F.lit("op:"), F.col("p_size").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("supersedes"), F.col("p_type").alias("title"),
    )
    return catalog.register(catalog.puts_and_updates(rows)).where("state = 'live'").select("catalog", "name", "title", "sequence")


@R.add("e15_catalog_last_rows", "SELECT 'all' AS catalog, p_brand AS name, arg_max(p_type, p_partkey) AS title, max(p_partkey) AS sequence FROM part GROUP BY p_brand HAVING arg_max(p_partkey % 3, p_partkey) <> 0")
def e15_last(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    rows = part.select(
        F.lit("all").alias("catalog"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("sequence"), F.col("p_type").alias("title"),
        F.when(F.col("p_partkey") % 3 == 0, "delete").otherwise("put").alias("action"),
    )
    return catalog.last_rows(rows)


QUERIES, ORACLES = R.queries, R.oracles
