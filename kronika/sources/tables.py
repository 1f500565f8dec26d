"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_path(spark: SparkSession, label: str = "journal") -> str:
    """A new path in ``spark.checkpoint.dir``; in a folder of our own only where that is unset and Spark runs in this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="kronika-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write and read again: cuts the lineage of loops with data that outlives any executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
