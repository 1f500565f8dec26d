"""A cache of projections' states that outlives a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, watermark long, state string, version long, gone boolean, prefix boolean"


class ProjectionCache:
    """States by key in a table of versions: the newest version of a key holds; ``delete_prefix`` is a version, too.

    One writer at a time.  ``put`` and ``delete_prefix`` are one commit each, so that a reader sees all of it or none; ``sync``
    rewrites what is valid.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self) -> list:
        fs = self._folder().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath() for x in fs.listStatus(self._folder())] if fs.exists(self._folder()) else []

    def _rows(self) -> DataFrame:
        parts = [p.toString() for p in self._files()]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame, version: int) -> None:
        named = rows.withColumn("version", F.lit(version).cast("long"))
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        named.select(*columns).write.parquet(f"{self.path}/v{version:012d}-{uuid.uuid4().hex}")

    def _next(self) -> int:
        return 1 + max((int(p.getName()[1:13]) for p in self._files()), default=-1)

    def put(self, states: DataFrame) -> None:
        """Keeps ``key, watermark, state``."""
        self._write(states.withColumns({"gone": F.lit(False), "prefix": F.lit(False)}), self._next())

    def delete_prefix(self, prefix: str) -> None:
        """Drops every key that starts with ``prefix`` and was put so far."""
        row = self.spark.createDataFrame([(prefix,)], "key string")
        self._write(row.withColumns({"watermark": F.lit(None).cast("long"), "state": F.lit(None).cast("string"), "gone": F.lit(True), "prefix": F.lit(True)}), self._next())

    def get(self, keys: DataFrame | None = None) -> DataFrame:
        """``key, watermark, state`` of all keys, or of those in ``keys``; a key without a state is not there."""
        rows = self._rows()
        states = rows.where("not prefix")
        if keys is not None:
            states = states.join(keys.select("key").distinct(), "key", "left_semi")
        newest = states.groupBy("key").agg(F.max_by(F.struct("watermark", "state", "version"), "version").alias("s")).select("key", "s.*")
        dropped = rows.where("prefix").groupBy(F.col("key").alias("start")).agg(F.max("version").alias("dropped"))
        gone = (F.col("start") == F.left("key", F.length("start"))) & (F.col("dropped") > F.col("version"))
        lengths = [r[0] for r in dropped.select(F.length("start")).distinct().collect()]  # few: prefixes are given one by one
        if not lengths:
            return newest.drop("version")
        starts = newest.withColumn("start", F.explode(F.array(*(F.left("key", F.lit(n)) for n in lengths)))).join(dropped, "start").where(gone)
        return newest.join(starts.select("key").distinct(), "key", "left_anti").drop("version")

    def sync(self) -> None:
        """Rewrites the valid states as one version and drops what was before."""
        old = self._files()
        self.put(self.get())
        fs = self._folder().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for path in old:
            fs.delete(path, True)
