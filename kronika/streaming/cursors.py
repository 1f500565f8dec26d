"""Streams over a stored journal that run to the end of what is there (``availableNow``) and stop.

Delivery is at least once; sinks are keyed by event id or by batch, so that a batch that runs again changes nothing.
Pushed rows are never dropped for a slow consumer: a lossy subscription is served by this superset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.region import Region

IDENTITY = "region.txt"


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def guard(spark: SparkSession, checkpoint: str, where: Region) -> None:
    """A checkpoint belongs to one region: the first use writes its identity, others must match it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{IDENTITY}")
    fs = path.getFileSystem(conf)
    if fs.exists(path):
        held = spark.read.text(path.toString()).first()
        if held is None or held[0] != where.identity():
            raise ValueError(f"the checkpoint belongs to {held and held[0]}, not to {where.identity()}")
        return
    out = fs.create(path, False)
    out.write(bytearray((where.identity() + "\n").encode()))
    out.close()


def drain(spark: SparkSession, rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run ``handle`` on every micro-batch until the source has no more; an error leaves the batch to be run again."""
    (
        rows.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def poll(spark: SparkSession, path: str, schema: str, where: Region, checkpoint: str, out: str) -> None:
    """Deliver the region's rows that this cursor has not seen to ``out``; one folder for each batch."""
    guard(spark, checkpoint, where)
    rows = source(spark, path, schema).where(where.predicate(live=True))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(spark, rows, f"{checkpoint}/stream", handle)


def react(spark: SparkSession, path: str, schema: str, kind: int, payload: str, reaction: Callable[[DataFrame], DataFrame], checkpoint: str, out: str) -> None:
    """A typed reactor: rows of ``kind`` are decoded, others pass silently; one that cannot be decoded stops the stream.

    A batch's reactions are computed whole, then written once; they carry their cause's id and correlation.
    """
    rows = source(spark, path, schema).where(F.col("kind") == kind)

    def handle(batch: DataFrame, number: int) -> None:
        decoded = batch.withColumn("decoded", F.from_json("payload", payload, {"mode": "FAILFAST"}))
        caused = reaction(decoded).withColumnsRenamed({"event_id": "causation_id"})
        caused.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(spark, rows, checkpoint, handle)


def watch(spark: SparkSession, path: str, schema: str, kinds: list[int], checkpoint: str, out: str, **aggregates) -> None:
    """A watched projection: after each batch the changed entities' state, with its generation (rows so far)."""
    rows = source(spark, path, schema)
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    state = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("generation"), *(c.alias(n) for n, c in aggregates.items()))

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(spark, state, checkpoint, handle, mode="update")


def newest(emitted: DataFrame) -> DataFrame:
    """Of each entity's emissions the one of the highest generation."""
    others = [c for c in emitted.columns if c not in ("entity", "batch")]
    return emitted.groupBy("entity").agg(F.max_by(F.struct(*others), "generation").alias("s")).select("entity", "s.*")


def first_deliveries(spark: SparkSession, path: str, schema: str, key: str, checkpoint: str, out: str) -> None:
    """Keyed idempotency on a stream: the first row of each key; state grows with the keys."""
    rows = source(spark, path, schema).dropDuplicates([key])

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drain(spark, rows, checkpoint, handle)


def with_restarts(run: Callable[[], None], budget: int) -> int:
    """Run a worker's loop again after an error, at most ``budget`` times; the failed batch is replayed.  Returns the restarts used."""
    for used in range(budget + 1):
        try:
            run()
            return used
        except Exception:
            if used == budget:
                raise
    return budget


def committed(spark: SparkSession, path: str, schema: str, checkpoint: str, out: str) -> None:
    """Rows (``marker = 'row'``) of batches whose commit marker has come, from whatever file; markers never show.

    A join of the stream with itself: rows wait in its state for their batch's marker.
    """
    frames = source(spark, path, schema)
    done = source(spark, path, schema).where("marker = 'commit'").select("batch")
    rows = frames.where("marker = 'row'").join(done, "batch").drop("marker")

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/delivery={number}")

    drain(spark, rows, checkpoint, handle)
