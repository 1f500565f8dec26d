"""The journal table, and driver tables seen as journals.

A journal is one DataFrame in commit order.  Clock and previous hash come from windows over (entity, lane);
columns that a query does not use are pruned together with their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Kinds of the event types of the ``events`` table.
KINDS = {"view": 0x1001, "click": 0x1002, "signup": 0x2001, "purchase": 0x2002, "error": 0xF001}
ZERO_HASH = "0" * 64
SCHEMA = (
    "global_sequence long, event_id string, correlation_id string, causation_id string, entity string, scope string, "
    "kind int, wall_ms long, clock int, dag_lane int, dag_depth int, flags int, payload_version int, timestamp_us long, "
    "payload string, event_hash string, prev_hash string"
)


def chain_window() -> "W":
    return W.partitionBy("entity", "dag_lane").orderBy("global_sequence")


def with_chain(rows: DataFrame) -> DataFrame:
    """``clock`` (0-based per entity and lane) and ``prev_hash`` (zeros at the start)."""
    chain = chain_window()
    return rows.withColumns(
        {
            "clock": F.row_number().over(chain) - 1,
            "prev_hash": F.coalesce(F.lag("event_hash").over(chain), F.lit(ZERO_HASH)),
        }
    )


def monotone_wall(raw_ms: str = "wall_ms") -> Column:
    """Wall time that never falls within (entity, lane)."""
    return F.max(raw_ms).over(chain_window().rowsBetween(W.unboundedPreceding, 0))


def id_of(sequence: Column) -> Column:
    return F.lpad(F.lower(F.hex(sequence)), 32, "0")


def kind_of(event_type: Column) -> Column:
    kind = F.lit(0)
    for name, number in KINDS.items():
        kind = F.when(event_type == name, number).otherwise(kind)
    return kind.cast("int")


def events_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a journal: users are entities, days scopes, lanes by sequence modulo 3."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    seq = F.col("event_id")
    by_user = W.partitionBy("user_id").orderBy("event_id")
    by_day = W.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    return with_chain(
        rows.select(
            seq.alias("global_sequence"),
            id_of(seq).alias("event_id"),
            id_of(F.first("event_id").over(by_day)).alias("correlation_id"),
            id_of(F.when(seq % 4 != 0, F.lag("event_id").over(by_user))).alias("causation_id"),
            F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
            F.concat(F.lit("day:"), F.date_format("ts", "yyyy-MM-dd")).alias("scope"),
            kind_of(F.col("event_type")).alias("kind"),
            F.unix_millis(at).alias("wall_ms"),
            (seq % 3).cast("int").alias("dag_lane"),
            F.lit(0).alias("dag_depth"),
            (seq % 16).cast("int").alias("flags"),
            (seq % 4).cast("int").alias("payload_version"),
            F.unix_micros(at).alias("timestamp_us"),
            F.col("props").alias("payload"),
            "value",
            F.sha2(F.col("props"), 256).alias("event_hash"),
        )
    )


def talks_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a journal: conversations are entities, turns clocks."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("global_sequence"),
        F.sha2(F.concat_ws(":", F.lit("talk"), "conv_id", "turn"), 256).substr(1, 32).alias("event_id"),
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("entity"),
        F.concat(F.lit("role:"), "role").alias("scope"),
        F.when(F.col("role") == "user", 0x3001).when(F.col("role") == "assistant", 0x3002).otherwise(0x000F).alias("kind"),
        F.col("turn").cast("int").alias("clock"),
        F.col("text").alias("payload"),
    )


def open_journal(spark: SparkSession, path: str) -> DataFrame:
    """A stored journal; the declared schema spares inference and lets filters reach the scan."""
    return spark.read.schema(SCHEMA).parquet(path)


def _heads_folder(path: str) -> str:
    return f"{path.rstrip('/')}_heads"


def _heads_of(rows: DataFrame) -> DataFrame:
    head = F.max_by(F.struct("global_sequence", "clock", "wall_ms", "event_hash"), "global_sequence").alias("head")
    return rows.groupBy("entity", "dag_lane").agg(head)


def chain_heads(journal: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``entity, dag_lane, head`` of every chain, and the sequence up to which they were stored (-1: not yet).

    Heads are a table beside the journal; those stored last are brought up to date by the rows behind them, which is all that is
    read of the journal: the bound on the sequence reaches its scan.  So a run that ended between the two writes costs time only.
    """
    spark = journal.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_heads_folder(path))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [int(x.getName().split("=")[1]) for x in names if fs.exists(x.suffix("/_SUCCESS"))]
    upto = max(done, default=-1)
    behind = _heads_of(journal.where(F.col("global_sequence") > upto))
    if upto < 0:
        return behind, upto
    stored = spark.read.schema(behind.schema).parquet(f"{folder}/upto={upto}")
    newest = F.max_by("head", "head.global_sequence").alias("head")
    return stored.unionByName(behind).groupBy("entity", "dag_lane").agg(newest), upto


def append(journal: DataFrame | None, new: DataFrame, path: str) -> None:
    """Number ``new`` after ``journal``, chain it, and add it to ``path``.

    ``new`` has ``ordinal`` (0, 1, ... in commit order), ``entity, scope, kind, wall_ms, dag_lane, payload``.
    The write is one commit; a journal has one writer at a time.  What is read of the stored part is the table of its chains' heads and the
    rows behind it (``chain_heads``).  Rows lie by sequence, so that bounds on it skip files and row groups.
    """
    last = -1
    if journal is not None:
        heads, upto = chain_heads(journal, path)
        found = heads.agg(F.max("head.global_sequence").alias("last"), F.max(F.col("head.global_sequence") > upto).alias("behind")).first()
        last = -1 if found["last"] is None else found["last"]
        if found["behind"]:
            heads.write.mode("overwrite").parquet(f"{_heads_folder(path)}/upto={last}")
            heads, _ = chain_heads(journal, path)
    numbered = new.withColumn("global_sequence", F.col("ordinal").cast("long") + last + 1)
    fresh = numbered.withColumns({"event_id": id_of(F.col("global_sequence")), "event_hash": F.sha2(F.col("payload"), 256)})
    if journal is not None:
        fresh = fresh.join(heads, ["entity", "dag_lane"], "left")
    else:
        fresh = fresh.withColumn("head", F.lit(None).cast("struct<clock:int,wall_ms:long,event_hash:string>"))
    chain = chain_window()
    chained = fresh.withColumns(
        {
            "clock": (F.row_number().over(chain) + F.coalesce(F.col("head.clock"), F.lit(-1))).cast("int"),
            "prev_hash": F.coalesce(F.lag("event_hash").over(chain), F.col("head.event_hash"), F.lit(ZERO_HASH)),
            "wall_ms": F.greatest(F.max("wall_ms").over(chain), F.col("head.wall_ms")),
        }
    )
    fixed = {
        "correlation_id": F.col("event_id"),
        "causation_id": F.lit(None).cast("string"),
        "dag_depth": F.lit(0),
        "flags": F.lit(0),
        "payload_version": F.lit(1),
        "timestamp_us": F.col("wall_ms") * 1000,
    }
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    chained.withColumns(fixed).select(*names).sortWithinPartitions("global_sequence").write.mode("append").parquet(path)


def snapshot(journal: DataFrame, path: str, visible: int) -> DataFrame:
    """Copy what lies below the ``visible`` bound; returns counts and digest of the copy."""
    journal.where(F.col("global_sequence") < visible).write.mode("overwrite").parquet(path)
    copied = journal.sparkSession.read.parquet(path)
    return copied.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("global_sequence").alias("last_sequence"),
        F.bit_xor(F.xxhash64("global_sequence", "event_hash")).alias("digest"),
    )


def fork(journal: DataFrame, path: str, lane: int) -> DataFrame:
    """Copy the journal with every row labelled by a new lane one deeper; returns the snapshot report."""
    moved = journal.withColumns({"dag_lane": F.lit(lane), "dag_depth": F.col("dag_depth") + 1})
    return snapshot(moved, path, (1 << 62))
