"""What is decided about batches before they are written, and reports on what was written or read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import first_of
from ..functions.payloads import digest_of


def batch_verdicts(items: DataFrame, most_items: int, most_bytes: int) -> DataFrame:
    """First problem of each atomic batch (``batch, nth, bytes, cas, prior``): too many items, too many bytes, a compare-and-set inside,
    or a cause that is not an earlier item of the batch (``prior`` is that item's ``nth``, or null)."""
    counts = items.groupBy("batch").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("bytes").alias("bytes"),
        F.max("cas").alias("any_cas"),
        F.max(F.coalesce((F.col("prior") >= F.col("nth")) | (F.col("prior") < 0), F.lit(False))).alias("bad_prior"),
    )
    verdict = first_of(
        ("too_many_items", F.col("items") > most_items),
        ("too_many_bytes", F.col("bytes") > most_bytes),
        ("cas_in_batch", F.col("any_cas")),
        ("bad_prior_item", F.col("bad_prior")),
    )
    return counts.select("batch", "items", "bytes", F.coalesce(verdict, F.lit("commit")).alias("verdict"))


def prior_causes(items: DataFrame) -> DataFrame:
    """Items with the id of the earlier item of their batch that causes them: an equi-join on batch and place."""
    earlier = items.select("batch", F.col("nth").alias("prior"), F.col("event_id").alias("causation_id"))
    return items.join(earlier, ["batch", "prior"], "left").select("batch", "nth", "event_id", "causation_id")


def staged(items: DataFrame) -> DataFrame:
    """An outbox's flush: staged items in order as one batch, numbered from 0; an empty outbox makes no batch."""
    return items.select("outbox", F.posexplode("staged").alias("nth", "payload"))


def covers(frontier: Column, sequence: Column) -> Column:
    """Whether a watermark has come as far as ``sequence``: what a waiter would wait for."""
    return F.coalesce(frontier >= sequence, F.lit(False))


def projection_run(state: DataFrame, source: DataFrame, key: str, columns: tuple[str, ...], cached_watermark: int) -> DataFrame:
    """One row of evidence on a projection's run: rows read, watermark, cache status, freshness, digest of the output."""
    read = source.agg(F.count(F.lit(1)).alias("source_rows"), F.max("global_sequence").alias("watermark"))
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in (key, *columns)))
    out = state.agg(F.count(F.lit(1)).alias("output_rows"), F.bit_xor(F.xxhash64(line)).alias("output_hash"))
    status = F.when(F.col("watermark") == cached_watermark, "hit").when(F.col("watermark") > cached_watermark, "stale").otherwise("ahead")
    return read.join(F.broadcast(out)).withColumn("cache_status", status)


def copy_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How each segment of a snapshot or fork came over (``segment, digest``): copied, changed, missing or extra."""
    one = before.select("segment", F.col("digest").alias("d1"), F.lit(True).alias("in_before"))
    two = after.select("segment", F.col("digest").alias("d2"), F.lit(True).alias("in_after"))
    state = (
        F.when(F.col("in_after").isNull(), "missing").when(F.col("in_before").isNull(), "extra").when(F.col("d1").eqNullSafe(F.col("d2")), "copied").otherwise("changed")
    )
    return one.join(two, "segment", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("segments"))


def envelopes(bodies: DataFrame, signatures: DataFrame) -> DataFrame:
    """Identity and findings of artifact envelopes.

    ``bodies``: artifact, body, claimed_body_hash; ``signatures``: artifact, signer, verdict (supplied).  The envelope's hash covers body hash and signers.
    """
    signed = signatures.groupBy("artifact").agg(
        digest_of(F.col("signer"), F.col("signer")).alias("signers_hash"),
        F.count_if(F.col("verdict") != "valid").alias("bad_signatures"),
        F.count(F.lit(1)).alias("signatures"),
    )
    own = F.sha2("body", 256)
    finding = first_of(
        ("body_hash_mismatch", own != F.col("claimed_body_hash")),
        ("unsigned", F.col("signatures").isNull()),
        ("invalid_signature", F.col("bad_signatures") > 0),
    )
    return bodies.join(signed, "artifact", "left").select(
        "artifact",
        own.alias("body_hash"),
        F.sha2(F.concat(own, F.coalesce("signers_hash", F.lit(""))), 256).alias("envelope_hash"),
        finding.alias("finding"),
    )


def checked_transitions(new: DataFrame, allowed: DataFrame) -> DataFrame:
    """``new`` with ``verdict``: what a write of a transition (``machine, from_state, to_state``) would be told.

    ``allowed`` (``machine, from_state, to_state``) is a registry's edges.
    """
    edges = allowed.distinct().withColumn("known", F.lit(True))
    machines = allowed.select("machine").distinct().withColumn("known_machine", F.lit(True))
    met = new.join(edges, ["machine", "from_state", "to_state"], "left").join(machines, "machine", "left")
    verdict = F.when(F.col("known"), "accepted").when(F.col("known_machine"), "forbidden_edge").otherwise("unknown_machine")
    return met.withColumn("verdict", verdict).drop("known", "known_machine")
