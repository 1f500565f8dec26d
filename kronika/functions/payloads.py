"""Payload versions, decoding, length-delimited keys and digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Upcasts:
    """Steps that lift a payload from one version to the next, by kind."""

    def __init__(self) -> None:
        self.steps: dict[tuple[int, int], Callable[[Column], Column]] = {}

    def add(self, kind: int, from_version: int, step: Callable[[Column], Column]) -> "Upcasts":
        if (kind, from_version) in self.steps:
            raise ValueError(f"two steps lift kind {kind:#x} from version {from_version}")
        self.steps[kind, from_version] = step
        return self

    def chain(self, kind: int, stored: int, current: int) -> list[Callable[[Column], Column]]:
        """Steps from ``stored`` to ``current``; version 0 is decoded as it is."""
        if stored > current:
            raise ValueError(f"version {stored} of kind {kind:#x} is newer than {current}")
        if stored in (0, current):
            return []
        missing = [v for v in range(stored, current) if (kind, v) not in self.steps]
        if missing:
            raise ValueError(f"no step lifts kind {kind:#x} from version {missing[0]}")
        return [self.steps[kind, v] for v in range(stored, current)]

    def apply(self, kind: int, current: int, version: Column, payload: Column) -> Column:
        """The payload at ``current``; null where the stored version is newer."""
        lifted = F.when(version.isin(0, current), payload)
        for stored in range(1, current):
            value = payload
            for step in self.chain(kind, stored, current):
                value = step(value)
            lifted = lifted.when(version == stored, value)
        return lifted


def version_state(version: Column, current: int) -> Column:
    return (
        F.when(version.isin(0, current), "current").when(version > current, "future_version").otherwise("upcast")
    )


def delimited(*parts: Column) -> Column:
    """Each part after its length in bytes, so that no two lists of parts read alike."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))


def operation_key(domain: str, *parts: Column) -> Column:
    """The first 16 bytes, in hex, of a hash over domain and parts."""
    return F.substring(F.sha2(delimited(F.lit(domain), *parts), 256), 1, 32)


def digest_of(value: Column, order: Column) -> Column:
    """SHA-256 over a group's values joined in order (an aggregate)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.sha2(F.concat_ws("|", F.transform(rows, lambda r: r["v"])), 256)


def with_json(journal: DataFrame, schema: str, column: str = "payload") -> DataFrame:
    return journal.withColumn("decoded", F.from_json(F.col(column), schema))
