"""Texts of very different lengths, some at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters, or one longer text, so that memory stays bounded."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    yield slice(start, len(texts))


def small(batches: Iterable[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of about ``most`` bytes of a text column, or one longer text; parts are views, not copies."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch[column]), 0).cast(pa.int64())).to_numpy()
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = max(int(ends.searchsorted(before + most, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together while a text column has no more than ``most`` bytes, for work with a cost of its own a batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch[column])).as_py() or 0
        if held and size + own > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Returns memory that Arrow and the C library hold free, at the end of a task: a worker keeps it while it waits for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
