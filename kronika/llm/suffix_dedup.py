"""Removal of long repeated strings by distributed prefix doubling over sampled suffixes.

Every byte that lies in a string of ``length`` bytes which also starts earlier (in a smaller document, or earlier in the same)
is removed.  Suffixes are ranked by growing prefixes and drop out as soon as they are unique.

Ranking every byte's suffix would shuffle many times the input, so the first ranks are those of sampled suffixes: of each
string of ``length`` bytes the one whose first ``SEED`` bytes hash least, which equal strings choose alike.  A sample stands for
the run of strings that choose it.

1. Samples are ranked by their ``SEED`` bytes; those unique in the corpus drop out.
2. The others are ranked by all bytes of their run.  All but the earliest of a rank repeat it whole and are decided.
3. The earliest of each rank are decided, too, if no other rank shares their seed.  What is left are edges of
   repeats: there each string's suffix is ranked by a quarter, half and all of ``length`` bytes, sorted by pairs of the rank so far and the next
   part's; unique ones drop out each time, and at full length all but the earliest are removed.

Ranks are 64-bit hashes of the bytes, compared within the rank before; at full length two independent ones.  A task decides at
once samples that repeat an earlier run of its own, which pre-aggregates frequent passages.  What is left of its samples travels
packed, by cell of the seed; a seed with many different runs in a task is frequent and its runs travel as rows, as the
strings of seeds with more than ``FREQUENT_RANKS`` ranks do, so that no seed is held by one task.

Defined results: null texts are empty; texts shorter than ``length`` bytes lose nothing; a null id sorts first; rows that share an
id, or have none, count as one document for what is earlier (by the place in their text), and an exact repeat of a row loses no more
than the row; of texts of any length only the sampled runs are held; an empty table gives an empty
result.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed, powers
from .storage import materialize, small_batches

SEED = 32
#: Bytes that are worked on at once.
CHUNK = 1 << 20
#: Runs of one seed that are ranked in one task, in under 100 MB; the strings of more of them are ranked as rows.
FREQUENT_RANKS = 20_000
NO_ID = -(1 << 63)
_random = np.random.default_rng(77)
VALUE = _random.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Bytes:
    """Hashes of any slices of a run of bytes, from prefix sums of a polynomial."""

    _up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, data: bytes, which: int = 0):
        n = len(data) + 1
        if len(Bytes._up) < n:
            Bytes._up, Bytes._down = powers(BASE, n), powers(INVERSE, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(VALUE[which][np.frombuffer(data, np.uint8)] * Bytes._up[: n - 1], out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * Bytes._down[start] + (stop - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of all slices of ``width``."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * Bytes._down[:n] + np.uint64(width))


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` the place of its least hash, the leftmost of equals (by the upper half)."""
    n = len(hashes)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    padded = padded.reshape(rows, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def sampled_runs(data: bytes, length: int):
    """(first string, last string, seed hash, hash of the run with its sample's place) of each run."""
    hashed = Bytes(data)
    seeds = hashed.every(SEED)
    chosen = sliding_argmin(seeds, length - SEED + 1)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    last = np.append(first[1:], len(chosen)) - 1
    at = chosen[first]
    whole = hashed.slices(first, last + length) + mixed((at - first).astype(np.uint64))
    return first, last, seeds[at].view(np.int64), mixed(whole).view(np.int64)


def chunks(text: bytes, length: int):
    """(offset, bytes): each string of ``length`` bytes lies in exactly one."""
    for i in range(0, max(len(text) - length + 1, 0), CHUNK):
        yield i, text[i : i + CHUNK + length - 1]


#: A seed with so many different runs in one task is frequent: its runs travel as rows, which any number of tasks can share.
FREQUENT = 8
#: Sampled runs that a task ranks by seed, about, and cells that make up its share, so that shares come out even.
TASK_RUNS, CELLS = 400_000, 16


def variant_of(text: bytes) -> int:
    """Tells texts of one id apart; with 64 bits of a digest, as millions of rows may share an id or have none."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


class Found:
    """The sampled runs of one task, as arrays."""

    NAMES = ("g", "c", "doc", "variant", "p", "span")
    KINDS = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: int, text: bytes, length: int) -> None:
        variant = variant_of(text)
        for offset, data in chunks(text, length):
            first, last, g, c = sampled_runs(data, length)
            same = np.full((2, len(g)), [[doc], [variant]])
            self.parts.append((g, c, *same, (first + offset).astype(np.int32), (last - first).astype(np.int32)))

    def size(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def split(self, length: int):
        """(rows decided, rows of frequent seeds, all other rows, seeds that are frequent)."""
        runs = [np.concatenate(x) for x in zip(*self.parts)]
        g, c, doc, variant, p, span = runs
        order = np.lexsort((p, doc, c, g))
        g, c, doc, variant, p, span = (x[order] for x in runs)
        again = np.append(False, (g[1:] == g[:-1]) & (c[1:] == c[:-1]))
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(g))))
        later = again & ((doc != doc[lead]) | (p != p[lead]))
        decided = joined_runs(*(x[later] for x in (doc, variant, p, span)))
        rest = [x[~later] for x in (g, c, doc, variant, p, span)]
        seeds, place, times = np.unique(rest[0], return_inverse=True, return_counts=True)
        many = times >= FREQUENT
        hot = many[place]
        return decided, tuple(x[hot] for x in rest), tuple(x[~hot] for x in rest), seeds[many]


def joined_runs(doc: np.ndarray, variant: np.ndarray, p: np.ndarray, span: np.ndarray):
    """Runs that follow each other in one text as one."""
    order = np.lexsort((p, variant, doc))
    doc, variant, p, span = (x[order].astype(np.int64) for x in (doc, variant, p, span))
    if not len(doc):
        return doc, variant, p, span
    new = np.append(True, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]) | (p[1:] > p[:-1] + span[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], variant[first], p[first], p[last] + span[last] - p[first]


ROW = "kind int, cell int, g long, c long, doc long, variant long, p long, span long, packed binary"
PACKED, NOTICE, FREQUENT_RUN, DECIDED = range(4)


def as_batch(schema: str, **columns) -> pa.RecordBatch:
    """Columns in the order of ``schema``, of its types whatever they hold; those not given are null."""
    n = max(map(len, columns.values()))
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrays = [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def rows_of(kind: int, n: int, **columns) -> pa.RecordBatch:
    return as_batch(ROW, kind=np.full(n, kind, np.int32), **columns)


def sampled(docs: DataFrame, length: int, cells: int) -> DataFrame:
    """``ROW``: a task's sampled runs, packed by cell of their seed, those it has decided, and those of frequent seeds.

    For a frequent seed its cell gets a notice, so that it knows that other runs share the seed.
    """

    def cell_of(g: np.ndarray) -> np.ndarray:
        return (mixed(g.view(np.uint64)) % np.uint64(cells)).astype(np.int32)

    def emitted(found: Found):
        decided, hot, rest, seeds = found.split(length)
        spread = lambda x: (mixed(x.view(np.uint64)) % np.uint64(cells)).astype(np.int32)
        yield rows_of(DECIDED, len(decided[0]), cell=spread(decided[1] + decided[2]), **dict(zip(Found.NAMES[2:], decided)))
        yield rows_of(FREQUENT_RUN, len(hot[0]), cell=spread(hot[1]), **dict(zip(Found.NAMES, hot)))
        yield rows_of(NOTICE, len(seeds), cell=cell_of(seeds), g=seeds)
        cell = cell_of(rest[0])
        order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[order], np.arange(cells + 1))
        blobs, where = [], []
        for i in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[i] : cuts[i + 1]]
            blobs.append(b"".join(x[own].tobytes() for x in rest))
            where.append(i)
        yield rows_of(PACKED, len(where), cell=where, packed=blobs)

    def run(batches):
        found = Found()
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.select(["doc", "text"]).columns)):
                found.add(doc, text.encode(), length)
            if found.size() > 4_000_000:
                yield from emitted(found)
                found = Found()
        if found.parts:
            yield from emitted(found)

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, ROW)


def unpacked(blob: bytes):
    widths = [np.dtype(k).itemsize for k in Found.KINDS]
    cuts = np.cumsum([0, *widths]) * (len(blob) // sum(widths))
    return tuple(np.frombuffer(blob[a:b], k) for a, b, k in zip(cuts, cuts[1:], Found.KINDS))


RUN = "g long, c long, doc long, variant long, p long, span long, decided boolean"


def living(docs: DataFrame, length: int, cells: int) -> DataFrame:
    """``RUN``: runs whose seed is not unique in the corpus."""

    def run(batches):
        packed, seeds = [], []
        for batch in batches:
            own = batch["kind"].to_numpy()
            packed += [unpacked(b) for b in batch["packed"].drop_null().to_pylist()]
            seeds += batch["g"].filter(pa.array(own == NOTICE)).to_pylist()
            passing = batch.filter(pa.array((own == FREQUENT_RUN) | (own == DECIDED)))
            if len(passing):
                decided = passing["kind"].to_numpy() == DECIDED
                yield as_batch(RUN, **{n: passing[n] for n in Found.NAMES}, decided=decided)
        if packed:
            g, c, doc, variant, p, span = map(np.concatenate, zip(*packed))
            _, place, times = np.unique(g, return_inverse=True, return_counts=True)
            keep = (times[place] > 1) | np.isin(g, np.array(seeds, np.int64))
            held = dict(zip(Found.NAMES, (x[keep] for x in (g, c, doc, variant, p.astype(np.int64), span.astype(np.int64)))))
            yield as_batch(RUN, **held, decided=np.zeros(keep.sum(), bool))

    met = sampled(docs, length, cells).repartition(cells // CELLS, "cell")
    return met.mapInArrow(run, RUN)


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """``doc, variant, g, p, span, sure, frequent`` of runs: removed whole if ``sure``, else strings to be ranked."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = CELLS * max(8, int(size * 0.03 / TASK_RUNS) + 1)
    live = materialize(living(docs, length, cells), "runs")
    open_ = live.where(~F.col("decided"))
    ranks = materialize(open_.groupBy("g", "c").agg(F.min(F.struct("doc", "p")).alias("earliest")), "ranks")
    shared = ranks.groupBy("g").agg(F.count(F.lit(1)).alias("ranks"))
    names = ["doc", "variant", "p", "g", "span", "sure", "frequent"]
    rows = (
        open_.join(ranks, ["g", "c"])
        .join(shared, "g")
        .withColumn("sure", (F.col("doc") != F.col("earliest.doc")) | (F.col("p") != F.col("earliest.p")))
        .where("sure or ranks > 1")
        .withColumn("frequent", F.col("ranks") > FREQUENT_RANKS)
    )
    decided = live.where("decided").withColumns({"sure": F.lit(True), "frequent": F.lit(False)})
    return rows.select(*names).unionByName(decided.select(*names))


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        if out and starts[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(stops[i]))
        else:
            out.append([int(starts[i]), int(stops[i])])
    return [(a, b) for a, b in out]


def summary(text: bytes, ranges: list[tuple[int, int]]) -> dict:
    kept, at = hashlib.sha256(), 0
    for a, b in ranges:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    gone = sum(b - a for a, b in ranges)
    return {"n_bytes": len(text), "n_removed": gone, "n_spans": len(ranges), "kept_sha256": kept.hexdigest()}


CONTEXT = "doc long, variant long, g long, p long, context binary, frequent boolean"
TEXT = "doc long, variant long, text binary"
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SPAN = pa.struct({"g": pa.int64(), "p": pa.int64(), "span": pa.int64(), "frequent": pa.bool_()})
#: What the first pass gives: a result, or a text that waits with its open runs and the ranges that are sure.
FIRST = pa.schema(
    {n: pa.int64() for n in ("doc", "variant", "n_bytes", "n_removed", "n_spans")}
    | {"kept_sha256": pa.string(), "text": pa.binary(), "open": pa.list_(SPAN)}
    | {"ranges": pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()}))}
)


def compressed(text: bytes) -> bytes:
    return zstandard.compress(text, 1)


def contexts(waiting: DataFrame, length: int) -> DataFrame:
    """``doc, variant, g, p, context, frequent``: the bytes of every open run."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, variant, text, spans in zip(*(batch[c].to_pylist() for c in ("doc", "variant", "text", "open"))):
                text = zstandard.decompress(text)
                for s in spans:
                    out.append((doc, variant, s["g"], s["p"], text[s["p"] : s["p"] + s["span"] + length], s["frequent"]))
            if out:
                names = [f.split()[0] for f in CONTEXT.split(", ")]
                yield as_batch(CONTEXT, **dict(zip(names, zip(*out))))

    return waiting.select("doc", "variant", "text", "open").mapInArrow(run, CONTEXT)


def every_string(rows: pd.DataFrame, length: int):
    """(index of its row, first byte, Bytes) of all strings of the rows' contexts, in order."""
    sizes = rows["context"].map(len).to_numpy(np.int64)
    counts = sizes - length + 1
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    return row, at, at - starts[row], b"".join(rows["context"])


def later_strings(rows: DataFrame, length: int) -> DataFrame:
    """``doc, variant, a, b``: ranges of strings that also start earlier, for runs of seeds that one task can hold.

    Rows come sorted by seed, document and place; a task works on whole seeds, a batch of them at a time.
    """
    cuts = [length * i // 4 for i in range(5)]

    def ranked(rows: pd.DataFrame) -> pd.DataFrame:
        row, at, inside, data = every_string(rows, length)
        doc, p = rows["doc"].to_numpy()[row], rows["p"].to_numpy()[row] + inside
        left = np.arange(len(at))
        hashed = Bytes(data)
        rank = rows["g"].to_numpy()[row]
        for quarter in range(4):  # prefixes grow; unique ones drop out
            part = hashed.slices(at[left] + cuts[quarter], at[left] + cuts[quarter + 1])
            rank = mixed(rank.view(np.uint64) * BASE + part).view(np.int64)
            if quarter % 2:
                _, group, times = np.unique(rank, return_inverse=True, return_counts=True)
                left, rank = left[times[group] > 1], rank[times[group] > 1]
        check = Bytes(data, 1).slices(at[left], at[left] + length).view(np.int64)
        order = np.lexsort((p[left], doc[left], check, rank))
        left, rank, check = left[order], rank[order], check[order]
        again = np.append(False, (rank[1:] == rank[:-1]) & (check[1:] == check[:-1])) if len(left) else np.empty(0, bool)
        lead = left[np.maximum.accumulate(np.where(again, 0, np.arange(len(left))))] if len(left) else left
        gone = np.sort(left[again & ((doc[left] != doc[lead]) | (p[left] != p[lead]))])
        if not len(gone):
            return pd.DataFrame({"doc": [], "variant": [], "a": [], "b": []})
        new = np.append(True, (row[gone[1:]] != row[gone[:-1]]) | (gone[1:] != gone[:-1] + 1))
        first, last = gone[new], gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
        return pd.DataFrame({"doc": doc[first], "variant": rows["variant"].to_numpy()[row[first]], "a": p[first], "b": p[last] + length})

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < 4000 or batch["g"].iloc[0] == batch["g"].iloc[-1]:
                continue
            rows = pd.concat(held, ignore_index=True)
            whole = rows["g"] != rows["g"].iloc[-1]
            held = [rows[~whole]]
            yield ranked(rows[whole].reset_index(drop=True))
        if held:
            yield ranked(pd.concat(held, ignore_index=True))

    return (
        rows.select("doc", "variant", "g", "p", "context")
        .repartition("g")
        .sortWithinPartitions("g", "doc", "p")
        .mapInPandas(run, "doc long, variant long, a long, b long")
    )


def later_rows(rows: DataFrame, length: int) -> DataFrame:
    """The same for seeds that occur in very many runs: every string is a row, and prefixes double by sorts."""
    cuts = [length * i // 4 for i in range(5)]

    def quarters(batches):
        for batch in batches:
            if not len(batch):
                continue
            row, at, inside, data = every_string(batch, length)
            hashed = Bytes(data)
            parts = {f"q{i}": hashed.slices(at + cuts[i], at + cuts[i + 1]).view(np.int64) for i in range(4)}
            check = Bytes(data, 1).slices(at, at + length).view(np.int64)
            yield pd.DataFrame({"doc": batch["doc"].to_numpy()[row], "variant": batch["variant"].to_numpy()[row], "p": batch["p"].to_numpy()[row] + inside, **parts, "check": check})

    rows = rows.select("doc", "variant", "p", "context").mapInPandas(
        quarters, "doc long, variant long, p long, q0 long, q1 long, q2 long, q3 long, check long"
    )
    for prefix in (["q0"], ["q0", "q1"]):
        times = rows.groupBy(prefix).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
        rows = rows.join(times.drop("times"), prefix, "left_semi")
    whole = ["q0", "q1", "q2", "q3", "check"]
    earliest = rows.groupBy(whole).agg(F.min(F.struct("doc", "p")).alias("earliest"), F.count(F.lit(1)).alias("times"))
    later = rows.join(earliest.where("times > 1"), whole).where("doc <> earliest.doc or p <> earliest.p")
    return later.select("doc", "variant", F.col("p").alias("a"), (F.col("p") + length).alias("b"))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    if length < SEED + 4:
        raise ValueError(f"length must be at least {SEED + 4}")
    small_batches(docs.sparkSession)
    docs = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    found = repeats(docs, length)
    listed = found.groupBy("doc", "variant").agg(
        F.collect_list(F.when(F.col("sure"), F.struct("p", "span"))).alias("sure"),
        F.collect_list(F.when(~F.col("sure"), F.struct("g", "p", "span", "frequent"))).alias("open"),
    )

    def keyed(batches):
        for batch in batches:
            texts = [t.encode() for t in batch["text"].to_pylist()]
            yield as_batch(TEXT, doc=batch["doc"], variant=[*map(variant_of, texts)], text=[*map(compressed, texts)])

    def first_pass(batches):
        for batch in batches:
            rows = []
            for text, sure, open_ in zip(*(batch[c].to_pylist() for c in ("text", "sure", "open"))):
                p, span = (np.array([s[x] for s in sure or ()], np.int64) for x in ("p", "span"))
                ranges = merged(p, p + span + length)
                if open_:
                    rows.append({"text": text, "open": open_, "ranges": [{"a": a, "b": b} for a, b in ranges]})
                else:
                    rows.append(summary(zstandard.decompress(text), ranges))
            fields = list(FIRST)
            found = [pa.array([r.get(f.name) for r in rows], f.type) for f in fields[2:]]
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["variant"], *found], schema=FIRST)

    texts = docs.select("doc", "text").mapInArrow(keyed, TEXT)
    met = texts.join(listed, ["doc", "variant"], "left").select("doc", "variant", "text", "sure", "open")
    state = materialize(
        met.mapInArrow(
            first_pass,
            f"doc long, variant long, {RESULT}, text binary, "
            "open array<struct<g:long,p:long,span:long,frequent:boolean>>, ranges array<struct<a:long,b:long>>",
        ),
        "first-pass",
    )
    waiting = state.where("text is not null")
    strings = materialize(contexts(waiting, length), "contexts")
    gone = later_strings(strings.where("not frequent"), length).unionByName(later_rows(strings.where("frequent"), length))
    later = gone.groupBy("doc", "variant").agg(F.collect_list(F.struct("a", "b")).alias("later"))

    def second_pass(batches):
        for batch in batches:
            rows = []
            for text, ranges, later in zip(*(batch[c].to_pylist() for c in ("text", "ranges", "later"))):
                a, b = (np.array([r[x] for r in (*ranges, *(later or ()))], np.int64) for x in "ab")
                rows.append(summary(zstandard.decompress(text), merged(a, b)))
            yield as_batch(f"doc long, {RESULT}", doc=batch["doc"], **{c: [r[c] for r in rows] for c in columns[1:]})

    columns = ["doc", *(c.split()[0] for c in RESULT.split(", "))]
    settled = waiting.select("doc", "variant", "text", "ranges").join(later, ["doc", "variant"], "left")
    result = (
        state.where("text is null")
        .select(*columns)
        .unionByName(settled.select("doc", "text", "ranges", "later").mapInArrow(second_pass, f"doc long, {RESULT}"))
    )
    return result.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), *columns[1:])
