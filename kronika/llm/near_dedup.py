"""MinHash near-dedup with an LSH forest.

A document is the set of its distinct word shingles.  Documents with equal sets are one node.  Each of ``TREES`` trees orders the
nodes by the signature, read from another place on; nodes whose orders share a prefix are a region.  Regions of at most ``REGION``
nodes give all their pairs; in larger ones every node is paired with the region's least node and with its centre, and the region is
split again by a prefix twice as long, so that depth adapts to how crowded a place is.  The centre is the node nearest to the
values that most nodes of the region share: among near copies the text that they were made from, with which each links though
two copies may not.  Pairs that are similar enough by their signatures are confirmed on the full sets, and links give components.
Where crowded regions of the first level then still have nodes of several components, these nodes meet by their rarest shingles:
two sets that link share one of few, so that nodes with a common template and an own rest do not meet.

At similarity 0.85 a link shares no prefix of three in any of 21 trees with probability 2e-9 (0.8: 3e-7); the cut on
signatures lies 4.5 standard deviations below the threshold.  Nothing is capped: two nodes that meet in a region of the first level,
however crowded, and link are compared or were already in one component.  Only nodes of different components that share one of their rare
shingles are compared pair by pair, the many that share the same one block by block.

Sets hold 64-bit hashes of shingles.

Defined results: a row without an id belongs to the component of the rows with its set that have one, and does not stay; where
none has, it links with nothing, its component is null and it stays; documents without words or text have an empty set, link with nothing and stay; with fewer words than a
shingle has, the whole sequence is the one shingle; rows that repeat an id with another text tie that text to the id;
an empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import minhash, mixed, shingle_sets
from .storage import materialize, small_batches
from .texts import give_back, slices, small

HASHES, DEPTH, TREES, REGION = 128, 3, 21, 32
#: Nodes of a block of a crowded region; two blocks are compared at a time.
BLOCK = 1024
#: Shingles compared at once.
COLUMNS = 4096
#: Counts of shingles in crowded regions, by hash: shingles of one bucket count as one (at most 16 MB to the driver).
BUCKETS, SLOT = 1 << 20, 1 << 12
#: Up to so many crowded regions, counted, their common signatures are broadcast (10 MB); more of them are joined by sort-merge.
BROADCAST_REGIONS = 20_000
#: Regions whose votes a task holds at once.
HELD_REGIONS = 20_000
#: Up to so many ids of candidates, counted, are broadcast to the scan of texts; more of them are joined by sort-merge.
BROADCAST_IDS = 1_000_000


def sets_of(batch: pd.DataFrame, width: int) -> list[np.ndarray]:
    texts = [t or "" for t in batch["text"]]
    out: list[np.ndarray] = []
    for part in slices(texts):
        out += shingle_sets(texts[part], width)
    return out


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, set_key, sig``; an empty set has neither key nor signature."""

    def run(batches):
        for batch in small(batches, "text"):
            sets = shingle_sets([t or "" for t in batch["text"].to_pylist()], width)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            sigs = [minhash(s, HASHES).tobytes() if len(s) else None for s in sets]
            columns = [pa.array([*map(len, sets)], pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], ["id", "n", "set_key", "sig"])
        give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, n long, set_key string, sig binary")


def prefix_keys(sigs: np.ndarray, tree: np.ndarray | int, depth: int) -> np.ndarray:
    """One key for the first ``depth`` values of each row of ``sigs`` in the order of its tree."""
    at = (np.asarray(tree)[..., None] * DEPTH + np.arange(depth)) % HASHES
    values = sigs[:, at] if np.ndim(tree) == 0 else np.take_along_axis(sigs, at, 1)
    key = mixed(np.broadcast_to(np.asarray(tree, np.uint64) + np.uint64(1000 * depth), len(sigs)).copy())
    for i in range(depth):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, i].astype(np.uint64))
    return key.view(np.int64)


def as_matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)


def first_level(nodes: DataFrame) -> DataFrame:
    """``id, tree, key`` of every node in every tree."""

    def run(batches):
        for batch in batches:
            sigs = as_matrix(batch["sig"])
            for tree in range(TREES):
                yield pd.DataFrame({"id": batch["id"], "tree": tree, "key": prefix_keys(sigs, tree, DEPTH)})

    return nodes.select("id", "sig").mapInPandas(run, "id long, tree int, key long")


def crowded_nodes(crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, sig, trees, keys``: one row a node with all its crowded regions (``id, tree, key``), however many they are."""
    of_node = F.sort_array(F.collect_list(F.struct("tree", "key"))).alias("places")
    placed = crowded.groupBy("id").agg(of_node).join(nodes.select("id", "sig"), "id")
    return materialize(placed.select("id", "sig", F.col("places.tree").alias("trees"), F.col("places.key").alias("keys")), "crowded")


def next_level(placed: DataFrame, depth: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows, trees = np.repeat(np.arange(len(batch)), batch["trees"].map(len)), np.concatenate(batch["trees"].to_list())
            keys = prefix_keys(as_matrix(batch["sig"])[rows], trees, depth)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[rows], "tree": trees, "key": keys})

    return placed.select("id", "sig", "trees").mapInPandas(run, "id long, tree int, key long")


def cast(held: dict, key: int, values: np.ndarray, votes: np.ndarray) -> None:
    """Adds votes for values, place by place: equal ones add up, others cancel, so that a majority is what remains."""
    if key not in held:
        held[key] = values, votes
        return
    had, n = held[key]
    left = np.where(had == values, n + votes, n - votes)
    held[key] = np.where(left < 0, values, had), np.abs(left)


def polled(held: dict) -> pd.DataFrame:
    values, votes = ([x[i].tobytes() for x in held.values()] for i in (0, 1))
    return pd.DataFrame({"key": [*held], "common": values, "votes": votes})


def common_signatures(crowded: DataFrame) -> DataFrame:
    """``key, common, votes``: what most nodes of each region have at each place; ``crowded`` has ``sig, keys``.

    Votes are cast within each task first, so that a region sends one row from each.
    """

    def within(batches):
        held: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            sigs = as_matrix(batch["sig"])
            keys = np.concatenate(batch["keys"].to_list())
            rows = np.repeat(np.arange(len(batch)), batch["keys"].map(len))
            order = np.argsort(keys, kind="stable")
            found, first = np.unique(keys[order], return_index=True)
            for key, own in zip(found.tolist(), np.split(order, first[1:])):
                some = sigs[rows[own]]
                middle = np.partition(some, len(some) // 2, axis=0)[len(some) // 2]  # a majority is the median
                votes = np.maximum(2 * (some == middle).sum(0) - len(some), 0).astype(np.int32)
                cast(held, key, middle, votes)
            if len(held) > HELD_REGIONS:
                yield polled(held)
                held = {}
        yield polled(held)

    def across(batches):
        held: dict = {}
        for batch in batches:
            for key, values, votes in zip(batch["key"], batch["common"], batch["votes"]):
                cast(held, key, np.frombuffer(values, np.uint32), np.frombuffer(votes, np.int32))
        yield polled(held)

    schema = "key long, common binary, votes binary"
    return crowded.select("sig", "keys").mapInPandas(within, schema).repartition("key").mapInPandas(across, schema)


def to_centres(crowded: DataFrame, placed: DataFrame) -> DataFrame:
    """``a, b``: each node of crowded regions (``id, key``) with the node nearest to its region's common signature."""

    def agreement(batches):
        for batch in batches:
            alike = (as_matrix(batch["sig"]) == as_matrix(batch["common"])).sum(1) if len(batch) else np.empty(0, int)
            yield pd.DataFrame({"key": batch["key"], "id": batch["id"], "alike": alike})

    common = materialize(common_signatures(placed), "common").select("key", "common")
    few = common.count() <= BROADCAST_REGIONS
    sized = F.broadcast if few else lambda df: df
    met = placed.select("id", "sig", F.explode("keys").alias("key")).join(sized(common), "key")
    centres = (
        met.select("key", "id", "sig", "common")
        .mapInPandas(agreement, "key long, id long, alike long")
        .groupBy("key")
        .agg(F.max(F.struct("alike", (-F.col("id")).alias("less"))).alias("best"))
        .select("key", (-F.col("best.less")).alias("centre"))
    )
    pairs = crowded.select("key", "id").join(sized(centres), "key").where("id <> centre")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` with a < b: pairs of nodes, once each, and ``key, id``: the crowded regions of the first level.

    Pairs are those of regions that are not crowded, and of crowded ones those with the least node and the centre.  Each level's are a
    table of their own: one plan of all levels would run its many stages at once, and the driver holds them all.
    """
    found: DataFrame | None = None
    first: DataFrame | None = None
    level, depth = first_level(nodes), DEPTH
    while True:
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
        regions = materialize(level.join(sizes, "key"), "regions")
        few = regions.where(F.col("size") <= REGION).select("key", "id")
        pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b")
        crowded = regions.where(F.col("size") > REGION)
        stars = crowded.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
        new = pairs.select("a", "b").unionByName(stars)
        first = crowded.select("key", "id") if first is None else first
        depth *= 2
        last = crowded.isEmpty()
        if not last:
            placed = crowded_nodes(crowded, nodes)
            new = new.unionByName(to_centres(crowded, placed))
        new = materialize(new.distinct(), "level")
        found = new if found is None else found.unionByName(new)
        if last or depth > HASHES:
            return found.distinct(), first
        level = next_level(placed, depth)


def least_alike(threshold: float) -> float:
    """The share of equal places in signatures from which on a pair is compared."""
    return threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / HASHES)


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes and signatures allow for the threshold."""
    least = least_alike(threshold)

    def run(batches):
        for batch in batches:
            alike = (as_matrix(batch["sig_a"]) == as_matrix(batch["sig_b"])).mean(1) if len(batch) else np.empty(0)
            yield batch.loc[alike >= least, ["a", "b"]]

    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9)
    rows = pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "sig_a", "sig_b")
    return rows.mapInPandas(run, "a long, b long")


def sets_by_id(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``id, hashes``: the full sets of the documents with the given ids."""

    def to_sets(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hashes": [s.tobytes() for s in sets_of(batch, width)]})
        give_back()

    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialize(docs.join(ids, "id", "left_semi").mapInPandas(to_sets, "id long, hashes binary"), "sets")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["one"], batch["two"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("one")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("two")), "b"
    )
    return rows.select("a", "b", "one", "two").mapInPandas(compare, "a long, b long")


def shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``one`` has in common with each of ``two``."""
    both = np.intersect1d(np.concatenate(one), np.concatenate(two))
    places = []
    for sets in (one, two):
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [*map(len, sets)])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        known = np.flatnonzero(both[at] == values) if len(both) else np.empty(0, int)
        known = known[np.argsort(at[known], kind="stable")]
        places.append((row[known], at[known]))
    out = np.zeros((len(one), len(two)), np.int64)
    for start in range(0, len(both), COLUMNS):
        sides = []
        for (row, at), n in zip(places, out.shape):
            own = slice(*np.searchsorted(at, (start, start + COLUMNS)))
            side = np.zeros((n, min(COLUMNS, len(both) - start)), np.float32)
            side[row[own], at[own] - start] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)  # at most COLUMNS, so exact
    return out


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``a, b``: links between the blocks ``lo`` and ``hi`` (or within one), at least one for two components that any link joins."""
    threshold = percent / 100
    sides = [rows[rows["block"] == rows[x].iloc[0]] for x in ("lo", "hi")]
    one, two = sides
    sigs = [np.ascontiguousarray(as_matrix(x["sig"]).T) for x in sides]
    alike = np.zeros((len(one), len(two)), np.uint8)
    for x, y in zip(*sigs):
        alike += x[:, None] == y
    n, m = (x["hashes"].map(len).to_numpy() // 8 for x in sides)
    c, d = one["component"].to_numpy(), two["component"].to_numpy()
    fits = (alike >= least_alike(threshold) * HASHES) & (c[:, None] != d)
    fits &= np.minimum(n[:, None], m) >= np.maximum(n[:, None], m) * (threshold - 1e-9)
    if rows["lo"].iloc[0] == rows["hi"].iloc[0]:
        fits = np.triu(fits)
    i, j = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
    if not len(i):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    both = shared(*([np.frombuffer(h, np.uint64) for h in x["hashes"].iloc[at]] for x, at in ((one, i), (two, j))))
    linked = fits[np.ix_(i, j)] & (100 * both >= percent * (n[i][:, None] + m[j] - both))
    p, q = np.nonzero(linked)
    p, q = i[p], j[q]
    joined = np.column_stack([np.minimum(c[p], d[q]), np.maximum(c[p], d[q])])
    _, first = np.unique(joined, axis=0, return_index=True)
    a, b = one["id"].to_numpy()[p[first]], two["id"].to_numpy()[q[first]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def packed(times: np.ndarray, least: int) -> pd.DataFrame:
    """``slot, buckets, times``: counts from ``least`` on."""
    found = np.flatnonzero(times >= least)
    parts = np.split(found, np.searchsorted(found, np.arange(SLOT, BUCKETS, SLOT)))
    rows = [(i, part.tobytes(), times[part].tobytes()) for i, part in enumerate(parts) if len(part)]
    return pd.DataFrame(rows, columns=["slot", "buckets", "times"])


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets the shingles of each bucket are; 1 also stands for none."""

    def within(batches):
        times = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for hashes in batch["hashes"]:
                np.add.at(times, bucket(np.frombuffer(hashes, np.uint64)), 1)
        yield packed(times, 1)

    def across(batches):
        times = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found, n in zip(batch["buckets"], batch["times"]):
                times[np.frombuffer(found, np.int64)] += np.frombuffer(n, np.int64)
        yield packed(times, 2)

    schema = "slot long, buckets binary, times binary"
    counted = sets.select("hashes").mapInPandas(within, schema).repartition("slot").mapInPandas(across, schema).toArrow()
    out = np.ones(BUCKETS, np.int64)
    for found, n in zip(counted["buckets"].to_pylist(), counted["times"].to_pylist()):
        out[np.frombuffer(found, np.int64)] = np.frombuffer(n, np.int64)
    return out


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def size_classes(most: int) -> np.ndarray:
    """The least size of each class; a class of sizes from 25 on is about a twenty-fifth wide."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 26 // 25))
    return np.array(out)


CLASSES = size_classes(1 << 40)


def rare_keys(own: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, of which it shares one with each set that it links with, and which of them are of its own size's class.

    Take all sets' shingles in one order, the rarest first.  Two sets of n and m shingles that link have at least
    o = percent * (n + m) / (100 + percent) in common, so they share one of the first n - o + 1 of the one and m - o + 1 of the other.
    Sets meet in the class of the smaller one's size, which says how many o is at least; the smaller one is at home there.
    """
    times, m = counts[bucket(own)], len(own)
    own = own[np.lexsort((own, times))]
    times = np.sort(times)
    least = -(-percent * m // 100)
    first, last = np.searchsorted(CLASSES, (least, m), "right") - 1
    out = []
    for c in range(first, last + 1):
        common = -(-percent * (max(int(CLASSES[c]), least) + m) // (100 + percent))
        rare = slice(np.searchsorted(times, 1, "right"), m - common + 1)  # a shingle of one set meets none
        out.append(mixed(own[rare] + np.uint64(c * 0x9E3779B97F4A7C15 % (1 << 64))))
    return np.concatenate(out), np.repeat([False, True], [sum(map(len, out[:-1])), len(out[-1])])


def meetings(sets: DataFrame, percent: int) -> DataFrame:
    """``key, home, id, component, size``: groups of ``sets`` (``id, component, hashes``).

    Each link between two components is in one of them, with one of its nodes at home.
    """
    counts = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches):
        for batch in batches:
            keys = [rare_keys(np.frombuffer(h, np.uint64), counts.value, percent) for h in batch["hashes"]]
            if keys:
                key, home = map(np.concatenate, zip(*keys))
                rows = np.repeat(np.arange(len(batch)), [len(k) for k, _ in keys])
                own = {name: batch[name].to_numpy()[rows] for name in ("id", "component")}
                yield pd.DataFrame({"key": key.view(np.int64), "home": home, **own})

    keyed = materialize(sets.mapInPandas(run, "key long, home boolean, id long, component long").distinct(), "rare")
    of_key = (F.count(F.lit(1)).alias("size"), F.max("home").alias("any_home"), F.min("component").alias("least"), F.max("component").alias("most"))
    sizes = keyed.groupBy("key").agg(*of_key).where("any_home and least < most").select("key", "size")
    return keyed.join(sizes, "key")


def crowded_links(crowded: DataFrame, nodes: DataFrame, groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links between different components of ``groups`` inside crowded regions (``key, id``).

    Nodes meet by their rare shingles, few of them in pairs, many in blocks.
    """
    of = groups.select(F.col("node").alias("id"), "component")
    placed = crowded.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    inside = materialize(placed.join(several, "key").select("id", "component").distinct(), "inside")
    sets = materialize(sets_by_id(inside.select("id"), docs, width).distinct().join(inside, "id"), "inside-sets")
    met = materialize(meetings(sets, percent), "met")
    few = met.where(F.col("size") <= REGION)
    one = few.select("key", F.col("id").alias("a"), F.col("component").alias("c"), F.col("home").alias("home_a"))
    two = few.select("key", F.col("id").alias("b"), F.col("component").alias("d"), F.col("home").alias("home_b"))
    pairs = one.join(two, "key").where("a < b and c <> d and (home_a or home_b)").select("a", "b").distinct()
    pairs = materialize(likely(pairs, nodes, percent / 100), "likely")
    links = confirmed(pairs, sets.select("id", "hashes"), percent)
    many = met.where(F.col("size") > REGION)
    return links if many.isEmpty() else links.unionByName(links_by_block(many, nodes, sets, percent))


def links_by_block(met: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between different components inside groups (``key, home, id, component``).

    A component that fills a block has blocks of its own, which do not meet each other; all others meet in pairs, one of them at home.
    """
    counted = materialize(met.groupBy("key", "home", "component").agg(F.count(F.lit(1)).alias("own")), "counted")
    rest = F.sum(F.when(F.col("own") < BLOCK, F.col("own")).otherwise(0)).alias("rest")
    parts = counted.join(counted.groupBy("key", "home").agg(rest), ["key", "home"])
    full = F.col("own") >= BLOCK
    some = F.pmod(F.xxhash64("id"), F.ceil(F.when(full, F.col("own")).otherwise(F.col("rest")) / BLOCK))
    dealt = met.join(parts, ["key", "home", "component"]).select(
        "key",
        "home",
        "id",
        "component",
        F.when(full, F.col("component")).alias("alone"),
        F.when(full, F.xxhash64("component", "home", some)).otherwise(2 * some + F.col("home").cast("int")).alias("block"),
    )
    dealt = materialize(dealt, "dealt")
    blocks = dealt.select("key", "block", "alone", "home").distinct()
    one = blocks.select("key", F.col("block").alias("lo"), F.col("alone").alias("alone_lo"), F.col("home").alias("home_lo"))
    two = blocks.select("key", F.col("block").alias("hi"), F.col("alone").alias("alone_hi"), F.col("home").alias("home_hi"))
    apart = "(alone_lo is null or alone_hi is null or alone_lo <> alone_hi)"
    meet = one.join(two, "key").where(f"lo <= hi and (home_lo or home_hi) and {apart}")
    meet = meet.select("key", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    held = nodes.select("id", "sig").join(sets.select("id", "hashes"), "id")
    rows = dealt.join(meet, ["key", "block"]).select("key", "id", "component", "block", "lo", "hi").join(held, "id")
    return rows.groupBy("key", "lo", "hi").applyInPandas(lambda x: block_links(x, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; the least id of a component stays."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = materialize(signed(docs, width), "signatures")
    of_set = every.where("set_key is not null").groupBy("set_key")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n", "sig")).alias("least")
    nodes = materialize(of_set.agg(first).select("set_key", "least.id", "least.n", "least.sig"), "nodes")
    known = nodes.where("id is not null")
    found, crowded = candidates(known)
    pairs = materialize(likely(found, known, percent / 100), "likely")
    links = materialize(confirmed(pairs, sets_by_id(ends(pairs), docs, width), percent), "links")
    groups = components(links)
    if not crowded.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = components(stars.unionByName(crowded_links(crowded, known, groups, docs, width, percent)))
    of_node = nodes.join(groups, F.col("id") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "id").alias("component_id")
    )
    joined = every.join(of_node, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
