"""Nearest neighbours by inner product with a vantage-point tree for each shard.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, which turns the largest inner product
into the least Euclidean distance, so that the triangle inequality can prune.  A subtree is skipped when
``factor`` times its lower bound exceeds the distance to the k-th best so far by more than rounding can make; factor 1 is
exact search, larger factors skip more.  Distances are roots of differences of squares near M^2, so rounding moves small ones
by about 1e-8 M for each root of a dimension.

Shards hold about ``shard_rows`` vectors by a hash of the id; each shard's tree is one row and is sent to ``LANES`` tasks.  Queries are
packed in blocks of about ``block``, which are sent to every shard's tree; a shard returns k rows for each query and the best k of all stay.
Scores are plain sums over the original components in double precision, in order, so that equal vectors get
equal scores; ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; rows that repeat id and vector count once; queries only meet vectors of their own dimension; an empty table gives
an empty result.  Only the id and vector columns are read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import materialize

LEAF = 256
#: A shard's queries are dealt to so many tasks, each of which is sent its tree.
LANES = 4


class Tree:
    """A vantage-point tree over rows of ``points``; children keep the range of distances to their vantage point."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, top: float):
        self.ids, self.points, self.top = ids, points, top
        self._lift()
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _lift(self) -> None:
        rest = np.sqrt(np.maximum(self.top * self.top - np.einsum("ij,ij->i", self.points, self.points), 0))
        self.lifted = np.column_stack([self.points, rest])

    def __getstate__(self):
        """Without what can be computed again; single precision where that is all there is."""
        single = self.points.astype(np.float32)
        points = single if np.array_equal(single, self.points) else self.points
        return self.ids, points, self.top, self.nodes, self.root

    def __setstate__(self, state) -> None:
        self.ids, points, self.top, self.nodes, self.root = state
        self.points = points.astype(float)
        self._lift()

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            self.nodes[at] = (rows,)
            return at
        pivot, others = rows[0], rows[1:]
        far = np.sqrt(((self.lifted[others] - self.lifted[pivot]) ** 2).sum(1))
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        children = []
        for part in (order[:half], order[half:]):
            children.append((far[part[0]], far[part[-1]], self._build(others[part])))
        self.nodes[at] = (pivot, *children)
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        """(scores, ids), each (queries, k), best first; -inf and -1 where fewer are there."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.q, self.own, self.k, self.factor = queries, own, k, factor
        self.unit = np.column_stack([queries / norms[:, None] * self.top, np.zeros(len(queries))])
        self.norms = norms
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), -1, np.int64)
        self.reach = np.full(len(queries), np.inf)
        self._visit(self.root, np.arange(len(queries)), np.zeros(len(queries)))
        return self.best, self.who

    def _visit(self, at: int, active: np.ndarray, bound: np.ndarray) -> None:
        slack = self.top * max(1e-6, 1e-7 * math.sqrt(self.points.shape[1]))
        active = active[bound * self.factor <= self.reach[active] * (1 + 1e-9) + slack]
        if not len(active):
            return
        node = self.nodes[at]
        if len(node) == 1:
            self._offer(active, node[0])
            return
        pivot, inner, outer = node
        self._offer(active, np.array([pivot]))
        d = np.sqrt(np.maximum(((self.unit[active] - self.lifted[pivot]) ** 2).sum(1), 0))
        bounds = [np.maximum(0, np.maximum(d - hi, lo - d)) for lo, hi, _ in (inner, outer)]
        inner_first = d <= (inner[1] + outer[0]) / 2
        for some, order in ((inner_first, (0, 1)), (~inner_first, (1, 0))):
            for child in order:
                self._visit((inner, outer)[child][2], active[some], bounds[child][some])

    def _offer(self, active: np.ndarray, rows: np.ndarray) -> None:
        points = self.points[rows]
        rough = self.q[active] @ points.T
        slack = 1e-9 * (1 + self.norms[active] * self.top)
        hopeful = rough >= (self.best[active, -1] - slack)[:, None]
        hopeful &= self.own[active, None] != self.ids[rows][None, :]
        if hopeful.shape[1] > self.k:  # not those that k others of this leaf beat
            masked = np.where(hopeful, rough, -np.inf)
            kth = -np.partition(-masked, self.k - 1, axis=1)[:, self.k - 1]
            hopeful &= masked >= (kth - slack)[:, None]
        which, cols = np.nonzero(hopeful)
        if not len(which):
            return
        exact = np.zeros(len(which))
        a, b = self.q[active[which]], points[cols]
        for i in range(a.shape[1]):
            exact += a[:, i] * b[:, i]
        cuts = np.searchsorted(which, np.arange(len(active) + 1))
        for i in np.unique(which):
            q, own = active[i], slice(cuts[i], cuts[i + 1])
            scores = np.concatenate([self.best[q], exact[own]])
            who = np.concatenate([self.who[q], self.ids[rows[cols[own]]]])
            top = np.lexsort((who, -scores))[: self.k]
            self.best[q], self.who[q] = scores[top], who[top]
            if scores[top[-1]] > -np.inf:
                cosine = scores[top[-1]] / self.norms[q]
                self.reach[q] = math.sqrt(max(2 * self.top * (self.top - cosine), 0.0))


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    factor: float = 1.0,
    shard_rows: int = 8192,
    block: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row for which ``queries`` (over ``vec_id``) holds."""
    spark = vectors.sparkSession
    vector = F.col("vector")
    good = materialize(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(vector))
        .withColumn("dim", F.size("vector")),
        "vectors",
    )
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    n, top = good.agg(F.count(F.lit(1)), F.max(norm)).first()
    shards = max(1, -(-n // shard_rows))
    top = (top or 1.0) * (1 + 1e-12)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(rows["vector"].to_numpy())
        ids = rows["vec_id"].to_numpy(np.int64)
        _, first = np.unique(np.column_stack([ids.view(np.float64), points]).view(np.uint64), axis=0, return_index=True)
        first.sort()
        tree = pickle.dumps(Tree(ids[first], points[first], top), protocol=5)
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [tree]})

    spread = lambda salt, of: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of)).cast("int")
    trees = (
        good.withColumn("shard", spread(1, shards)).groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")
    )
    chosen = good.where(queries).dropDuplicates(["vec_id", "vector"])
    packed = (
        chosen.withColumn("block", spread(2, max(1, -(-chosen.count() // block))))
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("lane", F.pmod("block", F.lit(LANES)))
    )
    lanes = trees.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    met = packed.join(lanes.hint("merge"), ["dim", "shard", "lane"])

    def run(batches):
        held, read = None, None
        for batch in batches:
            for tree, asked in zip(batch["tree"], batch["queries"]):
                if tree != held:
                    held, read = tree, pickle.loads(tree)
                own = np.array([q["vec_id"] for q in asked], np.int64)
                best, who = read.search(np.stack([q["vector"] for q in asked]).astype(float), own, k, factor)
                yield pd.DataFrame({"query_id": np.repeat(own, k), "vec_id": who.ravel(), "score": best.ravel()})[
                    lambda x: x["score"] > -np.inf
                ]

    found = met.select("queries", "tree").mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
