"""Approximate nearest neighbours with a forest of random-projection trees.

A tree cuts the space by hyperplanes: each points from one of two randomly drawn vectors
to the other and lies at the median of the sample's projections. The planes come from a
sample of at most ``sample`` vectors (those with the smallest id hashes); every vector of the
table is then filed in its leaf of every tree. Trees are as deep as the counted table asks for, so that a leaf
holds about ``LEAF`` rows, as far as the sample can tell leaves apart. A query descends all trees; the branches it
leaves aside wait in one priority queue for all trees, ordered by the largest distance to a plane
crossed on the way, and a number of leaves that come first is searched: as many as queries drawn from the
sample need to find ``recall`` of their true neighbours in the sample. So vectors in clusters are searched in few leaves,
and only vectors without structure in many. Candidates are ranked by their exact distance to the query.

Leaves are searched branch by branch, a branch being the leaves below one node ``BRANCH`` steps down, so a query brings
back its k nearest of a branch and not of every leaf. Branches are cut into blocks of at most ``block`` vectors and queries, so a leaf may hold
any share of the table. Vectors that are null, zero, hold a null or non-finite component, have
no id, or not the commonest number of components take no part. Rows with the same id count
once, at their nearest; a query's own id is never its neighbour. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from launchlake.llm.common import settle

TREES = 4
LEAF = 256  # rows a leaf should hold
BRANCH = 6
LEAST_LEAF = 16  # sample vectors below which a node is not cut again
SAMPLE = 16_384
RECALL = 0.95  # of the neighbours in the sample
TRIED = 96  # sample vectors that tell how many leaves that takes
BLOCK = 8192
SEED = 7


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order from 1: plane and threshold; ``leaf`` marks the nodes that are not cut."""

    planes: np.ndarray
    thresholds: np.ndarray
    leaf: np.ndarray

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.ones(len(vectors), np.int64)
        moving = np.arange(len(vectors)) if not self.leaf[1] else np.zeros(0, np.int64)
        while len(moving):
            nodes = at[moving]
            side = np.einsum("ij,ij->i", vectors[moving], self.planes[nodes]) > self.thresholds[nodes]
            at[moving] = 2 * nodes + side
            moving = moving[~self.leaf[at[moving]]]
        return at


def deep(rows: int, leaf: int = LEAF) -> int:
    """The depth at which leaves hold about ``leaf`` rows."""
    return max(1, math.ceil(math.log2(max(1, rows / leaf))))


def grow(sample: np.ndarray, trees: int = TREES, depth: int = 6, seed: int = SEED) -> list[Tree]:
    rng, forest = np.random.default_rng(seed), []
    distinct = np.unique(sample, axis=0)
    for _ in range(trees):
        planes, thresholds = np.zeros((2 << depth, sample.shape[1])), np.zeros(2 << depth)
        leaf = np.zeros(2 << depth, bool)
        todo = [(1, np.arange(len(distinct)))]
        while todo:
            node, rows = todo.pop()
            if node >= 1 << depth or len(rows) < 2 * LEAST_LEAF:
                leaf[node] = True
                continue
            a, b = distinct[rng.choice(rows, 2, replace=False)]
            planes[node] = (a - b) / np.linalg.norm(a - b)
            along = np.einsum("ij,j->i", distinct[rows], planes[node])
            thresholds[node] = np.median(along)
            right = along > thresholds[node]
            if not right.any():
                leaf[node] = True
                continue
            todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        forest.append(Tree(planes, thresholds, leaf))
    return forest


def visits(forest: list[Tree], query: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The first ``count`` (tree, leaf) of a query, through one queue over all trees."""
    queue = [(0.0, t, 1) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    margins = [tree.planes @ query - tree.thresholds for tree in forest]
    while queue and len(found) < count:
        farthest, t, node = heapq.heappop(queue)
        while not forest[t].leaf[node]:
            margin = margins[t][node]
            near = 2 * node + int(margin > 0)
            heapq.heappush(queue, (max(farthest, abs(margin)), t, near ^ 1))
            node = near
        found.append((t, node))
    return found


def effort(forest: list[Tree], sample: np.ndarray, k: int, recall: float = RECALL, tried: int = TRIED) -> int:
    """How many leaves a query must search to find ``recall`` of its k neighbours, by vectors of the sample."""
    total = sum(int(t.leaf.sum()) for t in forest)
    leaves = np.stack([tree.file(sample) for tree in forest])
    needed: list[int] = []
    for at in range(0, len(sample), max(1, len(sample) // tried)):
        distance = ((sample - sample[at]) ** 2).sum(axis=1)
        distance[at] = np.inf
        true = np.argsort(distance, kind="stable")[:min(k, len(sample) - 1)]
        turn = np.full((len(forest), max(len(t.leaf) for t in forest)), total)
        for i, (t, leaf) in enumerate(visits(forest, sample[at], total)):
            turn[t, leaf] = i
        needed += turn[np.arange(len(forest))[:, None], leaves[:, true]].min(axis=0).tolist()
    return min(total, int(np.quantile(needed, recall, method="higher")) + 1) if needed else total


def nearest(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int, rough: np.ndarray, rows: np.ndarray) -> list[tuple[int, float]]:
    """The k nearest of ``rows`` by exact distance; ``rough`` squared distances only tell which rows cannot be among them."""
    kept = rows[ids[rows] != query_id]
    if len(kept) > k:
        # The k-th nearest id, not row: rows with one id count once.
        order = kept[np.argsort(rough[kept], kind="stable")]
        first = np.sort(np.unique(ids[order], return_index=True)[1])
        limit = rough[order[first[min(k, len(first)) - 1]]]
        kept = kept[rough[kept] <= limit + 1e-9 * (1 + abs(limit)) + 1e-9 * float(query @ query)]
    exact = np.sqrt(((vectors[kept] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[kept], exact))
    out: dict[int, float] = {}
    for i in order:
        out.setdefault(int(ids[kept[i]]), float(exact[i]))
        if len(out) == k:
            break
    return list(out.items())


def usable(table: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and their number."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("vector") == (common[0].d if common else 0)), common[0]["count"] if common else 0


def search(table: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF,
           sample: int = SAMPLE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows of every query row."""
    rows, total = usable(table, vec_id, vector)
    spark = table.sparkSession
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = np.array([r.vector for r in drawn])
    forest = grow(vectors, trees, deep(total, leaf))
    count = effort(forest, vectors, k, recall)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch.vector.to_numpy())
                for t, tree in enumerate(forest):
                    yield batch.assign(tree=np.int32(t), leaf=tree.file(vectors).astype(np.int32))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                paths = [visits(forest, v, count) for v in part.vector]
                places = [p for path in paths for p in path]
                out = part.loc[part.index.repeat([len(p) for p in paths])]
                yield out.assign(tree=np.array([t for t, _ in places], np.int32), leaf=np.array([n for _, n in places], np.int32))

    placed = "vec_id long, vector array<double>, tree int, leaf int"
    index = settle(rows.mapInPandas(file, placed), "forest-index")
    asked = settle(rows.filter(is_query(F.col("vec_id"))).mapInPandas(visit, placed).withColumnRenamed("vec_id", "query_id"), "forest-visits")
    # The number of a node in heap order has as many bits as its depth, and the first of them are its branch.
    steps = F.floor(F.log2("leaf")).cast("int")
    branch = F.when(steps > BRANCH, F.expr(f"shiftright(leaf, cast(floor(log2(leaf)) as int) - {BRANCH})")).otherwise(F.col("leaf"))
    index, asked = index.withColumn("branch", branch), asked.withColumn("branch", branch)
    # Large branches are cut into blocks on both sides; there are few branches, whatever the table holds.
    sizes = index.groupBy("tree", "branch").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    crowds = asked.groupBy("tree", "branch").agg(F.ceil(F.count("*") / block).cast("int").alias("crowds"))
    cuts = F.broadcast(settle(sizes.join(crowds, ["tree", "branch"]), "branch-blocks"))
    at = ["tree", "branch", "b", "c"]
    left = index.join(cuts, ["tree", "branch"]).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select(
        "tree", "branch", "b", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("c"), "leaf", "vec_id", "vector")
    right = asked.join(cuts, ["tree", "branch"]).withColumn("c", F.pmod(F.xxhash64("query_id", "vector"), F.col("crowds")).cast("int")).select(
        "tree", "branch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "c", "leaf", "query_id", "vector")

    def compare(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(vectors) and len(queries):
            ids, m = vectors.vec_id.to_numpy(), np.stack(vectors.vector.to_numpy())
            stands = vectors.groupby("leaf").indices
            norms = np.einsum("ij,ij->i", m, m)
            # Rows of one query and one vector are the leaves that it visits.
            asks = queries.assign(key=[v.tobytes() for v in queries.vector]).groupby(["query_id", "key"], sort=False)
            asks = [(part.query_id.iloc[0], part.vector.iloc[0], set(part.leaf)) for _, part in asks]
            for start in range(0, len(asks), 256):
                q = np.stack([v for _, v, _ in asks[start:start + 256]])
                rough = norms - 2 * (q @ m.T) + np.einsum("ij,ij->i", q, q)[:, None]
                for j, (query_id, v, leaves) in enumerate(asks[start:start + 256]):
                    rows = [stands[leaf] for leaf in leaves if leaf in stands]
                    if rows:
                        out += [(query_id, i, d) for i, d in nearest(ids, m, query_id, v, k, rough[j], np.sort(np.concatenate(rows)))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
