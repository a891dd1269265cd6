"""Random forests grown on counts of binned rows: one Spark job per level for all trees together.

Features are cut into at most 32 bins, and where bins can repeat, equal rows become one cell with a count. In a job, tasks
walk their cells down the trees so far and count classes per open node, drawn feature and bin; the counts of a tree meet
in a shuffle, where its best splits are found. Only splits reach the driver. A task keeps nothing per row and tree: how often a
tree draws a cell is worked out again from the cell's key whenever it is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from math import exp, prod
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from launchlake.session import materialize

MAX_BINS = 32
CELLS = 1 << 21  # cells a task looks at together
NODES = 2048  # open nodes of a tree whose counts are gathered together
EXACT_DRAWS = 16  # up to this count draws come from tables of the Poisson distribution


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Where each feature may be split: between all values if there are few, else at quantiles of all rows."""
    places = [i / MAX_BINS for i in range(1, MAX_BINS)]
    said = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), places, 10_000).alias(f"q{i}") for i, c in enumerate(features)],
                    *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(features)]).first()
    few = [i for i in range(len(features)) if said[f"n{i}"] <= 2 * MAX_BINS]
    values = rows.agg(*[F.collect_set(F.col(features[i]).cast("double")).alias(f"v{i}") for i in few]).first() if few else None
    edges = []
    for i in range(len(features)):
        known = np.unique(values[f"v{i}"]) if i in few else None
        edges.append((known[:-1] + known[1:]) / 2 if known is not None and len(known) <= MAX_BINS else np.unique(np.array(said[f"q{i}"] or [], dtype=float)))
    return edges


def counted_cells(rows: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray], count: int, classes: int) -> DataFrame:
    """Binned rows ``f0, f1, ..., label, n, key``, dealt to all cores; equal ones are counted together where that must shrink the table."""
    names = [f"f{i}" for i in range(len(features))]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [np.searchsorted(e, b.column(i).to_numpy(zero_copy_only=False), "left").astype(np.int8) for i, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), b.column(len(edges))], names=[*names, "label"])

    picked = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip(features, names)], F.col(label).cast("int").alias("label"))
    cells = picked.mapInArrow(binned, ", ".join([*(f"{n} byte" for n in names), "label int"]))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if classes * prod(len(e) + 1 for e in edges) <= count:
        cells, parts = cells.groupBy(*names, "label").agg(F.count(F.lit(1)).alias("n")), cores
    else:
        cells, parts = cells.withColumn("n", F.lit(1).cast("long")), max(cores, count // CELLS)
    # the key is written with the cell, so every level draws alike
    return materialize(cells.repartition(parts).withColumn("key", F.hash(F.monotonically_increasing_id())), "forest-cells")


@cache
def _draw_tables() -> tuple[np.ndarray, np.ndarray]:
    """Poisson quantiles for counts up to ``EXACT_DRAWS`` and normal quantiles, at 2^16 even places."""
    places = (np.arange(1 << 16) + 0.5) / (1 << 16)
    poisson = np.zeros((EXACT_DRAWS + 1, 1 << 16), dtype=np.uint8)
    for n in range(1, EXACT_DRAWS + 1):
        chance, total, cdf = exp(-n), 0.0, []
        for k in range(80):
            total += chance
            cdf.append(total)
            chance *= n / (k + 1)
        poisson[n] = np.searchsorted(cdf, places)
    return poisson, np.array([NormalDist().inv_cdf(p) for p in places])


def draws(n: np.ndarray, key: np.ndarray, tree: int) -> np.ndarray:
    """How often ``tree`` draws each cell of ``n`` rows: Poisson with mean ``n``, the sum of a bootstrap's draws of its rows."""
    h = key ^ np.uint32((tree + 1) * 0x9E3779B1 & 0xFFFFFFFF)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    place = (h ^ (h >> np.uint32(16))) >> np.uint32(16)
    poisson, normal = _draw_tables()
    most = int(n.max(initial=0))
    if most <= 1:
        return poisson[1][place]
    out = poisson[np.minimum(n, EXACT_DRAWS), place].astype(np.int64)
    if most > EXACT_DRAWS:  # normal with the correction for skewness
        z, big = normal[place], n > EXACT_DRAWS
        out[big] = np.maximum(0, np.rint(n + np.sqrt(n) * z + (z * z - 1) / 6))[big].astype(np.int64)
    return out


@dataclass
class Tree:
    """Nodes by number, children behind their parents; ``open`` are those of the last level that may be split."""

    counts: np.ndarray
    step: np.ndarray = field(default_factory=lambda: np.array([255], dtype=np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.array([-1]))
    edge: np.ndarray = field(default_factory=lambda: np.array([-1]))
    gain: np.ndarray = field(default_factory=lambda: np.array([-1.0]))
    left: np.ndarray = field(default_factory=lambda: np.array([-1]))
    open: np.ndarray = field(default_factory=lambda: np.array([0]))

    def slots(self) -> np.ndarray:
        out = np.full(len(self.left), -1, dtype=np.int64)
        out[self.open] = np.arange(len(self.open))
        return out

    def grow(self, feature: np.ndarray, edge: np.ndarray, gain: np.ndarray, left: np.ndarray, total: np.ndarray, more: bool) -> None:
        """Split the open nodes that gain by it; ``more`` levels may follow."""
        self.counts[self.open] = total
        split = np.flatnonzero(gain > 0)
        at, first = self.open[split], len(self.left) + 2 * np.arange(len(split))
        self.feature[at], self.edge[at], self.gain[at], self.left[at] = feature[split], edge[split], gain[split], first
        self.step[at] = first << 32 | feature[split] << 8 | edge[split]
        born = np.stack([left[split], total[split] - left[split]], axis=1).reshape(-1, total.shape[1])
        number = len(self.left) + np.arange(len(born))
        self.counts = np.concatenate([self.counts, born])
        self.step = np.append(self.step, number << 32 | 255)  # a leaf leads to itself
        self.feature, self.edge, self.left = (np.append(x, np.full(len(born), -1)) for x in (self.feature, self.edge, self.left))
        self.gain = np.append(self.gain, np.full(len(born), -1.0))
        self.open = number[(born > 0).sum(axis=1) > 1] if more else number[:0]


def _drawn_features(seed: int, tree: int, level: int, nodes: int, features: int, k: int) -> np.ndarray:
    """``k`` features for each open node, the same wherever it is asked."""
    return np.argsort(np.random.default_rng([seed, tree, level]).random((nodes, features)), axis=1)[:, :k]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = CELLS) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def best_splits(total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of counts by (drawn feature, node, bin, class): per node drawn feature and bin of the largest gini gain, the gain, and counts left and in all."""
    k, nodes, bins, classes = total.shape
    whole = total[0].sum(axis=1)
    left = np.cumsum(total, axis=2)
    right = whole[None, :, None, :] - left

    def impurity(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = counts * weight
        size = w.sum(axis=-1)
        return size, size - (w * w).sum(axis=-1) / np.where(size > 0, size, 1)  # times size

    size, own = impurity(whole)
    gain = own[None, :, None] - impurity(left)[1] - impurity(right)[1]
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, -1.0).transpose(1, 0, 2).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    j, b = best // bins, best % bins
    here = np.arange(nodes)
    gain = gain[here, best] / np.where(size > 0, size, 1)
    return j, b, np.where(gain > 1e-12, gain, -1.0), left[j, here, b], whole


def _grow_level(cells: DataFrame, trees: list[Tree], numbers: range, level: int, features: int, k: int, bins: int, weight: np.ndarray, seed: int, more: bool) -> None:
    classes = len(weight)
    state = {t: (tree.step, tree.slots(), len(tree.open)) for t, tree in zip(numbers, trees) if len(tree.open)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            flat = np.stack([table.column(i).to_numpy() for i in range(features)], axis=1).reshape(-1).astype(np.uint8)
            label, n, key = table["label"].to_numpy().astype(np.int64), table["n"].to_numpy(), table["key"].to_numpy().view(np.uint32)
            for t, (step, slots, opened) in state.items():
                often = draws(n, key, seed + t)
                row = np.flatnonzero(often)
                at, node = row * features, np.zeros(len(row), dtype=np.int64)
                for _ in range(level):
                    p = step[node]
                    node = (p >> 32) + (flat[at + (p >> 8 & 0xFFFFFF)] > (p & 255))
                slot = slots[node]
                live = np.flatnonzero(slot >= 0)
                row, at, slot = row[live], at[live], slot[live]
                often = often[row].astype(np.float64)
                drawn = _drawn_features(seed, t, level, opened, features, k)
                for low in range(0, opened, NODES):
                    size = min(NODES, opened - low)
                    here = slice(None) if opened <= NODES else np.flatnonzero((slot >= low) & (slot < low + NODES))
                    s, a, o = slot[here], at[here], often[here]
                    base = (s - low) * (bins * classes) + label[row[here]]
                    sums = np.stack([np.bincount(base + classes * flat[a + drawn[:, j][s]].astype(np.int64), o, size * bins * classes) for j in range(k)])
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([low], pa.int32()), pa.array([sums.astype(np.int64).tobytes()])], names=["tree", "low", "sums"])

    def judge(table: pa.Table) -> pa.Table:
        t, low = table["tree"][0].as_py(), table["low"][0].as_py()
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table["sums"]).reshape(k, -1, bins, classes)
        j, b, gain, left, whole = best_splits(total, weight)
        drawn = _drawn_features(seed, t, level, state[t][2], features, k)[low:low + len(j)]
        row = {"tree": t, "low": low, "feature": drawn[np.arange(len(j)), j], "edge": b, "gain": gain, "left": left.reshape(-1), "total": whole.reshape(-1)}
        return pa.table({c: pa.array([v]) for c, v in row.items()}).cast(pa.schema(
            [("tree", pa.int32()), ("low", pa.int32()), ("feature", pa.list_(pa.int64())), ("edge", pa.list_(pa.int64())), ("gain", pa.list_(pa.float64())),
             ("left", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))]))

    sums = cells.mapInArrow(count, "tree int, low int, sums binary")
    found = sums.groupBy("tree", "low").applyInArrow(
        judge, "tree int, low int, feature array<long>, edge array<long>, gain array<double>, left array<long>, total array<long>").toArrow().sort_by([("tree", "ascending"), ("low", "ascending")])
    of = found["tree"].to_numpy()
    for t in state:
        mine = found.filter(pa.array(of == t))
        feature, edge, gain, left, total = (mine[c].combine_chunks().flatten().to_numpy() for c in ("feature", "edge", "gain", "left", "total"))
        trees[t - numbers.start].grow(feature, edge, gain, left.reshape(-1, classes), total.reshape(-1, classes), more)


def grow(cells: DataFrame, numbers: range, k: int, edges: list[np.ndarray], weight: np.ndarray, depth: int, seed: int) -> pa.Table:
    """Grow the trees ``numbers``, each node on ``k`` features drawn for it, and return their nodes: tree, id, counts weighted by class, raw count, gain, children, feature and threshold."""
    bins = max(len(e) for e in edges) + 1
    trees = [Tree(np.zeros((1, len(weight)), dtype=np.int64)) for _ in numbers]
    for level in range(depth):
        if not any(len(t.open) for t in trees):
            break
        _grow_level(cells, trees, numbers, level, len(edges), k, bins, weight, seed, level + 1 < depth)
    parts = []
    for i, t in enumerate(trees):
        inner = t.left >= 0
        stats = t.counts * weight
        size = stats.sum(axis=1)
        share = stats / np.where(size > 0, size, 1)[:, None]
        cut = np.array([edges[f][e] if f >= 0 else 0.0 for f, e in zip(t.feature, t.edge)])
        lists = lambda v, w: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(w)).astype(np.int32)), pa.array(v))
        split = pa.StructArray.from_arrays([pa.array(t.feature, pa.int64()).cast(pa.int32()), lists(cut[inner], inner), pa.array(np.full(len(inner), -1, dtype=np.int32))],
                                           names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        columns = {
            "id": pa.array(np.arange(len(inner), dtype=np.int32)), "prediction": pa.array(stats.argmax(axis=1).astype(float)), "impurity": pa.array(1 - (share * share).sum(axis=1)),
            "impurityStats": lists(stats.reshape(-1), np.full(len(inner), len(weight))), "rawCount": pa.array(t.counts.sum(axis=1)), "gain": pa.array(t.gain),
            "leftChild": pa.array(t.left.astype(np.int32)), "rightChild": pa.array(np.where(inner, t.left + 1, -1).astype(np.int32)), "split": split}
        parts.append(pa.table({"treeID": pa.array(np.full(len(inner), i, dtype=np.int32)), "nodeData": pa.StructArray.from_arrays(list(columns.values()), names=list(columns))}))
    return pa.concat_tables(parts)


SCORED = 1 << 18  # rows scored together


@dataclass(frozen=True)
class Walk:
    """Trees of a fitted forest as arrays, numbered through: where features are split, and where a node's two sides lead (a leaf to itself)."""

    cuts: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    edge: np.ndarray
    child: np.ndarray
    share: np.ndarray
    depth: int

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """Sum over the trees of the class shares of the leaf that each row of ``bins`` comes to."""
        flat, at, out = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1], np.zeros((len(bins), self.share.shape[1]))
        for root in self.roots:
            node = np.full(len(bins), root)
            for _ in range(self.depth):
                node = self.child[2 * node + (flat[at + self.feature[node]] > self.edge[node])]
            out += self.share[node]
        return out


def walk_of(tables: Sequence[pa.Table], features: int, depth: int) -> Walk:
    """``tables`` are nodes as the engine saves them, one per forest."""
    rows, at = [], 0
    for table in tables:
        nodes = table["nodeData"].combine_chunks()
        tree, number = table["treeID"].to_numpy(), nodes.field("id").to_numpy()
        order = np.lexsort((number, tree))
        first = np.searchsorted(tree[order], tree[order]) + at
        split = nodes.field("split").take(pa.array(order))
        left, right, feature = (x.to_numpy() for x in (nodes.field("leftChild").take(pa.array(order)), nodes.field("rightChild").take(pa.array(order)), split.field("featureIndex")))
        inner, here = left >= 0, at + np.arange(len(order))
        cut = np.zeros(len(order))
        cut[inner] = split.field("leftCategoriesOrThreshold").flatten().to_numpy()
        stats = nodes.field("impurityStats").take(pa.array(order)).flatten().to_numpy().reshape(len(order), -1)
        child = np.stack([np.where(inner, first + left, here), np.where(inner, first + right, here)], axis=1)
        size = stats.sum(axis=1, keepdims=True)
        rows.append((np.unique(first), feature, cut, inner, child, stats / np.where(size > 0, size, 1)))  # a tree may have drawn no row
        at += len(order)
    roots, feature, cut, inner, child, share = (np.concatenate(x) for x in zip(*rows))
    cuts = [np.unique(cut[inner & (feature == f)]) for f in range(features)]
    edge = np.full(len(cut), np.iinfo(np.int32).max)
    for f in range(features):
        mine = inner & (feature == f)
        edge[mine] = np.searchsorted(cuts[f], cut[mine])
    return Walk(cuts, roots, np.where(inner, feature, 0).astype(np.int64), edge, child.reshape(-1), share, depth)


def score(rows: DataFrame, walk: Walk, features: Sequence[str]) -> DataFrame:
    """Add ``probabilities`` and the number of the ``prediction``; rows that all trees see alike are walked once per chunk."""
    classes = walk.share.shape[1]
    alike = prod(len(c) + 1 for c in walk.cuts) < 1 << 62

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, SCORED):
            table = batch.combine_chunks()
            bins = np.stack([np.searchsorted(c, table[f].to_numpy(), "left") for c, f in zip(walk.cuts, features)], axis=1)
            if alike:
                code = np.ravel_multi_index(tuple(bins.T), [len(c) + 1 for c in walk.cuts])
                _, at, back = np.unique(code, return_index=True, return_inverse=True)
                votes = walk.votes(bins[at])[back]
            else:
                votes = walk.votes(bins)
            size = votes.sum(axis=1, keepdims=True)
            share = votes / np.where(size > 0, size, 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(share) + 1, dtype=np.int32) * classes), pa.array(share.reshape(-1)))
            table = table.append_column("probabilities", lists).append_column("prediction", pa.array(votes.argmax(axis=1).astype(float)))
            yield from table.to_batches()

    schema = StructType([*rows.schema.fields, StructField("probabilities", ArrayType(DoubleType())), StructField("prediction", DoubleType())])
    return rows.mapInArrow(scored, schema)
