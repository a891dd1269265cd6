"""Removal of long repeated passages by De Bruijn compaction.

A window of ``size`` words is an edge of a De Bruijn graph, from its first to its last
``size - 1`` words. Writing down every edge of a corpus would multiply it, so edges travel
as paths: consecutive windows of a document whose smallest ``seed``-word hash (minimizer)
stands at the same place form one path, and equal windows anywhere lie on paths with
equal minimizers. Then

1. paths whose minimizer occurs once are dropped: none of their edges is repeated;
2. equal paths are compacted into one, found by a join on minimizer and content; where
   such a path occurs at two or more places, all its edges are repeated;
3. paths with the same minimizer but other content may branch: one copy of each is opened,
   its edges are read at their source coordinates, and joined by content.

Words under repeated edges are removed. Paths and edges are compared by the 64-bit hash of
their words together with the 64-bit hash of their minimizer. Everything is judged on the
input, not on what is left.

Words are runs of anything but ASCII white space, unchanged. Null texts have no words;
documents shorter than a window keep all. A repeated row is a copy like any other. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.llm.common import settle

WINDOW = 35
SEED_WORDS = 8
PLACE_BITS = 20  # a minimizer's place within a segment of a document
SEGMENT = (1 << PLACE_BITS) - 256
_digest = xxhash.xxh64_intdigest


class Words:
    """The words of a text, and their bytes joined by one space."""

    def __init__(self, text: str) -> None:
        self.words = text.encode().split()
        self.joined = b" ".join(self.words)
        ends = list(accumulate(len(w) + 1 for w in self.words))
        self.starts, self.ends = [0, *ends[:-1]], [e - 1 for e in ends]

    def run(self, at: int, count: int) -> bytes:
        """``count`` words from ``at`` on."""
        return self.joined[self.starts[at]:self.ends[at + count - 1]]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:len(values) - (width - reach)], values[width - reach:]) if width > reach else values


def paths(words: Words, size: int, seed: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, minimizer, content hash) of every path of a document."""
    n = len(words.words) - size + 1
    if n <= 0:
        return
    joined = words.joined
    hashes = np.array([_digest(joined[s:e]) for s, e in zip(words.starts, words.ends[seed - 1:])], np.uint64)
    width = size - seed + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for first in range(0, n, SEGMENT):
        last = min(n, first + SEGMENT)
        part = hashes[first:last + width - 1]
        keyed = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        place = (_smallest(keyed, width) & mask).astype(np.int64)
        opens = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        counts = np.diff(np.concatenate((opens, [last - first])))
        for at, count, minimizer in zip((opens + first).tolist(), counts.tolist(), part[place[opens]].view(np.int64).tolist()):
            content = _digest(joined[words.starts[at]:words.ends[at + count + size - 2]])
            yield at, count, minimizer, content - (1 << 64) if content >= 1 << 63 else content


def repeated(docs: DataFrame, size: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """key, at and count: runs of ``count`` windows from word ``at`` on that are repeated. ``docs`` has key and text."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows += [(key, *p) for p in paths(Words(text), size, seed)]
            columns = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1].astype(np.int32)), pa.array(columns[:, 2].astype(np.int32)),
                                              pa.array(columns[:, 3]), pa.array(columns[:, 4])], names=["key", "at", "count", "minimizer", "content"])

    walked = settle(docs.select("key", "text").mapInArrow(walk, "key long, at int, count int, minimizer long, content long"), "paths")
    # Counts are written before they are joined: a join of plain tables is split where one minimizer has many paths.
    often = settle(walked.groupBy("minimizer").agg(F.count("*").alias("seen")).filter("seen > 1").select("minimizer"), "often")
    open_paths = settle(walked.join(often, "minimizer", "left_semi"), "repeated-minimizers")

    path = ["minimizer", "content", "count"]
    compact = settle(open_paths.groupBy(*path).agg(F.count("*").alias("places"), F.min(F.struct("key", "at")).alias("source")), "compact-paths")
    whole = open_paths.join(compact.filter("places > 1").select(*path), path, "left_semi").select("key", "at", "count")

    branching = settle(compact.groupBy("minimizer").agg(F.count("*").alias("paths")).filter("paths > 1").select("minimizer"), "branching")
    opened = compact.join(branching, "minimizer", "left_semi").select("source.key", "source.at", "count", "minimizer", "places")
    opened = opened.groupBy("key").agg(F.collect_list(F.struct("at", "count", "minimizer", "places")).alias("paths"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, minimizers, contents, places = [], [], [], [], []
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words(text)
                for p in wanted:
                    for at in range(p["at"], p["at"] + p["count"]):
                        keys.append(key)
                        ats.append(at)
                        minimizers.append(p["minimizer"])
                        contents.append(_digest(words.run(at, size)))
                        places.append(p["places"])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ats, pa.int32()), pa.array(minimizers, pa.int64()),
                                              pa.array(np.array(contents, np.uint64).view(np.int64)), pa.array(places, pa.int64())],
                                             names=["key", "at", "minimizer", "content", "places"])

    texts = docs.filter("text is not null").select("key", "text")
    sources = texts.join(opened, "key").dropDuplicates(["key"])
    edge = settle(sources.mapInArrow(edges, "key long, at int, minimizer long, content long, places long"), "edges")
    met = settle(edge.groupBy("minimizer", "content").agg(F.sum("places").alias("places")).filter("places > 1").select("minimizer", "content"), "met-edges")
    # Paths with several places are removed as a whole already.
    single = edge.filter("places = 1").join(met, ["minimizer", "content"], "left_semi").select("key", "at", F.lit(1).alias("count"))
    return whole.union(single)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words and n_removed of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))
    runs = settle(repeated(rows, size, seed).groupBy("key").agg(F.collect_set(F.struct("at", "count")).alias("runs")), "runs")
    id_type = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split() if text else []
                total.append(len(words))
                if spans:
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, [s["at"] for s in spans], 1)
                    np.add.at(steps, [s["at"] + s["count"] + size - 1 for s in spans], -1)
                    words = list(compress(words, (np.cumsum(steps)[:-1] == 0).tolist()))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                                             names=["doc_id", "kept", "n_words", "n_removed"])

    return rows.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(cut, f"doc_id {id_type}, kept string, n_words long, n_removed long")
