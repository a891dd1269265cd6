"""One pass over a bucket of a launch stream: what its queue holds at every launch.

Per-kernel running counts change by one per launch that enters or leaves, so a
window's composition is never gathered: the set of its kernels is a combined
digest to which each kernel is added once and taken away once, the most frequent
kernels stand at the head of an ordered list of counts, and the best latest ratio
at the head of a heap. A launch costs a few steps whatever the budget is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1 << 16)
def _digest(kernel: str) -> int:
    return int.from_bytes(blake2b(kernel.encode(), digest_size=16).digest())


@dataclass
class Queue:
    """The launches within one budget, with counts and latest ratios per kernel."""

    launches: deque = field(default_factory=deque)
    counts: dict = field(default_factory=dict)
    ranked: list = field(default_factory=list)
    latest: dict = field(default_factory=dict)
    ratios: list = field(default_factory=list)
    set_id: int = 0

    def enter(self, idx: int, cost_before: int, kernel: str, ratio: float) -> None:
        self.launches.append((cost_before, idx, kernel))
        n = self.counts.get(kernel, 0)
        if n:
            del self.ranked[bisect_left(self.ranked, (-n, kernel))]
        else:
            self.set_id ^= _digest(kernel)
        self.counts[kernel] = n + 1
        insort(self.ranked, (-n - 1, kernel))
        self.latest[kernel] = idx
        heappush(self.ratios, (-ratio, idx, kernel))

    def leave(self, least: int) -> None:
        """Drop the launches whose prefix cost is below ``least``."""
        while self.launches and self.launches[0][0] < least:
            kernel = self.launches.popleft()[2]
            n = self.counts[kernel]
            del self.ranked[bisect_left(self.ranked, (-n, kernel))]
            if n > 1:
                self.counts[kernel] = n - 1
                insort(self.ranked, (1 - n, kernel))
            else:
                del self.counts[kernel], self.latest[kernel]
                self.set_id ^= _digest(kernel)

    def best_ratio(self) -> float:
        """The largest of the kernels' latest ratios."""
        while True:
            ratio, idx, kernel = self.ratios[0]
            if self.latest.get(kernel) == idx:
                return -ratio
            heappop(self.ratios)


COMPUTED = pa.schema([("start_idx", pa.int64()), ("start_cost", pa.int64()), ("window_cost", pa.int64()), ("launch_count", pa.int64()), ("max_ratio", pa.float64()),
                      ("set_id", pa.string()), ("top3", pa.list_(pa.string())), ("kernel_set", pa.list_(pa.string()))])
COMPUTED_DDL = ("start_idx long, start_cost long, window_cost long, launch_count long, max_ratio double, set_id string, top3 array<string>, "
                "kernel_set array<string>")


def candidates(rows: DataFrame, keys: Sequence[str], passed: Sequence[str], budget: int, threshold: float | None) -> DataFrame:
    """The candidate windows of ``rows`` whose best latest ratio reaches ``threshold``.

    ``rows`` has keys, ``bucket``, ``warm`` (stands there only to fill the queue), ``idx``, ``cost_before``, and, except in the
    row that stands for a stream's end, ``token_cost``, ``kernel`` and ``ratio``. Columns of ``passed`` come through.
    ``set_id`` is a 128-bit digest of the kernels; the sorted kernels themselves stand only in the first window of a bucket with
    its set and ``top3``.
    """
    group = [*keys, "bucket"]
    read = [*group, "warm", "idx", "cost_before", "token_cost", "kernel", "ratio"]
    out = [*keys, *passed]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queue, seen = None, Queue(), set()
        for batch in batches:
            chosen, found = [], []
            columns = [batch.column(name).to_pylist() for name in read]
            for row, (*here, warm, idx, before, cost, kernel, ratio) in enumerate(zip(*columns)):
                if here != at:
                    at, queue, seen = here, Queue(), set()
                queue.leave(before - budget)
                if kernel is not None:
                    queue.enter(idx, before, kernel, ratio)
                if warm or not queue.launches:
                    continue
                start_cost, start_idx, _ = queue.launches[0]
                total = before + (cost or 0) - start_cost
                if kernel is not None and total <= budget:
                    continue
                best = queue.best_ratio()
                if threshold is not None and best < threshold:
                    continue
                top3 = [k for _, k in queue.ranked[:3]]
                signature = (queue.set_id, *top3)
                kernels = None if signature in seen else sorted(queue.counts)
                seen.add(signature)
                chosen.append(row)
                found.append((start_idx, start_cost, total, len(queue.launches), best, f"{queue.set_id:032x}", top3, kernels))
            kept = batch.select(out).take(pa.array(chosen, pa.int64()))
            computed = [pa.array(values, f.type) for values, f in zip(zip(*found) if found else [()] * len(COMPUTED), COMPUTED)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *computed], names=[*out, *COMPUTED.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*out).schema)
    placed = rows.select(*dict.fromkeys([*read, *passed])).repartition(*group).sortWithinPartitions(*group, F.col("idx"), F.col("kernel").isNull())
    return placed.mapInArrow(sweep, f"{schema}, {COMPUTED_DDL}")
