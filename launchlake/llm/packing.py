"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Only documents longer than a sequence are cut, into full pieces and a rest. Full pieces
are sequences of their own. All other pieces are packed hierarchically: every partition
packs its items best-fit, longest first; bins that are nearly full are done; the others
become items of the next round, in fewer partitions, until one partition holds all that is
left or a round hardly joins anything (then the rest cannot be packed much better). A round's
partitions hold at most ``items_per_task`` items, so no task sees more at any size.

Null and empty texts are pieces of one token, the end id. Repeated rows, and rows with
a null id, are pieces like any other. Extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.llm import tokens
from launchlake.llm.common import settle

CAPACITY = 4096
ITEMS_PER_TASK = 100_000
NEARLY_FULL = 0.998
FAN_IN = 8


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = tokens.DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    step = 4 * capacity

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in tokens.slices(texts):
                at, piece, start, length, check = [], [], [], [], []
                for i, ids in zip(range(first, last), encoder.encode(texts[first:last])):
                    ids += tokens.END
                    for k, cut in enumerate(range(0, len(ids), step)):
                        part = ids[cut:cut + step]
                        at.append(i)
                        piece.append(k)
                        start.append(cut // 4)
                        length.append(len(part) // 4)
                        check.append(tokens.crc(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, check))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.release()

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ids.mapInArrow(scan, f"doc_id {dict(ids.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that has room."""
    open_at: dict[int, list[int]] = {}
    room: list[int] = []  # residuals of open bins, sorted, without repeats
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            number = open_at[left].pop()
            if not open_at[left]:
                del open_at[left], room[k]
            bins[number].append(i)
            left -= size
        else:
            number, left = len(bins), capacity - size
            bins.append([i])
        if left:
            if left not in open_at:
                open_at[left] = []
                insort(room, left)
            open_at[left].append(number)
    return bins


def _round(items: DataFrame, number: int, parts: int, capacity: int, full: int) -> DataFrame:
    """One best-fit round: total, members (with their place in the bin), bin and done of every bin."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        sizes = np.array(table.column("total").to_pylist(), np.int64)
        bins = best_fit(sizes.tolist(), capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        per_bin = np.array([len(b) for b in bins])
        first = np.cumsum(per_bin) - per_bin
        # Where each item starts in its bin, and with it each of the item's members.
        ran = np.cumsum(sizes[order]) - sizes[order]
        item_at = ran - np.repeat(ran[first], per_bin)
        members = table.column("members").combine_chunks().take(pa.array(order))
        per_item = members.value_lengths().to_numpy(zero_copy_only=False)
        flat = members.flatten()
        names = [f.name for f in flat.type]
        fields = [flat.field(n) for n in names[:-1]]
        at = pa.array(flat.field("at").to_numpy(zero_copy_only=False) + np.repeat(item_at, per_item), pa.int64())
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(per_item, first))))
        base = (number << 56) + (TaskContext.get().partitionId() << 28)
        totals = np.add.reduceat(sizes[order], first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(totals), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*fields, at], names=names)),
             pa.array(range(base, base + len(bins)), pa.int64()), pa.array(totals >= full)],
            names=["total", "members", "bin", "done"])

    # Dealt in turn, so that equal rows don't meet in one task.
    return items.select("total", "members").repartition(parts).mapInArrow(fit, f"total long, members {dict(items.dtypes)['members']}, bin long, done boolean")


def pack(rows: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``rows`` of ``pieces`` with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = math.ceil(capacity * nearly_full)
    rows = settle(rows, "pieces")
    packed = rows.filter(F.col("length") >= capacity).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = rows.filter(F.col("length") < capacity).select(
        F.col("length").alias("total"), F.array(F.struct(*columns, F.lit(0).cast("long").alias("at"))).alias("members"))
    count, number = items.count(), 1
    # Small tables, too, are packed by several tasks first.
    parts = max(math.ceil(count / items_per_task), min(FAN_IN, math.ceil(count / 1000)))
    while count:
        bins = settle(_round(items, number, parts, capacity, full), f"bins-{number}")
        items = bins.filter("not done")
        left = items.count()
        # A rest that fits one task always comes together in one; a larger one as long as rounds still empty bins.
        last = parts == 1 or (number > 1 and left > max(0.9 * count, items_per_task))
        placed = (bins if last else bins.filter("done")).select("bin", F.explode("members").alias("m"))
        packed = packed.union(placed.select(*[F.col(f"m.{c}") for c in columns], F.col("bin").alias("sequence_id"), F.col("m.at").alias("offset")))
        if last:
            break
        count, number, parts = left, number + 1, max(math.ceil(left / items_per_task), parts // FAN_IN, 1)
    return packed
