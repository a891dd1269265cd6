"""Statistics of the samples inside windows, by one pass over a bucket of samples in time order.

A window is a stretch of the sorted samples, found by binary search. Windows with equally many
values are sorted and summed together, so a task handles columns and never one window at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.functions.stats import STATS

CELLS = 1 << 19  # values sorted at once


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by ``names``, cut only between groups, and the bounds of the groups."""
    held: list[pa.RecordBatch] = []

    def bounds(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        change[:1] = True
        for name in names:
            column = rows.column(name)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            ids = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= ids[1:] != ids[:-1]
        return np.append(np.flatnonzero(change), rows.num_rows)

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, bounds(table)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(bounds(batch)[-2])
        same = bool(held) and all(held[0].column(n)[0].as_py() == batch.column(n)[0].as_py() for n in names)
        if held and not (same and last == 0):
            yield out([*held, batch.slice(0, last)] if last else held)
            held = []
        elif last:
            yield out([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield out(held)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column and where it has one."""
    has = column.is_valid().to_numpy().astype(bool)
    return column.fill_null(0).to_numpy(), has


def six(values: np.ndarray, has: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Mean, population deviation, min, max, median and nearest-rank p95 of the values in ``[low, high)``; null where there is none."""
    place = np.concatenate(([0], np.cumsum(has)))
    values, low, high = values[has], place[low], place[high]
    sizes = high - low
    found = np.zeros((len(STATS), len(low)))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for start, end in zip(cuts[:-1], cuts[1:]):
        n = int(sizes[order[start]])
        for at in range(start, end, max(1, CELLS // max(n, 1))) if n else ():
            chosen = order[at:min(end, at + max(1, CELLS // n))]
            v = np.sort(values[low[chosen][:, None] + np.arange(n)], axis=1)
            # summed from left to right, whatever else is summed with it
            mean = np.cumsum(v, axis=1)[:, -1] / n
            spread = np.cumsum((v - mean[:, None]) ** 2, axis=1)[:, -1]
            middle = v[:, (n - 1) // 2] if n % 2 else (v[:, n // 2 - 1] + v[:, n // 2]) / 2
            # nearest rank in whole numbers: ceil(0.95 n) - 1
            found[:, chosen] = mean, np.sqrt(spread / n), v[:, 0], v[:, -1], middle, v[:, (n * 95 + 99) // 100 - 1]
    return [pa.array(row, pa.float64(), mask=sizes == 0) for row in found]


def list_windows6(rows: DataFrame, prefix: str, width_us: int, step_us: int, count: int) -> DataFrame:
    """The windows that begin in each stretch of ``rows``: ``start_ns``, rows ``n`` and six statistics, for windows with any row.

    ``start_us`` is where a stretch and its first of ``count`` windows begin; ``at`` and ``values`` are lists of its rows in one order.
    ``at`` counts from there, and is ``-1 - at`` where the value is null.
    """
    kept, names = [c for c in rows.columns if c not in ("start_us", "at", "values")], [f"{prefix}_{s}" for s in STATS]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
            at, values = (batch.column(c).flatten().to_numpy() for c in ("at", "values"))
            stretch = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 40
            place = stretch + np.where(at < 0, -1 - at, at)
            order = np.argsort(place, kind="stable")
            place, values, has = place[order], values[order], at[order] >= 0
            begin = ((np.arange(len(sizes), dtype=np.int64) << 40)[:, None] + np.arange(count) * step_us).reshape(-1)
            low, high = np.searchsorted(place, begin, "left"), np.searchsorted(place, begin + width_us, "left")
            some = np.flatnonzero(high > low)
            of, low, high = some // count, low[some], high[some]
            start = (batch.column("start_us").to_numpy()[of] + some % count * step_us) * 1000
            own = [c.take(pa.array(of)) for c in batch.select(kept).columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(start), pa.array(high - low), *six(values, has, low, high)], names=[*kept, "start_ns", "n", *names])

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "start_ns long", "n long", *(f"`{c}` double" for c in names)]
    return rows.mapInArrow(cut, ", ".join(schema))


def sliding(rows: DataFrame, keys: Sequence[str], values: Sequence[str], spec, width: int) -> DataFrame:
    """The windows of every bucket that hold enough samples; ``window_index`` counts them within their bucket.

    ``rows`` has keys, ``bucket`` (of ``width`` windows), ``at``, ``_first``, ``_last``, ``last_k`` and ``values``.
    """
    group = [*keys, "bucket"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, group):
            at, first, last, last_k, bucket = (table.column(c).to_numpy() for c in ("at", "_first", "_last", "last_k", "bucket"))
            found = []
            for start, end in zip(bounds[:-1], bounds[1:]):
                k = np.arange(bucket[start] * width, min((bucket[start] + 1) * width - 1, last_k[start]) + 1)
                begin = first[start] + k * spec.step_ns
                low = np.searchsorted(at[start:end], begin, "left")
                high = np.searchsorted(at[start:end], begin + spec.window_ns, "right")
                n, duration = high - low, last[start] - first[start]
                if duration > spec.window_ns:
                    kept = n >= max(1, spec.needed)
                else:
                    kept = n >= (1 if duration < spec.interval_ns else 2)
                found.append((k[kept], low[kept] + start, high[kept] + start, np.arange(np.count_nonzero(kept))))
            k, low, high, index = (np.concatenate(x) for x in zip(*found))
            own = table.select(group).take(pa.array(low))
            stats = [s for v in values for s in six(*numbers(table.column(v)), low, high)]
            arrays = [*(c.combine_chunks() for c in own.columns), pa.array(k), pa.array(high - low), pa.array(at[low]), pa.array(at[high - 1]), pa.array(index), *stats]
            yield pa.RecordBatch.from_arrays(arrays, names=[*group, "k", "n", "start_ns", "end_ns", "window_index", *names])

    names = [f"{v}_{s}" for v in values for s in STATS]
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema),
              *(f"{c} long" for c in ("k", "n", "start_ns", "end_ns", "window_index")), *(f"`{c}` double" for c in names)]
    return rows.repartition(*group).sortWithinPartitions(*group, "at").mapInArrow(sweep, ", ".join(schema))


def inside(asks: DataFrame, samples: DataFrame, keys: Sequence[str], values: Sequence[str], count: str) -> DataFrame:
    """``asks`` with the number of samples from ``window_start_ns`` to ``window_end_ns`` and six statistics of each of ``values``.

    Both have keys and ``bucket``; a bucket holds every sample that its asks reach.
    """
    group = [*keys, "bucket"]
    out = [c for c in asks.columns if c != "bucket"]
    # each side is one column that is null on the other side, so a sample does not carry a number for every column of a window
    rows = samples.select(*group, "at", F.struct(*values).alias("sample")).unionByName(
        asks.select(*group, F.struct(*[c for c in out if c not in keys]).alias("ask")), allowMissingColumns=True)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, group):
            at, sampled = numbers(table.column("at"))
            own, sample = (pa.table(dict(zip([f.name for f in c.type], c.flatten()))) for c in (table.column("ask").combine_chunks(), table.column("sample").combine_chunks()))
            begin, until = (numbers(own.column(c))[0] for c in ("window_start_ns", "window_end_ns"))
            low, high, chosen = [], [], []
            for start, end in zip(bounds[:-1], bounds[1:]):
                cut = start + np.count_nonzero(sampled[start:end])  # samples stand first
                low.append(start + np.searchsorted(at[start:cut], begin[cut:end], "left"))
                high.append(start + np.searchsorted(at[start:cut], until[cut:end], "right"))
                chosen.append(np.arange(cut, end))
            low, high, chosen = (np.concatenate(x) for x in (low, high, chosen))
            picked = [(table if c in keys else own).column(c).take(pa.array(chosen)).combine_chunks() for c in out]
            stats = [s for v in values for s in six(*numbers(sample.column(v)), low, high)]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(high - low), *stats], names=[*out, count, *names])

    names = [f"{v}_{s}" for v in values for s in STATS]
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.select(*out).schema), f"{count} long", *(f"`{c}` double" for c in names)]
    return rows.repartition(*group).sortWithinPartitions(*group, F.col("at").isNull(), "at").mapInArrow(sweep, ", ".join(schema))
