"""What a stream asks of its state, and what a training round shuffles, does not grow with the rows."""

import random

import pandas as pd

from launchlake.operators import ml
from launchlake.operators.windows import WindowConfig
from launchlake.streaming.stateful import TokenWindows


class Held:
    def __init__(self):
        self.value, self.map, self.asked = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked += 1
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value


def first_seen(rows, budget, threshold):
    """Windows by the rule: the queue is looked through anew at every launch."""
    queue, evicted, seen, out = [], 0, set(), []
    for seq, kernel, cost, ratio in rows:
        queue.append((kernel, cost, ratio))
        if sum(c for _, c, _ in queue) <= budget:
            continue
        latest = {k: r for k, _, r in queue}
        names = sorted(latest)
        top = sorted(names, key=lambda k: (-sum(q[0] == k for q in queue), k))[:3]
        if max(latest.values()) >= threshold and (*names, None, *top) not in seen:
            seen.add((*names, None, *top))
            out.append((evicted, evicted + len(queue) - 1, seq, sum(c for _, c, _ in queue), len(queue), ",".join(names), ",".join(top), max(latest.values())))
        while queue and sum(c for _, c, _ in queue) > budget:
            queue.pop(0)
            evicted += 1
    return out


def test_state_is_asked_once_per_composition_and_batch():
    rnd = random.Random(2)
    rows = [(i, rnd.choice("abcd"), rnd.randrange(1, 12), rnd.randrange(10) / 10) for i in range(3000)]
    windows = TokenWindows(WindowConfig(budget=20, threshold=0.5))
    windows.queue, windows.seen = Held(), Held()
    got = []
    for part in (rows[:1100], rows[1100:]):
        batch = pd.DataFrame(part, columns=["sequence", "kernel_id", "token_cost", "ratio"]).assign(ready=True)
        for found in windows.handleInputRows(("c", 1, "d", 0), iter([batch]), None):
            got += [tuple(r) for r in found.drop(columns=["capture_id", "pid", "device_pci_bus_id", "stream", "dropped_unready_launches"]).itertuples(index=False)]
    assert got == first_seen(rows, 20, 0.5)
    assert windows.seen.asked <= 2 * len(got)


def test_text_model_trains_on_no_more_partitions_than_cores(spark, monkeypatch):
    cores, seen = spark.sparkContext.defaultParallelism, []
    rows = spark.range(400).selectExpr("concat('a', id % 2, ' b c', id % 3) text", "cast(id % 2 as double) label_id").repartition(4 * cores)
    fit = ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, frame: seen.append(frame.rdd.getNumPartitions()) or fit(self, frame))
    model = ml.fit_ngrams(rows, buckets=64, rounds=3)
    assert seen == [cores] and len(model.stages) == 4
