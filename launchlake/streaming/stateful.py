"""Stateful stream operators: windows, readiness, sessions, verdict order.

State of one key is small by construction: a queue within one token budget,
the signatures seen, the artifacts of one session, the last few scores; it goes when
a session ends or a key has been silent for a while. Rows
of one key within a micro-batch are put in sequence order first.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from launchlake.operators import launches as L
from launchlake.operators.metrics import ROLLING_MAX, ROLLING_MEAN, ROLLING_WINDOWS
from launchlake.operators.windows import WindowConfig

WINDOW_SCHEMA = (
    "capture_id string, pid long, device_pci_bus_id string, stream long, start_idx long, end_idx long, end_sequence long, token_cost long, "
    "launch_count long, kernel_set string, top3 string, max_ratio double, dropped_unready_launches long")
STREAM_KEYS = ["capture_id", "pid", "device_pci_bus_id", "stream"]


def _in_order(rows: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(column, kind="stable")


# Keys that send nothing for so long, in event time, are forgotten, and so are the marks of ended ones.
IDLE_MS = 3_600_000
DELAY = "10 minutes"


class Expiring(StatefulProcessor):
    """State of one key (a session, a launch stream) that goes when it ends or falls silent.

    Streams with a time column have one event-time timer per key; when it fires, it moves to the end of the latest silence,
    or the key is forgotten. Of an ended one only the mark is left, which makes later messages be ignored, until it is silent,
    too. Without a time column there are no timers, and only the end of a session clears its state.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def open_life(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "ended boolean, last long")

    def is_ended(self) -> bool:
        held = self.life.get()
        return bool(held and held[0])

    def touch(self, ended: bool, rows: pd.DataFrame, timerValues) -> None:
        if self.idle_ms is None:
            if ended:
                self.life.update((True, 0))
            return
        held = self.life.get()
        last = max(int(rows["at_ms"].max()), held[1] if held else 0)
        if not held:
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.life.update((ended, last))

    def forget(self) -> None:
        """Drop what the key has gathered."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.life.get()
        if held and held[1] + self.idle_ms > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(held[1] + self.idle_ms)
        else:
            self.forget()
            self.life.clear()
        return iter([])

    def close(self) -> None:
        pass


class TokenWindows(Expiring):
    """Rolling queue of one launch stream; emits first-seen compositions."""

    def __init__(self, config: WindowConfig, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_life(handle)
        self.queue = handle.getValueState("queue", "items string, evicted long, unready long")
        self.seen = handle.getMapState("signatures", "signature string", "n int")

    def forget(self) -> None:
        self.queue.clear()
        self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, batch = self.queue.get(), _in_order(rows, "sequence")
        items, evicted, unready = (json.loads(held[0]), held[1], held[2]) if held else ([], 0, 0)
        queue = deque(tuple(x) for x in items)
        counts = Counter(k for k, _, _ in queue)
        latest = {k: r for k, _, r in queue}
        cost = sum(c for _, c, _ in queue)
        # the state is asked once per composition and batch, not at every launch
        out, met = [], set()
        for seq, ready, kernel, token_cost, ratio in batch[["sequence", "ready", "kernel_id", "token_cost", "ratio"]].itertuples(index=False):
            if not ready:
                unready += 1
                continue
            queue.append((kernel, int(token_cost), float(ratio)))
            counts[kernel] += 1
            latest[kernel] = float(ratio)
            cost += int(token_cost)
            if cost <= self.config.budget:
                continue
            best = max(latest.values())
            if not self.config.use_gate or best >= self.config.threshold:
                kernels = sorted(latest)
                top = sorted(kernels, key=lambda k: (-counts[k], k))[:3]
                composition = (*kernels, None, *top)
                signature = None if composition in met else json.dumps([kernels, top])
                met.add(composition)
                if signature and not self.seen.containsKey((signature,)):
                    self.seen.updateValue((signature,), (1,))
                    out.append((*key, evicted, evicted + len(queue) - 1, int(seq), cost, len(queue), ",".join(kernels), ",".join(top), best, unready))
            while queue and cost > self.config.budget:
                kernel, c, _ = queue.popleft()
                cost -= c
                counts[kernel] -= 1
                if not counts[kernel]:
                    del counts[kernel], latest[kernel]
                evicted += 1
        self.queue.update((json.dumps(list(queue)), evicted, unready))
        self.touch(False, batch, timerValues)
        names = [f.strip().split(" ")[0] for f in WINDOW_SCHEMA.split(",")]
        yield pd.DataFrame(out, columns=names)


def _started(rows: DataFrame, columns: list[str], keys: list[str], make: Callable[[int | None], Expiring], schema: str, time: str | None, idle_ms: int, delay: str) -> DataFrame:
    """The stream operator over ``columns``; with a column ``time`` (nanoseconds), silent keys expire and rows later than ``delay`` are dropped."""
    if time is None:
        return rows.select(*columns).groupBy(*keys).transformWithStateInPandas(make(None), schema, "Append", "None")
    timed = rows.select(*columns, F.expr(f"`{time}` div 1000000").alias("at_ms"), F.timestamp_micros(F.expr(f"`{time}` div 1000")).alias("at")).withWatermark("at", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(make(idle_ms), schema, "Append", "EventTime")


def stream_token_windows(launches: DataFrame, config: WindowConfig, time: str | None = None, idle_ms: int = IDLE_MS, delay: str = DELAY) -> DataFrame:
    columns = [*STREAM_KEYS, "sequence", "ready", "kernel_id", "token_cost", "ratio"]
    return _started(L.launch_readiness(launches), columns, STREAM_KEYS, lambda idle: TokenWindows(config, idle), WINDOW_SCHEMA, time, idle_ms, delay)


READY_SCHEMA = "session_id string, sequence long, ready boolean, artifact string, dropped_so_far long"


class KernelReadiness(Expiring):
    """A launch is usable once an artifact of its code object has arrived; the end of a session drops its artifacts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_life(handle)
        self.artifacts = handle.getMapState("artifacts", "code_id long", "names string")
        self.dropped = handle.getValueState("dropped", "n long")

    def forget(self) -> None:
        self.artifacts.clear()
        self.dropped.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, ended = self.dropped.get(), self.is_ended()
        dropped, out = (held[0] if held else 0), []
        known: dict[int, list[str]] = {}
        batch = _in_order(rows, "sequence")
        for kind, seq, code, name in batch[["type", "sequence", "code_id", "kernel_name"]].itertuples(index=False):
            if ended:
                break
            if kind == "session_end":
                ended = True
                continue
            code = int(code)
            if code not in known:
                known[code] = json.loads(self.artifacts.getValue((code,))[0]) if self.artifacts.containsKey((code,)) else []
            if kind == "code":
                if name not in known[code]:
                    known[code].append(name)
                    self.artifacts.updateValue((code,), (json.dumps(known[code]),))
                continue
            hit = match_name(name or "", known[code])
            dropped += hit is None
            out.append((key[0], int(seq), hit is not None, hit, dropped))
        self.touch(ended, batch, timerValues)
        if ended:
            self.forget()
        else:
            self.dropped.update((dropped,))
        yield pd.DataFrame(out, columns=["session_id", "sequence", "ready", "artifact", "dropped_so_far"])


def match_name(name: str, candidates: list[str]) -> str | None:
    """Name ladder over names without bodies: equal, folded, substring, first."""
    fold = lambda s: s.replace("\r\n", "\n").replace("\r", "\n")
    tight = lambda s: "".join(s.split())
    target = tight(name)
    steps = (
        lambda c: c == name,
        lambda c: fold(c) == fold(name),
        lambda c: target not in ("", "$") and (target in tight(c) or tight(c) in target),
        lambda c: True,
    )
    for step in steps:
        for candidate in candidates:
            if step(candidate):
                return candidate
    return None


def stream_kernel_readiness(events: DataFrame, time: str | None = None, idle_ms: int = IDLE_MS, delay: str = DELAY) -> DataFrame:
    rows = events.where(F.col("type").isin("code", "kernel_launch", "session_end"))
    return _started(rows, ["session_id", "type", "sequence", "code_id", "kernel_name"], ["session_id"], KernelReadiness, READY_SCHEMA, time, idle_ms, delay)


LIFECYCLE_SCHEMA = "session_id string, sequence long, type string, accepted boolean"


class SessionLifecycle(Expiring):
    """Messages count until the session ends; everything later is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_life(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended, out, batch = self.is_ended(), [], _in_order(rows, "sequence")
        for seq, kind in batch[["sequence", "type"]].itertuples(index=False):
            out.append((key[0], int(seq), kind, not ended))
            ended = ended or kind == "session_end"
        self.touch(ended, batch, timerValues)
        yield pd.DataFrame(out, columns=["session_id", "sequence", "type", "accepted"])


def stream_session_lifecycle(messages: DataFrame, time: str | None = None, idle_ms: int = IDLE_MS, delay: str = DELAY) -> DataFrame:
    return _started(messages, ["session_id", "sequence", "type"], ["session_id"], SessionLifecycle, LIFECYCLE_SCHEMA, time, idle_ms, delay)


VERDICT_SCHEMA = ("session_id long, window_index long, score double, observed long, rolling_mean double, rolling_max double, "
                  "suspicious boolean, reason string, action string")


class RollingPolicy(Expiring):
    """Releases verdicts in window order over the last scores, up to the first suspicious one.

    A row without a window number ends the session: what still waits is dropped, and later rows are ignored.
    """

    def __init__(self, count: int = ROLLING_WINDOWS, mean_threshold: float = ROLLING_MEAN, max_threshold: float = ROLLING_MAX, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.count, self.mean_threshold, self.max_threshold = count, mean_threshold, max_threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_life(handle)
        self.place = handle.getValueState("place", "next long, scores string, terminal boolean")
        self.pending = handle.getMapState("pending", "window_index long", "score double, failed boolean")

    def forget(self) -> None:
        self.place.clear()
        self.pending.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.place.get()
        at, scores, terminal = (held[0], json.loads(held[1]), held[2]) if held else (0, [], False)
        waiting, ended, out, batch = {}, self.is_ended(), [], _in_order(rows, "window_index")
        for index, score in batch[["window_index", "score"]].itertuples(index=False):
            if pd.isna(index):
                ended = True
            else:
                waiting[int(index)] = None if pd.isna(score) else float(score)
        while not terminal and not ended:
            if at in waiting:
                score = waiting.pop(at)
            elif self.pending.containsKey((at,)):
                value, failed = self.pending.getValue((at,))
                score = None if failed else value
                self.pending.removeKey((at,))
            else:
                break
            at += 1
            if score is None:
                continue
            scores = (scores + [score])[-self.count:]
            mean, top = sum(scores) / len(scores), max(scores)
            terminal = mean >= self.mean_threshold and top >= self.max_threshold
            reason = "rolling_mean_and_max" if terminal else "below_rolling_mean_or_max_threshold"
            out.append((int(key[0]), at - 1, score, len(scores), mean, top, terminal, reason, "terminate" if terminal else "log"))
        self.touch(ended, batch, timerValues)
        if ended:
            self.forget()
        else:
            if terminal:
                self.pending.clear()
            else:
                for index, score in waiting.items():
                    self.pending.updateValue((index,), (0.0 if score is None else score, score is None))
            self.place.update((at, json.dumps(scores), terminal))
        yield pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in VERDICT_SCHEMA.split(",")])


def stream_rolling_policy(windows: DataFrame, time: str | None = None, idle_ms: int = IDLE_MS, delay: str = DELAY) -> DataFrame:
    return _started(windows, ["session_id", "window_index", "score"], ["session_id"], lambda idle: RollingPolicy(idle_ms=idle), VERDICT_SCHEMA, time, idle_ms, delay)
