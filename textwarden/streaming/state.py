"""State of the continuous jobs: rows of a key in buckets of event time, in bounded memory, with an end.

A batch may bring any number of rows of one key, in any order. They are taken
chunk by chunk and sorted into buckets of event time; beyond ``held`` rows the
buckets wait in state (on disk with RocksDB) and come back one at a time, in
order. A timer of event time clears a key once the watermark has passed all
that its state could still matter for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.budget import COST, OK, RATE, decide_part
from ..operators.risk import HOUR_US

MINUTE_US = 60_000_000
#: Rows of a key that a task holds in memory, besides one bucket; and rows of a result frame.
HELD = 200_000
FRAME = 10_000

_KINDS = {"bigint": np.int64, "double": np.float64}
Columns = dict[str, np.ndarray]


def _joined(parts: Sequence[Columns]) -> Columns:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _taken(columns: Columns, at: np.ndarray) -> Columns:
    return {n: c[at] for n, c in columns.items()}


class Buckets:
    """Columns of rows per bucket in a map state; written only where memory ends or a batch does."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kinds: dict[str, str]):
        self.kinds = {n: _KINDS[k] for n, k in kinds.items()}
        self.state = handle.getMapState(name, "bucket bigint", ", ".join(f"{n} array<{k}>" for n, k in kinds.items()))

    def get(self, bucket: int) -> Columns:
        if not self.state.containsKey((bucket,)):
            return {n: np.zeros(0, k) for n, k in self.kinds.items()}
        return {n: np.array(v, k) for (n, k), v in zip(self.kinds.items(), self.state.getValue((bucket,)))}

    def put(self, bucket: int, columns: Columns) -> None:
        self.state.updateValue((bucket,), tuple(columns[n].tolist() for n in self.kinds))

    def drop(self, bucket: int) -> None:
        self.state.removeKey((bucket,))


def in_order(rows: Iterator[pd.DataFrame], waiting: Buckets, bucket_us: int, held: int) -> Iterator[tuple[int, Columns]]:
    """(bucket, its rows by time) of one key's batch, earlier buckets first; ties in the order of the first column."""
    memory: dict[int, list[Columns]] = {}
    size, spilled = 0, set()
    tie = next(iter(waiting.kinds))

    def spill() -> None:
        for bucket, parts in memory.items():
            old = [waiting.get(bucket)] if bucket in spilled else []
            waiting.put(bucket, _joined([*old, *parts]))
            spilled.add(bucket)
        memory.clear()

    for pdf in rows:
        chunk = {n: pdf[n].to_numpy(k) for n, k in waiting.kinds.items()}
        bucket = chunk["us"] // bucket_us
        by = np.argsort(bucket, kind="stable")
        bucket, chunk = bucket[by], _taken(chunk, by)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                memory.setdefault(int(bucket[lo]), []).append(_taken(chunk, np.arange(lo, hi)))
        size += len(bucket)
        if size > held:
            spill()
            size = 0
    if spilled:
        spill()
    for bucket in sorted(spilled or memory):
        columns = waiting.get(bucket) if spilled else _joined(memory.pop(bucket))
        if spilled:
            waiting.drop(bucket)
        yield bucket, _taken(columns, np.lexsort((columns[tie], columns["us"])))


def frames(parts: Iterator[Columns], key: str, value) -> Iterator[pd.DataFrame]:
    """Result rows in frames of a useful size."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(next(iter(part.values())))
        if size >= FRAME:
            yield pd.DataFrame({key: value, **_joined(held)})
            held, size = [], 0
    if held:
        yield pd.DataFrame({key: value, **_joined(held)})


_FACTS = {"us": "bigint", "sev": "bigint", "pii": "bigint", "inj": "bigint", "sem": "bigint"}


class TrailingHour(StatefulProcessor):
    """Sums over the events of one actor in the hour that ends with each event.

    Kept per bucket: its events and their totals. A sum is the totals of whole
    buckets, what the bucket at the far end has after the hour began, and the
    own bucket up to the event, so two buckets are read for a bucket of events.
    """

    def __init__(self, window_us: int = HOUR_US, late_us: int = 0, bucket_us: int = MINUTE_US, held: int = HELD):
        self.window_us, self.late_us, self.bucket_us, self.held = window_us, late_us, bucket_us, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = Buckets(handle, "events", _FACTS)
        self.waiting = Buckets(handle, "waiting", {"event_id": "bigint", **_FACTS})
        self.totals = handle.getValueState("totals", "bucket array<bigint>, sums array<bigint>, newest bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from frames(self._sums(rows), "actor_hash", key[0])

    def _sums(self, rows: Iterator[pd.DataFrame]) -> Iterator[Columns]:
        names = list(_FACTS)[1:]
        totals: dict[int, np.ndarray] = {}
        newest, timer = -(2**62), None
        if self.totals.exists():
            buckets, sums, newest, timer = self.totals.get()
            totals = dict(zip(buckets, np.array(sums, np.int64).reshape(-1, len(names))))
        stored, recent = set(totals), {}

        def events_of(bucket: int) -> Columns:
            return recent[bucket] if bucket in recent else self.events.get(bucket)

        for bucket, new in in_order(rows, self.waiting, self.bucket_us, self.held):
            every = {n: new[n] for n in _FACTS}
            if bucket in totals:
                every = _joined([events_of(bucket), every])
                every = _taken(every, np.argsort(every["us"], kind="stable"))
            us, begin = new["us"], new["us"] - self.window_us
            running = {n: np.concatenate([[0], np.cumsum(every[n])]) for n in names}
            upto = np.searchsorted(every["us"], us, side="right")
            out = {n: running[n][upto] for n in names}
            far = begin // self.bucket_us
            for edge in np.unique(far).tolist():
                here = far == edge
                whole = sum((t for b, t in totals.items() if edge < b < bucket), np.zeros(len(names), np.int64))
                part = every if edge == bucket else events_of(edge) if edge in totals else None
                for k, n in enumerate(names):
                    out[n][here] += whole[k]
                    if part is not None:
                        sums = np.concatenate([[0], np.cumsum(part[n])])
                        at = np.searchsorted(part["us"], begin[here], side="left")
                        out[n][here] += -sums[at] if edge == bucket else sums[-1] - sums[at]
            yield {"event_id": new["event_id"], "us": us, **out}
            recent[bucket] = every
            totals[bucket] = np.array([running[n][-1] for n in names], np.int64)
            newest = max(newest, int(every["us"][-1]))
            first = (newest - self.window_us - self.late_us) // self.bucket_us
            for b in [b for b in totals if b < first]:
                del totals[b]
                recent.pop(b, None)
                if b in stored:
                    self.events.drop(b)
                    stored.discard(b)
            while len(recent) > 1 and sum(len(r["us"]) for r in recent.values()) > self.held:
                b = min(recent)
                self.events.put(b, recent.pop(b))
                stored.add(b)
        for b, columns in recent.items():
            self.events.put(b, columns)
        due = (newest + self.window_us) // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.totals.update((list(totals), [int(x) for t in totals.values() for x in t], newest, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            for b in self.totals.get()[0]:
                self.events.drop(b)
            self.totals.clear()
        return iter([])

    def close(self) -> None:
        pass


class Budget(StatefulProcessor):
    """Window start, accepted requests and spent cost of one actor."""

    def __init__(self, max_requests: int, window_us: int, max_cost: float, held: int = HELD):
        self.max_requests, self.window_us, self.max_cost, self.held = max_requests, window_us, max_cost, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", "start bigint, used bigint, spent double, timer bigint")
        self.waiting = Buckets(handle, "waiting", {"request_id": "bigint", "us": "bigint", "cost": "double"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from frames(self._decisions(rows), "actor", key[0])

    def _decisions(self, rows: Iterator[pd.DataFrame]) -> Iterator[Columns]:
        start, used, spent, timer = self.state.get() if self.state.exists() else (None, 0, 0.0, None)
        names = np.array([OK, RATE, COST], object)
        for _, new in in_order(rows, self.waiting, max(self.window_us, 1), self.held):
            us, i, out = new["us"], 0, []
            while i < len(us):
                if start is None or us[i] - start > self.window_us:
                    start, used, spent = int(us[i]), 0, 0.0
                j = int(np.searchsorted(us, start + self.window_us, side="right"))
                codes, used, spent = decide_part(new["cost"][i:j], used, spent, self.max_requests, self.max_cost)
                out.append(codes)
                i = j
            yield {"request_id": new["request_id"], "us": us, "decision": names[np.concatenate(out)]}
        due = (start + self.window_us) // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((start, int(used), float(spent), due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass
