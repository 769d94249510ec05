"""A shared call budget as a stateful stream: reservations that hold over frames, batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class CallBudget(StatefulProcessor):
    """State of a key: calls reserved so far, calls that wait for a budget, and the end of the present period.

    Of a batch the calls of the least idents are reserved first, after those that wait already, in whatever frames they
    arrive: only as many candidates as there is room are held. Waiting calls are state in parts of a frame each.
    """

    def __init__(self, key: str, ident: str, kind: str, limit: int, period_ms: int | None, time: str | None):
        self.key, self.ident, self.kind, self.limit, self.period_ms, self.time = key, ident, kind, limit, period_ms, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "used long, head long, tail long")
        self.pending = handle.getMapState("pending", "part long", f"idents array<{self.kind}>")

    def _counter(self) -> tuple[int, int, int]:
        """Calls reserved, and the first part of the waiting calls and the one after the last."""
        return tuple(self.counter.get()) if self.counter.exists() else (0, 0, 0)

    def _rows(self, key, idents, first: int | None) -> pd.DataFrame:
        n = len(idents)
        numbers = pd.array(range(first, first + n), dtype="Int64") if first is not None else pd.array([None] * n, dtype="Int64")
        return pd.DataFrame({self.key: [key[0]] * n, self.ident: list(idents), "call": numbers, "status": ["exhausted" if first is None else "reserved"] * n})

    def _serve_pending(self, key, used: int, head: int, tail: int) -> Iterator[pd.DataFrame]:
        """Waiting calls take what room there is, oldest first, part by part; returns the new counter."""
        while used < self.limit and head < tail:
            waiting = list(self.pending.getValue((head,))[0])
            now, later = waiting[: self.limit - used], waiting[self.limit - used :]
            yield self._rows(key, now, used + 1)
            used += len(now)
            if later:
                self.pending.updateValue((head,), (later,))
            else:
                self.pending.removeKey((head,))
                head += 1
        return used, head, tail

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, head, tail = yield from self._serve_pending(key, *self._counter())
        room, held, earliest = self.limit - used, None, None
        for frame in rows:
            if self.time is not None and len(frame):
                t = int(frame[self.time].min().timestamp() * 1000)
                earliest = t if earliest is None else min(earliest, t)
            calls = frame[self.ident] if held is None else pd.concat([held, frame[self.ident]])
            calls = calls.sort_values(kind="stable")
            held, over = calls.iloc[:room], calls.iloc[room:].tolist()
            if over:
                self.pending.updateValue((tail,), (over,))
                tail += 1
                yield self._rows(key, over, None)
        if held is not None and len(held):
            yield self._rows(key, held.tolist(), used + 1)
            used += len(held)
        self.counter.update((used, head, tail))
        if self.period_ms is not None and earliest is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(earliest + self.period_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A new period: the counter starts again and waiting calls are served."""
        _, head, tail = self._counter()
        used, head, tail = yield from self._serve_pending(key, 0, head, tail)
        self.counter.update((used, head, tail))
        if used:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.period_ms)

    def close(self) -> None:
        pass


def call_budget(calls: DataFrame, key: str, ident: str, limit: int, period_ms: int | None = None, time: str | None = None) -> DataFrame:
    """(key, ident, call, status): the first ``limit`` calls of a key are reserved and numbered from 1.

    Calls count in order of the batches, those of a batch in order of ``ident``. Beyond the limit a call is reported as
    ``exhausted`` and stays pending: it is reserved, and reported once more, as soon as there is room, that is when the
    query starts again with a larger limit or, with ``period_ms``, when that much event time (column ``time``, which
    needs a watermark) has gone by since the period's first call. Counters and pending calls are state in the checkpoint.
    """
    kinds = dict(calls.dtypes)
    processor = CallBudget(key, ident, kinds[ident], limit, period_ms, time)
    schema = f"{key} {kinds[key]}, {ident} {kinds[ident]}, call long, status string"
    return calls.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime" if period_ms is not None else "None")


def left_to_do(work: DataFrame, reservations: DataFrame, ident: str) -> DataFrame:
    """Work without a reservation yet: exhausted calls leave it pending, as if they had not been made."""
    return work.join(reservations.filter("status = 'reserved'").select(ident), ident, "left_anti")
