"""Keyed state and timers: slots of a pool and repeated uploads as streams.

Rows wait in state until the watermark has passed them and are then read in order of time, so that the result doesn't
depend on how they came in batches; a timer at the first waiting time, and one at each open job's limit, wake a key.
A state holds the rows of one watermark delay and at most a pool's open jobs. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.slots import REPEAT_DDL, SLOT_DDL, Repeats, Slots, keyed

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_WAITING = "at bigint, tie bigint, name string, event string"


class _InOrder(StatefulProcessor):
    """Waiting rows and timers; ``load`` and ``save`` keep the rule's own state."""

    names: list[str]
    own: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.state = handle.getListState("waiting", _WAITING), handle.getValueState("state", self.own)

    def wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [(int(a), int(t), None if pd.isna(n) else n, None if pd.isna(e) else e) for a, t, n, e in zip(pdf["at"], pdf["tie"], pdf["name"], pdf["event"])]
            for row in new:
                self.waiting.appendValue(row)
            self.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        rule, out = self.load(key[0]), []
        for at, _, name, event in due:
            out.extend(rule.step(at, name, event))
        out.extend(rule.expired(now))
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.wake(rest[0][0])
        self.save(rule)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class _SlotStream(_InOrder):
    names, own = [c.split()[0] for c in SLOT_DDL.split(", ")], "jobs array<string>, created array<bigint>"

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def load(self, pool: str | None) -> Slots:
        jobs, created = self.state.get() if self.state.exists() else ([], [])
        return Slots(pool, self.limit, self.span, dict(zip(jobs, created)))

    def save(self, rule: Slots) -> None:
        if not rule.open:
            self.state.clear()
            return
        self.state.update((list(rule.open), [int(x) for x in rule.open.values()]))
        for created in rule.open.values():
            self.wake(int(created) + self.span + 1)


class _RepeatStream(_InOrder):
    names, own = [c.split()[0] for c in REPEAT_DDL.split(", ")], "id string, at bigint"

    def __init__(self, span: int):
        self.span = span

    def load(self, key: str | None) -> Repeats:
        return Repeats(key, self.span, tuple(self.state.get()) if self.state.exists() else None)

    def save(self, rule: Repeats) -> None:
        if rule.last is None:
            self.state.clear()
            return
        self.state.update((rule.last[0], int(rule.last[1])))
        self.wake(int(rule.last[1]) + self.span + 1)


def _watched(events: DataFrame, key: str, name: str, ts: str, tie: str, event: str | None, delay: str) -> DataFrame:
    rows = keyed(events, key, name, ts, tie, event).withColumn("seen", F.timestamp_micros("at"))
    return rows.withWatermark("seen", delay)


def slots(events: DataFrame, pool: str, job: str, ts: str, tie: str, event: str, limit: int, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """The rows of ``operators.slots.slots`` as the watermark passes them."""
    rows = _watched(events, pool, job, ts, tie, event, delay)
    return rows.groupBy("key").transformWithStateInPandas(_SlotStream(limit, minutes * 60_000_000), SLOT_DDL, "Append", "EventTime")


def repeats(events: DataFrame, key: str, name: str, ts: str, tie: str, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """The rows of ``operators.slots.repeats`` as the watermark passes them: turned-away uploads carry the earlier id."""
    rows = _watched(events, key, name, ts, tie, None, delay)
    return rows.groupBy("key").transformWithStateInPandas(_RepeatStream(seconds * 1_000_000), REPEAT_DDL, "Append", "EventTime")
