"""Rules that read each key's events in order: slots of a pool, and the earlier job of a repeated upload.

One small state a key: the open jobs of a pool (at most its limit), or the last accepted upload. The batch forms here and
the stream forms in ``streaming.keyed`` run the same steps. Times are microseconds; equal times are read by ``tie``;
events without a time are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_ROWS = pa.schema([("pool", pa.string()), ("job", pa.string()), ("at", pa.int64()), ("event", pa.string()), ("outcome", pa.string()), ("running", pa.int64())])
SLOT_DDL = "pool string, job string, at long, event string, outcome string, running long"
REPEAT_ROWS = pa.schema([("key", pa.string()), ("id", pa.string()), ("at", pa.int64()), ("earlier", pa.string())])
REPEAT_DDL = "key string, id string, at long, earlier string"


class Slots:
    """A pool admits a job while fewer than ``limit`` are open; one that stays open longer than ``span`` fails and frees its slot."""

    def __init__(self, pool: str | None, limit: int, span: int, opened: dict | None = None):
        self.pool, self.limit, self.span, self.open = pool, limit, span, dict(opened or {})

    def expired(self, now: int) -> Iterator[tuple]:
        for job in [j for j, created in self.open.items() if created < now - self.span]:
            yield self.pool, job, self.open.pop(job) + self.span, "timer", "stale", len(self.open)

    def step(self, at: int, name: str | None, event: str | None) -> Iterator[tuple]:
        """``submit`` asks for a slot; any other event ends an open job."""
        yield from self.expired(at)
        n = len(self.open)
        if event == "submit":
            outcome = "repeated" if name in self.open else "admitted" if n < self.limit else "rejected"
            if outcome == "admitted":
                self.open[name] = at
        else:
            outcome = "ignored" if self.open.pop(name, None) is None else "ended"
        yield self.pool, name, at, event, outcome, n


class Repeats:
    """An upload within ``span`` of the last accepted one of its key is turned away and told that one's id."""

    def __init__(self, key: str | None, span: int, last: tuple | None = None):
        self.key, self.span, self.last = key, span, last

    def expired(self, now: int) -> Iterator[tuple]:
        if self.last and self.last[1] < now - self.span:
            self.last = None
        return iter(())

    def step(self, at: int, name: str | None, event: str | None) -> Iterator[tuple]:
        if self.last and at <= self.last[1] + self.span:
            yield self.key, name, at, self.last[0]
        else:
            self.last = (name, at)
            yield self.key, name, at, None


def _in_order(make: Callable, schema: pa.Schema, as_of: int | None) -> Callable:
    """Batches sorted by (key, at, tie) through one state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, out = None, None, []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            for k, at, name, event in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "name", "event"))):
                if state is None or k != key:
                    if state is not None and as_of is not None:
                        out.extend(state.expired(as_of))
                    state, key = make(k), k
                out.extend(state.step(at, name, event))
            if out:
                yield flush()
                out = []
        if state is not None and as_of is not None:
            out.extend(state.expired(as_of))
        if out:
            yield flush()

    return run


def keyed(events: DataFrame, key: str, name: str, ts: str, tie: str, event: str | None = None) -> DataFrame:
    """(key, name, at, tie, event) of events that have a time."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    kind = F.col(event) if event else F.lit("submit")
    return events.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(name).cast("string").alias("name"), at.alias("at"), F.col(tie).cast("bigint").alias("tie"), kind.cast("string").alias("event"))


def _ordered(rows: DataFrame) -> DataFrame:
    # a pool's slots depend on all its earlier events, so a key is one task; it streams and holds one state
    return rows.repartition("key").sortWithinPartitions("key", "at", "tie", "name", "event")


def slots(events: DataFrame, pool: str, job: str, ts: str, tie: str, event: str, limit: int, minutes: int, as_of: int | None = None) -> DataFrame:
    """(pool, job, at, event, outcome, running) of each event in order, and of each job that went stale by ``as_of`` (microseconds).

    Outcomes are admitted, rejected, repeated, ended, ignored and stale; ``running`` counts open jobs before the event.
    """
    rows = _ordered(keyed(events, pool, job, ts, tie, event))
    return rows.mapInArrow(_in_order(lambda k: Slots(k, limit, minutes * 60_000_000), SLOT_ROWS, as_of), SLOT_DDL)


def repeats(events: DataFrame, key: str, name: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """(key, id, at, earlier): null ``earlier`` for accepted uploads, for others the accepted one that they repeat."""
    rows = _ordered(keyed(events, key, name, ts, tie))
    return rows.mapInArrow(_in_order(lambda k: Repeats(k, seconds * 1_000_000), REPEAT_ROWS, None), REPEAT_DDL)
