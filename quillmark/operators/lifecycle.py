"""Job lifecycle over an event log: latest state, stage durations, admission, stale and expired jobs, rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def latest(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """One row a key: its last event, aggregated map-side."""
    return events.groupBy(key).agg(F.max(F.struct(ts, tie, *[c for c in events.columns if c not in (key, ts, tie)])).alias("x")).select(key, "x.*")


def stage_durations(events: DataFrame, key: str, stage: str, ts: str, tie: str) -> DataFrame:
    """Each event with the seconds until the key's next one; null for the last."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.withColumn("seconds", (micros(nxt) - micros(F.col(ts))) / 1e6).select(key, tie, stage, ts, "seconds")


def admissions(events: DataFrame, by: str, ts: str, tie: str, change: Column, limit: int) -> DataFrame:
    """Running number of open jobs before each event and whether a start would be admitted."""
    w = Window.partitionBy(by).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(change).over(w), F.lit(0))
    return events.withColumn("running", n.cast("bigint")).withColumn("admitted", F.col("running") < limit)


def first_in_window(events: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Events that no accepted equal one precedes within ``seconds``, both ends included.

    An event that is turned away opens no new window. Each key's events are read in order by one task, which holds one
    time and one batch; nulls among the keys are equal, events without a time are turned away.
    """
    span = seconds * 1_000_000
    own = [f"_k{n}" for n in range(len(keys))]
    rows = events.where(F.col(ts).isNotNull()).withColumns({"_at": micros(F.col(ts)), **{o: F.col(k) for o, k in zip(own, keys)}})
    rows = rows.withColumn("_key", F.xxhash64(*[F.struct(F.col(k).isNull(), F.col(k)) for k in keys])).repartition("_key").sortWithinPartitions("_key", *own, "_at", tie)

    def accepted(batches):
        last, until = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_at").to_numpy()
            same = np.ones(batch.num_rows, dtype=bool)
            for c in own:
                v = batch.column(c)
                same[1:] &= np.array([x == y for x, y in zip(v[1:].to_pylist(), v[:-1].to_pylist())], dtype=bool) if pa.types.is_nested(v.type) else pc.fill_null(pc.equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(v[1:]).to_numpy(zero_copy_only=False) & pc.is_null(v[:-1]).to_numpy(zero_copy_only=False))
            same[0] = False
            keep = np.zeros(batch.num_rows, dtype=bool)
            cuts = np.append(np.flatnonzero(~same), batch.num_rows)
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(batch.column(c)[int(a)].as_py() for c in own)
                if key != last:
                    last, until = key, None
                k = a if until is None else a + int(np.searchsorted(at[a:b], until, "right"))
                while k < b:
                    keep[k], until = True, int(at[k]) + span
                    k = a + int(np.searchsorted(at[a:b], until, "right"))
            yield batch.select(names).filter(pa.array(keep))

    names = events.columns
    return rows.select(*names, "_at", *own).mapInArrow(accepted, events.schema)


def timed_out(latest_rows: DataFrame, ts: str, as_of: Column, minutes: int, states: list[str], state: str) -> DataFrame:
    return latest_rows.withColumn("state", F.when(F.col(state).isin(states) & (F.col(ts) < as_of - F.make_interval(mins=F.lit(minutes))), "failed").otherwise(F.col(state)))
