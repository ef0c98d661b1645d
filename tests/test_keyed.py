"""Slots and repeated uploads: batch against plain loops, streams against batch, also after a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from quillmark.operators import slots
from quillmark.streaming import keyed

ZERO = datetime.datetime(2024, 1, 1)
SCHEMA = "pool string, job string, ts timestamp, n long, kind string"


def events(seed=1, n=220):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ts = ZERO + datetime.timedelta(seconds=rng.randrange(6 * 3600), microseconds=rng.choice([0, 1, 999_999]))
        out.append((rng.choice(["a", "a", "b", None]), f"j{rng.randrange(60)}", ts, k, rng.choice(["submit", "submit", "submit", "done", None])))
    return out + [("a", "j1", ZERO, n, "submit"), ("a", "j1", ZERO, n + 1, "submit"), ("c", None, ZERO, n + 2, "submit"), ("c", None, ZERO, n + 3, "done"), ("c", "x", None, n + 4, "submit")]


def micros(ts):
    return (ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def plain_slots(rows, limit, minutes, as_of):
    out, opened, span = [], {}, minutes * 60_000_000
    for pool, job, ts, tie, kind in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[3])):
        at, own = micros(ts), opened.setdefault(pool, {})
        for j, c in list(own.items()):
            if at - c > span:
                del own[j]
                out.append((pool, j, c + span, "timer", "stale"))
        if kind == "submit":
            what = "repeated" if job in own else "admitted" if len(own) < limit else "rejected"
            out.append((pool, job, at, kind, what))
            if what == "admitted":
                own[job] = at
        else:
            out.append((pool, job, at, kind, "ended" if job in own else "ignored"))
            own.pop(job, None)
    for pool, own in opened.items():
        out += [(pool, j, c + span, "timer", "stale") for j, c in own.items() if as_of - c > span]
    return sorted(out, key=repr)


def named(rows):
    return sorted(((r.pool, r.job, r.at, r.event, r.outcome) for r in rows), key=repr)


def test_slots_batch(spark):
    rows = events()
    as_of = micros(ZERO + datetime.timedelta(hours=8))
    got = slots.slots(spark.createDataFrame(rows, SCHEMA).repartition(3), "pool", "job", "ts", "n", "kind", 3, 30, as_of).collect()
    want = plain_slots(rows, 3, 30, as_of)
    assert named(got) == want and {w[4] for w in want} == {"admitted", "rejected", "repeated", "ended", "ignored", "stale"}
    assert all(0 <= r.running <= 3 for r in got)
    assert slots.slots(spark.createDataFrame([], SCHEMA), "pool", "job", "ts", "n", "kind", 3, 30).count() == 0


def test_repeats_batch(spark):
    rows = [("h", f"i{k}", ZERO + datetime.timedelta(hours=h), k, None) for k, h in enumerate([0, 1, 24, 24.001, 48, 72, 72.001, 49])] + [(None, "z", ZERO, 90, None), (None, "y", ZERO, 91, None)]
    got = {r.id: r.earlier for r in slots.repeats(spark.createDataFrame(rows, SCHEMA), "pool", "job", "ts", "n", 86400).collect()}
    assert got == {"i0": None, "i1": "i0", "i2": "i0", "i3": None, "i4": "i3", "i7": None, "i5": "i7", "i6": "i7", "z": None, "y": "z"}


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(keyed.PROVIDER[0])
    spark.conf.set(*keyed.PROVIDER)
    yield spark
    spark.conf.set(keyed.PROVIDER[0], old)


def streamed(spark, tmp_path, rows, make, split):
    """Rows in files, the first of them in one run of the stream, the others after a restart from its checkpoint."""
    order = sorted((r for r in rows if r[2]), key=lambda r: r[2])
    late = order[5:8]  # come after newer rows, within the delay
    parts = [order[:5] + order[8:12], late, order[12 : 12 + split], order[12 + split :], [("far", "far", order[-1][2] + datetime.timedelta(hours=9), 10**6, "submit")], [("far", "far2", order[-1][2] + datetime.timedelta(hours=9, seconds=1), 10**6, "submit")]]
    source = str(tmp_path / "in")
    run = lambda: make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    for k, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (2, len(parts) - 1):
            assert run()
    return spark.read.parquet(str(tmp_path / "out"))


def test_slot_stream_equals_batch(rocks, tmp_path):
    rows = events(3, 120)
    out = streamed(rocks, tmp_path, rows, lambda d: keyed.slots(d, "pool", "job", "ts", "n", "kind", 3, 30, "1 hour"), 40)
    got = named(out.where("pool IS NULL OR pool <> 'far'").collect())
    assert got == plain_slots(rows, 3, 30, micros(ZERO + datetime.timedelta(hours=12)))


def test_repeat_stream_equals_batch(rocks, tmp_path):
    rows = events(4, 120)
    out = streamed(rocks, tmp_path, rows, lambda d: keyed.repeats(d, "pool", "job", "ts", "n", 1800, "1 hour"), 40)
    want = slots.repeats(rocks.createDataFrame(rows, SCHEMA), "pool", "job", "ts", "n", 1800)
    pick = lambda d: sorted(map(repr, d.where(F.coalesce("key", F.lit("")) != "far").select("key", "id", "at", "earlier").collect()))
    assert pick(out) == pick(want) and any(r.earlier for r in out.collect())
