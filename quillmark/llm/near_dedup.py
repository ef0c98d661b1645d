"""Near-duplicate groups with SetSketch registers.

A text's set is its distinct word shingles. REGISTERS exponentially spaced truncated minima sketch it; sketches of two
sets merge by maximum, and registers agree with about the probability of the Jaccard similarity. Bands of registers
find candidates; the joint likelihood of the counts of lower, equal and higher registers drops the hopeless ones; the
rest are confirmed on full sets. Links make components.

Rows are the unit. Rows of equal sets form one class before any pairing, whatever their ids; a class's text is read
again by the id and two hashes of the text of one of its rows, so rows that share an id, or have none, cost no more than
others. A text without words has an empty set and is linked with nothing. A null id is a smallest id only where no row of its component has one; a row is
kept if its id equals its component's. Extra columns are ignored. An empty table gives an empty result.

A pair at the threshold is missed by all bands with probability (1 - s^ROWS)^BANDS: 7e-9 at s = 0.85, 3e-6 at 0.8.
The likelihood drops a pair at the threshold only where its estimate falls SLACK standard errors short: below 1e-5, and
less for more similar pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ranks import ranked
from .scratch import dropped, written
from .textkit import mixed, shingle_sets, slices, words

ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Standard errors of the estimate by which a candidate may fall short and still be confirmed on full sets.
SLACK = 5.0
#: Members of a bucket whose pairs become rows; larger buckets are compared in blocks inside tasks.
SMALL = 12
#: Shingles and rows of one block.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 1024

_A = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))


def sketch(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes: floor(1 - log_b(least exponential)), truncated."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 256):
        np.minimum(low, (s[k : k + 256, None] * _A + _B).min(axis=0), out=low)
    least = -np.log1p(-(low >> np.uint64(11)).astype(float) / 2.0**53) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / math.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likelier(j: float, lower, equal, higher, na, nb) -> np.ndarray:
    """Slope at similarity j of the joint log-likelihood of register counts: at least 0 where its peak is at j or above."""
    u = na / (na + nb)
    v = 1 - u
    c = (BASE - 1) / BASE
    above, below = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    p = lambda x: -np.log1p(-x * c) / math.log(BASE)
    slope = lambda x: c / (1 - x * c) / math.log(BASE)
    p_up, p_down = p(above), p(below)
    s_up, s_down = -v * slope(above), -u * slope(below)
    return higher * s_up / p_up + lower * s_down / p_down - equal * (s_up + s_down) / np.maximum(1 - p_up - p_down, 1e-9)


def estimated(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """The similarity at the peak of the joint likelihood."""
    lo, hi = 0.0, min(na, nb) / max(na, nb)
    counts = [np.array([float(x)]) for x in ((a < b).sum(), (a == b).sum(), (a > b).sum())]
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if likelier(mid, *counts, float(na), float(nb))[0] >= 0 else (lo, mid)
    return lo


def floor_of(similarity: float) -> float:
    return max(0.0, similarity - SLACK * math.sqrt(similarity * (1 - similarity) / REGISTERS))


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist())


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(len(s), *_digest(s), sketch(s).tobytes()) for s in shingle_sets(words(part.column("text")), width)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h1", "h2")), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SKETCHED)[3:]))], schema=_SKETCHED)


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets of candidate classes, each once a task."""
    seen: set[int] = set()
    for batch in batches:
        own = batch.column("cid").to_pylist()
        first = [seen.add(c) or True if c not in seen else False for c in own]
        for part in slices(batch.filter(pa.array(first, pa.bool_())), "text"):
            found = [(c, s.tobytes()) for c, d, s in zip(part.column("cid").to_pylist(), zip(part.column("d1").to_pylist(), part.column("d2").to_pylist()), shingle_sets(words(part.column("text")), width)) if _digest(s) == d]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["cid", "items"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for t in batches:
        if t.num_rows:
            x, y = _matrix(t.column("sa")), _matrix(t.column("sb"))
            ok = likelier(least, (x < y).sum(1), (x == y).sum(1), (x > y).sum(1), t.column("na").to_numpy().astype(float), t.column("nb").to_numpy().astype(float)) >= 0
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok))], names=["a", "b"])


def linked(inter, na, nb, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for t in batches:
        ok = []
        for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
        if ok:
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok))], names=["a", "b"])


def _block(percent: int, least: float):
    """Links within a block, or between two blocks, of one bucket; only edges to the local component's root come out."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        band, bi, bj = key[1].as_py(), key[2].as_py(), key[3].as_py()
        cid = t.column("cid").to_numpy()
        _, at = np.unique(cid, return_index=True)
        cid, side = cid[at], t.column("block").to_numpy()[at]
        items = t.column("items").combine_chunks()
        sets = [np.frombuffer(items[int(k)].as_py(), np.uint64) for k in at]
        m = _matrix(t.column("sketch").combine_chunks().take(pa.array(at)))
        n = np.array([len(s) for s in sets], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        flags = np.zeros(int(ids.max()) + 1, dtype=np.int32)
        label = np.arange(len(cid))

        for i in range(len(cid)):
            if bi != bj and side[i] != bi:
                continue
            later = np.arange(i + 1, len(cid)) if bi == bj else np.flatnonzero(side != side[i])
            # only what isn't joined yet: rows of one component need no second link
            later = later[label[later] != label[i]]
            later = later[np.minimum(n[later], n[i]) * 100 >= percent * np.maximum(n[later], n[i])]
            if not len(later):
                continue
            eq = m[later] == m[i]
            # a pair belongs to the first band in which it agrees
            later_at = eq.reshape(len(later), BANDS, ROWS).all(2).argmax(1) == band
            later, eq = later[later_at], eq[later_at]
            if not len(later):
                continue
            less = (m[later] < m[i]).sum(1)
            same = eq.sum(1)
            later = later[likelier(least, less, same, REGISTERS - same - less, n[later].astype(float), float(n[i])) >= 0]
            own = ids[starts[i] : starts[i] + n[i]]
            flags[own] = 1
            for j in later.tolist():
                if label[j] != label[i] and linked(int(flags[ids[starts[j] : starts[j] + n[j]]].sum()), int(n[j]), int(n[i]), percent):
                    x, y = sorted((label[i], label[j]))
                    label[label == y] = x
            flags[own] = 0
        own = label != np.arange(len(cid))
        return pa.table({"a": pa.array(cid[own]), "b": pa.array(cid[label[own]])})
    return run


def near_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """Every row of (doc_id, text): doc_id, n_shingles, component_id, kept. Links: Jaccard similarity of at least ``similarity``."""
    percent = round(100 * similarity)
    least = floor_of(similarity)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    rows = written(source.mapInArrow(lambda it: _sketched(it, width), "doc_id long, h1 long, h2 long, n long, d1 long, d2 long, sketch binary"), "sketches")
    by, at = ["n", "d1", "d2"], ["doc_id", "h1", "h2"]
    # one row stands for its class: that of the least id, nulls last
    kinds = rows.where("n > 0").groupBy(*by).agg(F.min(F.struct(F.col("doc_id").isNull(), *at)).alias("rep"), F.first("sketch").alias("sketch"))
    classes = written(ranked(kinds, [F.col(c) for c in by], "cid").select(F.col("cid").cast("bigint").alias("cid"), *by, *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in at], "sketch"), "classes")
    bands = classes.select("cid", "n", F.posexplode(F.array(*[F.xxhash64(F.lit(k), F.expr(f"substring(sketch, {2 * ROWS * k + 1}, {2 * ROWS})")) for k in range(BANDS)])).alias("band", "bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    shared = written(bands.join(full, "bucket"), "buckets")
    x, y = shared.where(F.col("members") <= SMALL).alias("x"), shared.alias("y")
    near = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cid") < F.col("y.cid")) & near).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    side = lambda c, s: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(s))
    likely = written(pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").mapInArrow(lambda it: _likely(it, least), "a long, b long"), "likely")
    wide = shared.where(F.col("members") > SMALL)
    wanted = likely.select(F.col("a").alias("cid")).unionByName(likely.select(F.col("b").alias("cid"))).unionByName(wide.select("cid")).distinct().join(classes.select("cid", "d1", "d2", *[f"rep_{c}" for c in at]), "cid")
    same_row = source["doc_id"].eqNullSafe(wanted["rep_doc_id"]) & (source["h1"] == wanted["rep_h1"]) & (source["h2"] == wanted["rep_h2"])
    sets = written(source.join(wanted, same_row).select("cid", "d1", "d2", "text").mapInArrow(lambda it: _full_sets(it, width), "cid long, items binary"), "sets")
    if sets.groupBy("cid").count().where("count > 1").limit(1).count():  # equal rows of equal ids that several tasks read
        again = sets
        sets = written(again.groupBy("cid").agg(F.first("items").alias("items")), "sets")
        dropped(again)
    one = lambda c, s: sets.select(F.col("cid").alias(c), F.col("items").alias(s))
    few = likely.join(one("a", "x"), "a").join(one("b", "y"), "b").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_ROWS)).cast("int")
    dealt = wide.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cid")
    many = dealt.join(sets, "cid").join(classes.select("cid", "sketch"), "cid").groupBy("bucket", "band", "bi", "bj").applyInArrow(_block(percent, least), "a long, b long")
    links = written(few.unionByName(many), "links")
    dropped(shared, sets, likely)
    roots = components(links)
    dropped(links)
    group = classes.join(roots, classes["cid"] == roots["node"], "left").select(*by, "rep_doc_id", F.coalesce("root", "cid").alias("root"))
    least_id = group.groupBy("root").agg(F.min("rep_doc_id").alias("least_id"))
    named = group.join(least_id, "root").select(*by, F.col("least_id"))
    # classes are unique, so this keeps the rows' number; a hot class's rows are split by Spark where they are many
    out = rows.select("doc_id", *by).join(named, by, "left")
    component = F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=0.85)
