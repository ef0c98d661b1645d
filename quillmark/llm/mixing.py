"""Mixing sources to target weights by the cube method.

Every source's target is shared out by weight; no target passes ``most`` times its source's size, and the excess is
shared again by weight. A row of a source is then taken floor(r) times for certain and once more with probability
r - floor(r), where r is target / source size. The flight phase of the cube method moves those probabilities through
the null space of the balancing equations (words and documents) until 0 or 1: in blocks of one source each, whose few
undecided rows go on to the next level of blocks, until one block a
source is left, whose last RESERVE rows and undecided rows land together. Words and documents of each source stay at
their totals up to that landing, which brings the words as near as that pool allows.

Rows are the unit, also if ids repeat; equal rows are counted, numbered and dealt apart, so they never fill one block.
Null or blank texts have size 0. Null sources are one source, last in order.
Draws come from hashes of ids and sizes: reruns agree. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import written

#: Rows of a block; at most two leave it undecided.
BLOCK = 4096
#: Rows of a source that wait for the landing phase, beside the undecided ones.
RESERVE = 32
_EPS = 1e-9

#: Equal rows that are numbered together.
CHUNK = 4096

_UNIT = "row_key long, doc_id long, size long, nil boolean, name string, base long, p double"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than blanks; null: 0."""
    word = r"[^\x20\x09-\x0D]+"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(word)).cast("bigint")


def flown(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase over one block: sums of p and of p * size are kept; at most two values stay between 0 and 1."""
    p = p.copy()
    draws = rng.random(len(p) + 8)
    live: list[int] = []
    at = 0
    for nxt in range(len(p)):
        if not _EPS < p[nxt] < 1 - _EPS:
            p[nxt] = round(p[nxt])
            continue
        live.append(nxt)
        if len(live) < 3:
            continue
        i, j, k = live
        u = (float(size[j] - size[k]), float(size[k] - size[i]), float(size[i] - size[j]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(live, u) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(live, u) if v)
        step = up if draws[at % len(draws)] * (up + down) < down else -down
        at += 1
        for x, v in zip(live, u):
            p[x] += step * v
            if p[x] < _EPS or p[x] > 1 - _EPS:
                p[x] = float(p[x] > 0.5)
        live = [x for x in live if 0 < p[x] < 1]
    return p


def landed(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The landing phase over a small pool: drawn by the probabilities, then one or two rows at a time are turned over while that brings the words nearer to their expectation."""
    pool = np.flatnonzero((p > 0) & (p < 1))
    x = size[pool]
    take = rng.random(len(pool)) < p[pool]
    off = float((x * (take - p[pool])).sum())
    while len(pool):
        turn = np.where(take, -x, x)
        both = off + turn[:, None] + turn[None, :]
        np.fill_diagonal(both, off + turn)
        i, j = np.unravel_index(np.abs(both).argmin(), both.shape)
        if abs(both[i, j]) >= abs(off) - 1e-6:
            break
        off = float(both[i, j])
        take[[i, j]] = ~take[[i, j]]
    out = p.copy()
    out[pool] = take
    return out


def _block(land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_key", "doc_id", "size"], kind="stable")
        rng = np.random.default_rng([int(x) & 0xFFFFFFFF for x in (pdf["row_key"].sum(), len(pdf), pdf["size"].sum())])
        p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        fly = len(p) - min(RESERVE, len(p) // 2) if land else len(p)
        p[:fly] = flown(p[:fly], size[:fly], rng)
        pdf["p"] = landed(p, size, rng) if land else p
        return pdf[["row_key", "doc_id", "size", "nil", "name", "base", "p"]]
    return run


def targets(sources: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple = (5.0, 2.0, 1.0)) -> DataFrame:
    """(nil, name, source_size) with its target: shares by weight, repeating in code point order, at most ``most`` times the size.

    Each round is one aggregate over the sources; only its three sums reach the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = written(ranked(sources, [F.col("nil"), F.col("name")], "_rank").withColumn("w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = 0.0
    while True:
        full = (F.col("w") * level >= cap) if level else (F.col("source_size") == 0)
        held, rest = s.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w")))).first()
        if not rest:
            break
        new = (total - float(held or 0)) / rest
        if new <= level * (1 + 1e-12):
            break
        level = new
    return s.select("nil", "name", "source_size", F.least(F.col("w") * level, cap).cast("double").alias("target"))


def mixed(docs: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple = (5.0, 2.0, 1.0), block: int = BLOCK) -> DataFrame:
    """Every row of (doc_id, source, size): doc_id, source, size, source_size, target, copies, taken."""
    rows = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("size").cast("bigint").alias("size"), F.col("source").isNull().alias("nil"), F.coalesce("source", F.lit("")).alias("name")), "units")
    stats = written(targets(rows.groupBy("nil", "name").agg(F.sum("size").alias("source_size")), total_share, most, weights), "targets")
    by = ["nil", "name"]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # equal rows are counted map-side and told out again by number: first in chunks, which are dealt out, then one by one
    chunks = rows.groupBy("doc_id", "size", *by).agg(F.count("*").alias("n")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK) - 1)))
    first = F.col("chunk") * CHUNK
    told = chunks.repartition("doc_id", "size", "name", "chunk").withColumn("nth", F.explode(F.sequence(first, F.least(first + CHUNK, "n") - 1)))
    # one row a source: left unhinted, so that Spark broadcasts it only below its size limit
    units = told.join(stats, by).withColumn("rate", rate).select(F.xxhash64("doc_id", "size", "name", "nth").alias("row_key"), "doc_id", "size", *by, F.floor("rate").cast("bigint").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, level = [units.where(~open_)], 0
    left = units.where(open_)
    while True:
        # written, so that Spark knows its size before it plans: a small table is broadcast and no source's rows are dealt by source
        counts = written(left.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
        salted = left.join(counts, by).withColumn("salt", F.pmod(F.xxhash64("row_key", F.lit(level)), "blocks"))
        last = (counts.agg(F.max("blocks")).first()[0] or 1) <= 1
        out = written(salted.repartition(*by, "salt").groupBy(*by, "salt").applyInPandas(_block(last), _UNIT), f"cube{level}")
        if last:
            done.append(out)
            break
        done.append(out.where(~open_))
        left, level = out.where(open_), level + 1
    flat = done[0]
    for d in done[1:]:
        flat = flat.unionByName(d)
    copies = (F.col("base") + F.round("p").cast("bigint"))
    out = flat.join(stats, by).select("doc_id", F.when(F.col("nil"), F.lit(None).cast("string")).otherwise(F.col("name")).alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return out


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken")
