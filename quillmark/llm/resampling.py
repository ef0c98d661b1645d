"""Quality by importance resampling.

Two generative models over hashed words and word pairs: one of the target (labelled rows of quality 1, at most TARGET
rows) and one of all raw texts. A text's log importance weight is the sum over its n-grams of the log ratio; adding
Gumbel noise from a hash of the id and keeping the largest SHARE samples without replacement in proportion to the
weights. The selection is exact at any size: rows are ranked by range partitions.

A null text is an empty one, of weight 1. Rows are the unit; rows that repeat id and text tie and rank together. Null
labels are ignored; without target rows all weights are 1. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .textkit import NOT_ALNUM, slices, windows, words

#: Hashed n-grams, most labelled rows of the target model, share of rows kept, and the count added to every n-gram.
BUCKETS, TARGET, SHARE, SMOOTH = 1 << 16, 20_000, 0.5, 1.0


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, number of its text) of all words and neighbouring pairs."""
    w = words(texts, NOT_ALNUM)
    mask = np.uint64(BUCKETS - 1)
    one = (w.hash & mask).astype(np.int64)
    if len(one) < 2:
        return one, w.doc
    pair = w.doc[1:] == w.doc[:-1]
    two = (windows(w.hash, 2)[pair] & mask).astype(np.int64)
    return np.concatenate((one, two)), np.concatenate((w.doc, w.doc[1:][pair]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            total += np.bincount(_grams(part.column("text"))[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all texts; a task and the driver see at most BUCKETS rows."""
    rows = docs.select("text").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(target))
    p = lambda c: np.log(c + SMOOTH) - np.log((c + SMOOTH).sum())
    return p(target) - p(raw)


def _weighed(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            gram, doc = _grams(part.column("text"))
            weight = np.bincount(doc, ratio[gram], part.num_rows)
            n = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("noise"), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "noise", "n_grams", "log_weight"])


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, most: int = TARGET, seed: int = 11) -> DataFrame:
    """Every row of (doc_id, text): doc_id, n_grams, log_weight, gumbel_key, sample_rank (from 1), selected."""
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    # at most ``most`` ids
    target = gram_counts(mine.join(F.broadcast(good), "doc_id", "left_semi"))
    ratio = log_ratios(target, gram_counts(mine))
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") + 0.5
    noise = -F.log(-F.log(bits / float(1 << 53)))
    rows = mine.withColumn("noise", noise).mapInArrow(lambda it: _weighed(it, ratio), "doc_id long, noise double, n_grams long, log_weight double")
    keyed = rows.withColumn("gumbel_key", F.col("log_weight") + F.col("noise")).drop("noise")
    order = [F.desc("gumbel_key"), F.asc_nulls_last("doc_id")]
    placed = ranked(keyed, order, "place")
    n = mine.select("doc_id").count()
    return placed.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("place") + 1).cast("bigint").alias("sample_rank"), (F.col("place") < F.lit(int(round(share * n)))).alias("selected"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
