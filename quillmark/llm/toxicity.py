"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from labelled rows (words and word beginnings that part
toxic from other rows), how near lexicon words stand to second-person words, capitals, punctuation and obfuscation.
Lexicon and trees are cross-fitted on at most LABELLED labelled rows: the features of a fold's rows come from a lexicon
learned from the other folds, the trees from all rows, and what scores is the lexicon of all rows; held-out rows (crc32 of the id, modulo 4, is 2) are never used. Labels, lang, source and ids
are no inputs of a score.

A null text is an empty one and gets a score as well. A null id is not held out. Of repeated labels for an id the
largest counts; null labels are ignored. Without labelled rows every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import fitted, isotonic
from .scratch import dropped, written
from .textkit import NOT_ALNUM, Words, mixed, raw_bytes, slices, words

#: Most labelled rows that a model is fitted on.
LABELLED = 20_000
#: Most entries of the learned lexicon, and most candidates for it.
LEXICON, CANDIDATES = 4_000, 60_000
#: Least rows of label 1 with an entry, and its least log odds ratio.
LEAST_ROWS, LEAST_ODDS = 3, 1.6
#: Lengths of word beginnings in bytes.
BEGINNINGS = range(4, 11)
#: Folds of the cross-fitted lexicon.
FOLDS = 4
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 5
THRESHOLD = 0.3

# Fixed word lists.
SEED = (
    "idiot moron stupid loser scum trash clown worthless pathetic disgusting dumb fool jerk imbecile cretin filth garbage vermin bastard pig rat ugly hate kill shut die freak creep coward liar "
    "connard salaud crétin abruti débile ordure minable pourriture imbécile menteur lâche "
    "dummkopf trottel arschloch idioten abschaum widerlich dreckig versager lügner feigling schwachkopf "
    "estúpido imbécil idiota basura asqueroso cobarde mentiroso payaso patético inútil escoria"
).split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes ti vosotros".split()

N_FEATURES = 18


def _hashes(list_: list[str]) -> np.ndarray:
    return np.sort(words(pa.array([" ".join(list_)]), NOT_ALNUM).hash)


def _found(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in ``known`` (sorted), or -1."""
    out = np.full(len(h), -1, dtype=np.int64)
    if not len(known):
        return out
    table = np.zeros(1 << 16, dtype=bool)
    table[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    hit = known[k] == h[maybe]
    out[maybe[hit]] = k[hit]
    return out


def keys(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lexicon keys: (numbers of words, hash) for whole words, then for beginnings of each length."""
    yield np.arange(len(w.hash)), w.hash
    length, h = w.end - w.start, np.zeros(len(w.start), dtype=np.uint64)
    at = np.arange(len(w.start))
    for k in range(BEGINNINGS.stop - 1):
        long = length[at] > k
        at, h = at[long], h[long]
        h = h * np.uint64(0x100000001B3) + w.data[w.start[at] + k].astype(np.uint64) + np.uint64(1)
        if k + 1 in BEGINNINGS:
            yield at, mixed(h ^ np.uint64((k + 1) << 56))


def _runs_per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
    return total[bounds[1:]] - total[bounds[:-1]]


def features(texts: pa.Array, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    raw, off = raw_bytes(texts)
    w = words(texts, NOT_ALNUM)
    n = np.maximum(np.diff(w.bounds), 1).astype(float)
    chars = np.maximum(np.diff(off), 1).astype(float)
    seed = _found(w.hash, _hashes(SEED)) >= 0
    weight = np.zeros(len(w.hash))
    for at, h in keys(w):
        k = _found(h, lexicon)
        hit = k >= 0
        weight[at[hit]] = np.maximum(weight[at[hit]], odds[k[hit]])
    bad = seed | (weight > 0)
    strong = weight >= 3
    you = _found(w.hash, _hashes(SECOND_PERSON)) >= 0
    place = np.where(you, np.arange(len(you)), -(10**9))
    before = np.maximum.accumulate(place) if len(place) else place
    after = np.minimum.accumulate(np.where(you, np.arange(len(you)), 10**9)[::-1])[::-1] if len(place) else place
    i = np.arange(len(you))
    near = bad & (((i - before) <= NEAR) & (before >= w.bounds[w.doc]) | ((after - i) <= NEAR) & (after < w.bounds[w.doc + 1]))
    length = w.end - w.start
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    digit = (raw >= 48) & (raw <= 57)
    per_char = lambda flags: _runs_per_doc(flags, off)
    chars_of = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    up, let, dig = chars_of(upper), chars_of(letter), chars_of(digit)
    inside = lambda c: c[w.end] - c[w.start]
    shouted = (inside(up) == length) & (length > 1)
    leet = (inside(dig) > 0) & (inside(let) > 0)
    glued = np.zeros(len(length), dtype=bool)  # single letters parted by one mark each
    if len(length) > 1:
        glued[1:] = (length[1:] == 1) & (length[:-1] == 1) & (w.start[1:] - w.end[:-1] == 1) & (raw[np.maximum(w.start[1:] - 1, 0)] != 32)
    repeat = np.zeros(len(raw), dtype=bool)
    if len(raw) > 2:
        repeat[2:] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    per_word = lambda v: _runs_per_doc(v, w.bounds)
    top = np.zeros(len(n))
    np.maximum.at(top, w.doc, weight)
    cols = [
        per_word(seed) / n, np.log1p(per_word(seed)), per_word(weight) / n, top, np.log1p(per_word(weight > 0)), per_word(strong) / n, np.log1p(per_word(strong)),
        np.log1p(per_word(weight)), per_word(near) / n, per_word(you) / n, per_char(upper) / chars, per_word(shouted) / n, per_char(raw == 33) / chars,
        per_char(NOT_ALNUM[raw] & (raw > 32)) / chars, per_word(leet) / n, per_word(glued) / n, per_char(repeat) / chars, np.log1p(np.diff(w.bounds)),
    ]
    return np.stack(cols, axis=1)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _seen(batches: Iterator[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of each fold with a key, counted once a row; with ``known`` only its keys."""
    for batch in batches:
        for part in slices(batch, "text"):
            w, fold = words(part.column("text"), NOT_ALNUM), part.column("fold").to_numpy()
            pairs = []
            for at, h in keys(w):
                if known is not None:
                    hit = _found(h, known) >= 0
                    at, h = at[hit], h[hit]
                d = w.doc[at]
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                first = np.ones(len(h), dtype=bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                pairs.append((h[first], fold[d[first]]))
            h, f = (np.concatenate(x) for x in zip(*pairs))
            k, at = np.unique(h, return_inverse=True)
            counts = np.bincount(at * FOLDS + f, minlength=len(k) * FOLDS).reshape(-1, FOLDS)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *(pa.array(c) for c in counts.T)], names=["k", *_COUNTS])


_COUNTS = [f"c{j}" for j in range(FOLDS)]


class Counts:
    """Of each candidate key the rows of either label that have it, by fold; and how many rows there are."""

    def __init__(self, sample: DataFrame):
        """From rows (text, toxic, fold): two passes; at most CANDIDATES keys come back."""
        def seen(df: DataFrame, known: np.ndarray | None) -> DataFrame:
            rows = df.select("text", "fold").mapInArrow(lambda it: _seen(it, known), ", ".join(f"{c} long" for c in ["k", *_COUNTS]))
            return rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in _COUNTS])

        total = sum((F.col(c) for c in _COUNTS[1:]), F.col(_COUNTS[0]))
        rows = sample.groupBy("fold").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") != 1).alias("n0")).collect()
        self.n1, self.n0 = np.zeros(FOLDS), np.zeros(FOLDS)
        for r in rows:
            self.n1[r.fold], self.n0[r.fold] = r.n1, r.n0
        bad = seen(sample.where("toxic = 1"), None).where(total >= LEAST_ROWS).orderBy(F.desc(total), "k").limit(CANDIDATES).toPandas().sort_values("k")
        self.keys = bad["k"].to_numpy(np.int64)
        self.bad, self.clean = bad[_COUNTS].to_numpy(float), np.zeros((len(bad), FOLDS))
        if len(bad):
            clean = seen(sample.where("toxic <> 1"), np.sort(self.keys.view(np.uint64))).toPandas()
            self.clean[np.searchsorted(self.keys, clean["k"].to_numpy(np.int64))] = clean[_COUNTS].to_numpy(float)

    def lexicon(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and their log odds ratios, at most LEXICON, learned from all folds but one."""
        own = np.arange(FOLDS) != (-1 if without is None else without)
        c1, c0 = self.bad[:, own].sum(1), self.clean[:, own].sum(1)
        odds = np.log((c1 + 0.5) / (self.n1[own].sum() + 1)) - np.log((c0 + 0.5) / (self.n0[own].sum() + 1))
        best = np.lexsort((self.keys, -odds * np.sqrt(c1)))
        best = best[(odds[best] >= LEAST_ODDS) & (c1[best] >= LEAST_ROWS)][:LEXICON]
        k = self.keys[best].view(np.uint64)
        order = np.argsort(k)
        return k[order], odds[best][order]


class Model:
    def __init__(self, lexicon, odds, trees, knots):
        self.lexicon, self.odds, self.trees, self.knots = lexicon, odds, trees, knots

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        raw = self.trees.raw(features(texts, self.lexicon, self.odds))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def _feature_rows(batches: Iterator[pa.RecordBatch], lexicons: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            fold = part.column("fold").to_numpy()
            x = np.zeros((part.num_rows, N_FEATURES))
            for j in np.unique(fold):
                x[fold == j] = features(part.column("text").filter(pa.array(fold == j)), *lexicons[j])
            yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), part.column("h"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "h", "x"])


def trained(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model from at most ``most`` labelled rows that aren't held out, taken in hash order."""
    h = F.xxhash64("doc_id")
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = marked.withColumn("h", h).orderBy("h", "doc_id").limit(most)
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fold = F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int")
    # at most ``most`` small rows
    sample = written(mine.join(F.broadcast(picked), "doc_id").select("text", "toxic", "h", fold.alias("fold")), "labelled")
    counts = Counts(sample)
    lexicon, odds = counts.lexicon()
    lexicons = [counts.lexicon(j) for j in range(FOLDS)]
    rows = sample.mapInArrow(lambda it: _feature_rows(it, lexicons), "toxic int, h long, x array<double>").toPandas().sort_values("h", kind="stable")
    dropped(sample)
    y = rows["toxic"].to_numpy(float)
    if not len(rows) or not 0 < y.sum() < len(y):
        return Model(lexicon, odds, None, None)
    x, fold = np.array(rows["x"].tolist()), np.arange(len(y)) % 3
    apart = np.zeros(len(y))
    for k in range(3):
        apart[fold == k] = fitted(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, odds, fitted(x, y), isotonic(apart, y))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rest = part.drop_columns(["text"]) if part.num_columns > 1 else part
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(model.score(part.column("text")))], names=[*rest.schema.names, "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of (doc_id, text): doc_id, held_out, score, predicted."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    fields, names = docs.schema, docs.columns

    def kept(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(part.column(names.index("text"))) < THRESHOLD))

    return docs.mapInArrow(kept, fields)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
