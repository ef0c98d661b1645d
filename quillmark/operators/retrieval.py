"""Lexical retrieval, rank fusion and ranking metrics."""

from __future__ import annotations

import math
import re
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens

_TERM = re.compile("[a-z0-9]+")
#: About how many query vectors, and how many others, meet in one group.
QUERY_BLOCK = 10_000


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): partial sums leave the map side, so a hot term stays small."""
    return docs.select(F.col(key), F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_key, doc_key, score) over documents that share a term with the query; both sides have a ``text``."""
    tf = term_counts(docs, doc_key, "text")
    length = tf.groupBy(doc_key).agg(F.sum("tf").alias("dl"))
    stats = docs.agg(F.count("*").alias("n")).crossJoin(length.agg(F.sum("dl").alias("total")))
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    df = tf.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # stats is one row
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("total") / F.col("n")).alias("avg_dl"))
    hit = asked.join(idf, "term").join(tf, "term").join(length, doc_key)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return hit.groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


#: Cells of the term by query matrix of one block of queries.
CELLS = 1 << 24


def bm25_top(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, most: int, digits: int = 4, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_key, doc_key, score, rank): the best ``most`` documents of each stated query by score of ``digits`` digits, then by key.

    The queries' terms are counted over all documents; then every document is scored against all queries in its task, and
    only a task's best few of each query leave it, so no (query, document) pairs are shuffled however common a term is.
    """
    spark = docs.sparkSession
    tf = term_counts(docs, doc_key, "text")
    asked = queries.select(F.col(query_key).cast("bigint").alias("q"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where("q IS NOT NULL")
    df = {r.term: r.df for r in tf.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}
    n, total = docs.agg(F.count("*"), F.sum(F.size(tokens(F.col("text"))))).first()
    stated: dict[int, list[str]] = {}
    for r in asked.toLocalIterator():
        if r.term in df:
            stated.setdefault(r.q, []).append(r.term)
    blocks: list[tuple[list[int], dict[str, int], np.ndarray]] = []
    ids: list[int] = []
    terms: dict[str, int] = {}

    def close() -> None:
        m = np.zeros((len(terms), len(ids)))
        for j, q in enumerate(ids):
            for term in stated[q]:
                m[terms[term], j] = np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
        blocks.append((list(ids), dict(terms), m))

    for q in sorted(stated):
        new = [x for x in stated[q] if x not in terms]
        if ids and (len(ids) + 1) * (len(terms) + len(new)) > CELLS:
            close()
            ids, terms, new = [], {}, stated[q]
        terms.update({x: len(terms) + k for k, x in enumerate(new)})
        ids.append(q)
    if ids:
        close()
    mean = (total or 0) / max(n, 1)

    def scores(ids, terms, m):
        def run(batches):
            best_key, best_doc = np.zeros((0, len(ids)), dtype=np.int64), np.zeros((0, len(ids)), dtype=np.int64)
            best_score = np.zeros((0, len(ids)))
            for batch in batches:
                rows, docs_, score = [], [], []
                for d, text in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()):
                    found = _TERM.findall((text or "").lower())
                    c = Counter(x for x in map(terms.get, found) if x is not None)
                    if c:
                        at, f = np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), float, len(c))
                        score.append((f * (k1 + 1) / (f + k1 * (1 - b + b * len(found) / mean))) @ m[at])
                        docs_.append(d)
                if not score:
                    continue
                score = np.concatenate([best_score, np.array(score)])
                doc = np.concatenate([best_doc, np.repeat(np.array(docs_, dtype=np.int64)[:, None], len(ids), axis=1)])
                rows = np.concatenate([best_key, np.floor(score[len(best_key):] * 10**digits + 0.5).astype(np.int64)])
                order = np.lexsort((doc, -rows), axis=0)[:most]
                best_key, best_doc, best_score = (np.take_along_axis(x, order, 0) for x in (rows, doc, score))
            x, y = np.nonzero(best_score > 0)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[y]), pa.array(best_doc[x, y]), pa.array(best_score[x, y])], names=["q", "d", "s"])

        return run

    source = docs.where(F.col(doc_key).isNotNull()).select(F.col(doc_key).cast("bigint").alias("d"), F.col("text").alias("t"))
    few = [source.mapInArrow(scores(*block), "q long, d long, s double") for block in blocks]
    found = reduce(DataFrame.unionByName, few) if few else spark.createDataFrame([], "q long, d long, s double")
    named = found.select(F.col("q").alias(query_key), F.col("d").alias(doc_key), F.round("s", digits).alias("score"))
    return top(named, query_key, [F.desc("score"), F.col(doc_key)], most)


def top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def pair_tfidf(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Cosine of smoothed TF-IDF in the two-document corpus of each pair: idf ln(3 / (1 + df)) + 1.

    Terms are counted in their pair's row and never become rows. Texts of rows that share their keys count together; a pair
    without a term has no row, and one with a side without terms no cosine.
    """
    one = math.log(1.5) + 1  # idf of a term of one side; that of both sides is 1

    def cosines(batches):
        for batch in batches:
            at, cos = [], []
            for k, (a, b) in enumerate(zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist())):
                a, b = (Counter(x for text in texts for x in _TERM.findall(text)) for texts in (a, b))
                if a or b:
                    both = a.keys() & b.keys()
                    norm = [sum(n * n * (1 if x in both else one * one) for x, n in side.items()) for side in (a, b)]
                    at.append(k)
                    cos.append(sum(a[x] * b[x] for x in both) / (math.sqrt(norm[0]) * math.sqrt(norm[1])) if a and b else None)
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cos, pa.float64())], names=[*keys, "cosine"])

    texts = pairs.groupBy(*keys).agg(F.collect_list(F.lower(left)).alias("_a"), F.collect_list(F.lower(right)).alias("_b"))
    return texts.mapInArrow(cosines, StructType([*[pairs.schema[k] for k in keys], StructField("cosine", DoubleType())]))


def metrics(ranked: DataFrame, by: str, relevance: str, rank: str, k: int) -> DataFrame:
    """Per query: precision, recall, F1 and NDCG at k, 4 digits; gains 2^relevance - 1."""
    ideal = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(relevance), rank))
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    d = ranked.withColumn("_ideal", ideal)
    at = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1)).otherwise(0.0))
    m = d.groupBy(by).agg(F.sum(F.when((F.col(rank) <= k) & (F.col(relevance) > 0), 1).otherwise(0)).alias("hit"), F.sum((F.col(relevance) > 0).cast("int")).alias("all"), at(rank).alias("dcg"), at("_ideal").alias("idcg"))
    p, r = F.col("hit") / F.lit(float(k)), F.col("hit") / F.greatest("all", F.lit(1))
    return m.select(by, F.bround(p, 4).alias("precision_at_k"), F.bround(r, 4).alias("recall_at_k"), F.bround(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1_at_k"), F.bround(F.coalesce(F.try_divide(F.col("dcg"), F.col("idcg")), F.lit(0.0)), 4).alias("ndcg_at_k"))


def _vectors(rows: pa.Table, name: str, vector: str) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """All ids, in order, and by length of vector those without nulls: (places in the ids, vectors)."""
    rows = rows.sort_by(name)
    v = rows.column(vector).combine_chunks()
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    flat = v.flatten()
    whole = v.is_valid().to_numpy(zero_copy_only=False)
    whole[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    out = {}
    for n in np.unique(size[whole]).tolist():
        at = np.flatnonzero(whole & (size == n))
        out[n] = at, flat[first[at][:, None] + np.arange(n)]
    return rows.column(name).to_numpy(), out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves to even, of the shortest decimal form, as bround gives them."""
    y = x * 1e6
    out = np.rint(y)
    for k in np.flatnonzero(np.abs(np.abs(y - np.trunc(y)) - 0.5) < 1e-6):
        out[k] = int(Decimal(repr(float(x[k]))).scaleb(6).to_integral_value(ROUND_HALF_EVEN))
    return out / 1e6 + 0.0


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums of the rows, from the first to the last number, so that they are the same however rows are dealt."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _best(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """For each asked vector the row of another id with the best rounded cosine, the least id of equals; null if it has none."""
    if not asked.num_rows or not rows.num_rows:  # such a side has no columns
        return pa.table({"id": pa.array([], pa.int64()), "match_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    ids, queries = _vectors(asked, "id", "v")
    known, others = _vectors(rows, "match_id", "w")
    # without a cosine the least other id counts
    at = np.where(known[0] == ids, np.searchsorted(known, known[0], "right"), 0)
    found, best_id = at < len(known), known[np.minimum(at, len(known) - 1)]
    best, none = np.full(len(ids), np.nan), np.ones(len(ids), bool)
    for n in queries.keys() & others.keys():
        (qi, q), (ri, r) = queries[n], others[n]
        qn, rn = np.sqrt(_in_order(q * q)), np.sqrt(_in_order(r * r))
        lo, hi = (np.searchsorted(known[ri], ids[qi], side) for side in ("left", "right"))
        step = max(1, CELLS // 8 // len(r))
        for a in range(0, len(q), step):
            norm = qn[a : a + step, None] * rn
            with np.errstate(all="ignore"):
                cos = q[a : a + step] @ r.T / norm
            cos[np.isnan(cos)] = np.inf
            cos[norm == 0] = -np.inf
            for k in range(len(cos)):
                cos[k, lo[a + k] : hi[a + k]] = -np.inf
            # all that may be best once rounded, summed again in order
            x, y = np.nonzero((cos > -np.inf) & (cos >= cos.max(axis=1, keepdims=True) - 2e-6))
            exact = np.empty(len(x))
            for k in range(0, len(x), 1 << 16):
                i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                with np.errstate(all="ignore"):
                    exact[k : k + len(i)] = _in_order(q[a + i] * r[j]) / norm[i, j]
            real = np.isfinite(exact)
            exact[real] = _rounded(exact[real])
            # the last row of each query: the largest, of equals the least id
            order = np.lexsort((-y, np.where(np.isnan(exact), np.inf, exact), x))
            last = order[np.append(x[order][1:] != x[order][:-1], True)] if len(order) else order
            at = qi[a + x[last]]
            best_id[at], best[at], none[at] = known[ri[y[last]]], exact[last], False
    return pa.table({"id": ids[found], "match_id": best_id[found], "similarity": pa.array(best[found], mask=none[found])})


def best_match(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Stated query vectors (id, v) against all of another table, but for the query's own id: the best cosine, the least id of equals.

    Queries are dealt into blocks of QUERY_BLOCK and the other table into as large ones. Each pair of blocks meets in one
    group, which sends on one row for each of its queries, so no (query, row) pairs become rows.
    """
    # names of their own, as both may be columns of one table
    left, right = (df.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias(name), F.col("v").alias(vector)) for df, name, vector in ((left, "id", "v"), (right, "match_id", "w")))
    a, b = (max(1, -(-df.count() // QUERY_BLOCK)) for df in (left, right))
    nth = F.monotonically_increasing_id()
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.select("id", "v", F.pmod(nth, F.lit(a)).cast("int").alias("_a")).withColumn("_b", each(b))
    rows = right.select("match_id", "w", F.pmod(nth, F.lit(b)).cast("int").alias("_b")).withColumn("_a", each(a))
    asked, rows = (df.repartition(2 * a * b, "_a", "_b").groupBy("_a", "_b") for df in (asked, rows))
    best = asked.cogroup(rows).applyInArrow(_best, "id long, match_id long, similarity double")
    m = best.groupBy("id").agg(F.max_by(F.struct("match_id", "similarity"), F.struct(F.col("similarity"), -F.col("match_id"))).alias("m"))
    return m.select("id", "m.match_id", "m.similarity", F.when(F.col("m.similarity") >= least, "possible").otherwise("none").alias("state"))
