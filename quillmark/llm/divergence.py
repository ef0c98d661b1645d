"""Source divergence audit: how far each source's use of a language's vocabulary is from the other sources'.

Relational throughout. Regexp matches (cut out at what lies between them) are exploded and counted by (lang, source,
term); a language keeps the terms of at least LEAST_DOCS of its rows; every group is crossed with its language's vocabulary by an equi-join on (lang, salt),
so that terms a source lacks count zero; pairs of sources come from a self-join on (lang, term) and are summed.

A row is a document, so rows that repeat count again. Null text, lang and source are ''. A group without terms is
there with counts of zero; where a language keeps no term, its pairs have value 0 and there are no term rows. Equal
values rank by item. Extra columns are ignored, an empty table gives an empty result. All numbers are integers:
shares are in 1 / SCALE, divisions round down, products that may pass 64 bits are decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import dropped, written

#: What parts terms: ASCII without its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: A language's vocabulary is crossed with its groups in so many parts.
SALTS = 64


def terms(text: Column) -> Column:
    # in ASCII texts A-Z are all that lower() changes, and it is faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> lang, source, term, n occurrences, d rows."""
    found = docs.select("lang", "source", terms(F.col("text")).alias("ts"))
    both = found.select("lang", "source", F.posexplode(F.array("ts", F.array_distinct("ts"))).alias("once", "ts"))
    each = both.select("lang", "source", "once", F.explode("ts").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum(F.col("once").cast("bigint")).alias("d"))


def share(n: str, total: str, vocabulary: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * vocabulary)), exactly."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + 2), wide(total) + wide(vocabulary) * 2).cast("bigint") + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares: below 64 bits, as shares are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows of (lang, source, text) -> lang, source, part, item, value, rank."""
    blank = F.lit("")
    mine = docs.select(*[F.coalesce(c, blank).alias(c) for c in ("lang", "source", "text")])
    by = written(term_counts(mine), "terms")
    kept = written(by.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).drop("d"), "vocabulary")
    used = by.drop("d").join(kept, ["lang", "term"])
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    groups = mine.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    crossed = groups.join(langs, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(kept.withColumn("salt", salt), ["lang", "salt"])
    dense = crossed.join(by.drop("d"), ["lang", "source", "term"], "left").fillna(0, ["n"])
    shares = written(dense.select("lang", "source", "term", "n", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q")), "shares")

    one, two = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p")), shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
    halves = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("value"))
    sums = halves.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(halves.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    names = mine.select("lang", "source").distinct()
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])

    over = shares.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    placed = lambda t, part: t.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    out = written(placed(pairs, "pair").unionByName(placed(over, "term").where(F.col("rank") <= top)), "audit")
    dropped(by, kept, shares)
    return out


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p, 1 + (1000000000::HUGEINT * (lang_n + 2)) // (sum(lang_n) OVER w + 2 * count(*) OVER w) AS q FROM dense WINDOW w AS (PARTITION BY lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
over_ AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM over_) WHERE rank <= 10
"""
