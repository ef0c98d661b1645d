"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and of its language's commonest words is compared to the language's
reference by Jensen-Shannon distance. References come from all documents: the COMMON terms found in most rows, and over
the rows that pass the base rules the median share of each character class and the mean share of each common term; a
language with fewer than SUPPORT such rows has no reference, and its rows get the base verdict. Short texts scatter:
below LONG words a distance on characters must be beyond GROSS or come with one on words, and words alone are judged
from TERMS terms on.

Base rules fail a text of fewer than 50 words or one with more than half of its words in repeated windows of three.
Windows are told apart by 64-bit hashes within a text. Null text has no words, null lang is ''. Rows are the unit:
rows that repeat, or have a null id, get their own results. Extra columns are ignored, an empty table gives an empty
result. Shares are whole millionths, so that references don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

BLANK = r"[\x20\x09-\x0D]+"
NO_TERM = r"[\x00-\x60\x7B-\x7F]+"
SYMBOL = r"[^#*$%&|<>]+"
#: Character classes in the order they are taken off a text without blanks; what is left are symbols.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "other": r"[^\x00-\x7F]+", "mark": r"""[.,;:!?'"()\-]+"""}
COMMON, SUPPORT, LONG, TERMS = 50, 20, 120, 200
#: Distances above which a text fails: on characters, on words; in a short text on characters alone, or on words besides CHARS.
CHARS, WORDS, GROSS, SHORT_WORDS = 0.18, 0.3, 0.3, 0.37
MILLION = 1_000_000
#: Languages up to which references are broadcast (each a few KB); beyond it they are joined by a shuffle.
LANGS = 5_000


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NO_TERM), "")


def common_terms(docs: DataFrame) -> DataFrame:
    """(lang, text) -> lang, common: the COMMON terms found in most rows."""
    counts = docs.select("lang", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("lang", "term").count()
    first = Window.partitionBy("lang").orderBy(F.desc("count"), "term")
    best = counts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= COMMON)
    return best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("common"))


def by_language(docs: DataFrame, reference: DataFrame) -> DataFrame:
    few = reference.limit(LANGS + 1).count() <= LANGS
    # at most LANGS rows, or a join that splits a hot language
    return docs.join(F.broadcast(reference) if few else reference.hint("merge"), "lang", "left")


def repeated_words(words: Column, windows: Column, sorted_windows: Column) -> Column:
    """Words within windows of three that occur twice or more: windows are (hash, position), sorted."""
    same = lambda i, j: F.get(sorted_windows, j)["h"] == F.get(sorted_windows, i)["h"]
    twice = F.filter(sorted_windows, lambda x, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(same(i, i - 1), F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(covered)).cast("bigint")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text, common) -> the base counts, the size of each character class, terms and the places of common terms with their counts."""
    one = docs.select("doc_id", "lang", "text", "common", F.array_remove(F.split("text", BLANK), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.regexp_replace("text", BLANK, "").alias("left0"), terms(F.col("text")).alias("t"))
    hashes = F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    places = F.array_sort(F.filter(F.transform("t", lambda x: F.array_position("common", x).cast("int")), lambda k: k > 0))
    counts = [F.size("w").cast("bigint").alias("n_words"), F.length("left0").cast("bigint").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.size("t").alias("n_terms")]
    two = one.select("doc_id", "lang", "w", "left0", *counts, hashes.alias("h"), F.when(F.col("common").isNotNull(), places).alias("s"))
    sizes = ["n_words", "word_chars", "n_dup_lines", "n_terms"]
    for k, (name, pattern) in enumerate(CLASSES.items()):
        two = two.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", pattern, "")).withColumn(name, F.length(f"left{k}") - F.length(f"left{k + 1}")).drop(f"left{k}")
    last = f"left{len(CLASSES)}"
    starts = F.filter(F.transform("s", lambda k, i: F.when((i == 0) | (k != F.get("s", i - 1)), F.struct(k.alias("k"), i.alias("i")))), lambda x: x.isNotNull())
    # windows are sorted only where some are equal
    again = F.size(F.array_distinct("h")) < F.size("h")
    by_hash = F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    three = two.select("doc_id", "lang", *sizes, *CLASSES, F.length(last).alias("symbol"), F.length(F.regexp_replace(last, SYMBOL, "")).cast("bigint").alias("n_symbols"), by_hash.alias("by_hash"), "w", "s", starts.alias("starts"))
    found = F.transform("starts", lambda x, i: F.struct(x["k"].alias("k"), (F.coalesce(F.get("starts", i + 1)["i"], F.size("s")) - x["i"]).alias("c")))
    repeats = F.when(F.col("by_hash").isNull(), F.lit(0).cast("bigint")).otherwise(repeated_words(F.col("w"), F.col("by_hash"), F.col("by_hash")))
    out = three.select("doc_id", "lang", *sizes, *CLASSES, "symbol", "n_symbols", repeats.alias("n_repeat_words"), F.coalesce(found, F.array().cast("array<struct<k:int,c:int>>")).alias("found"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def millionths(part: Column, whole: Column) -> Column:
    """part / whole in whole millionths, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part.cast("bigint") * MILLION / whole)).otherwise(0).cast("bigint")


def references(rows: DataFrame) -> DataFrame:
    """Features -> lang, chars (median share of each class), words (common term k -> mean share)."""
    good = rows.where("NOT base_failed")
    # shares are rounded to thousandths, so that an exact median holds at most 1,001 values
    middle = [F.percentile(F.round(F.col(c) * 1000 / F.col("word_chars")).cast("int"), 0.5).alias(c) for c in [*CLASSES, "symbol"]]
    chars = good.groupBy("lang").agg(F.count("*").alias("n"), *middle).where(F.col("n") >= SUPPORT)
    spread = good.where("n_terms > 0").select("lang", "n_terms", F.inline("found")).groupBy("lang", "k").agg(F.sum(millionths(F.col("c"), F.col("n_terms"))).alias("share"))
    words = spread.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "share"))).alias("spread"))
    shares = F.transform(F.sequence(F.lit(1), F.lit(COMMON)), lambda k: F.coalesce(F.get(F.filter("spread", lambda x: x["k"] == k), F.lit(0))["share"], F.lit(0)) / (F.col("n") * MILLION))
    total = sum((F.col(c) for c in [*CLASSES, "symbol"]), F.lit(0.0))
    return chars.join(words, "lang", "left").select("lang", F.array(*[F.col(c) / total for c in [*CLASSES, "symbol"]]).alias("chars"), shares.alias("words"))


def bits(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence, in bits."""
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return term(p) + term(q)


def distances(rows: DataFrame) -> DataFrame:
    """Features with references -> chars_distance and words_distance; null without a reference or without words."""
    share = [F.col(c) / F.col("word_chars") for c in [*CLASSES, "symbol"]]
    chars = sum((bits(p, F.get("chars", F.lit(k))) for k, p in enumerate(share)), F.lit(0.0))
    add = lambda acc, x: F.struct((acc["p"] + x["p"]).alias("p"), (acc["q"] + x["q"]).alias("q"), (acc["bits"] + bits(x["p"], x["q"])).alias("bits"))
    pairs = F.transform("found", lambda x: F.struct((x["c"] / F.col("n_terms")).alias("p"), F.get("words", x["k"] - 1).alias("q")))
    known = F.aggregate("words", F.lit(0.0), lambda acc, q: acc + q)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("p", "q", "bits")])
    # a common term that the text lacks adds its share of the reference; the rest is one bin
    words = F.aggregate(pairs, zero, add, lambda acc: acc["bits"] + (known - acc["q"]) + bits(1 - acc["p"], 1 - known))
    root = lambda x: F.sqrt(F.greatest(x / 2, F.lit(0.0)))
    return rows.withColumn("chars_distance", F.when(F.col("word_chars") > 0, root(chars))).withColumn("words_distance", F.when(F.col("n_terms") > 0, root(words)))


def judged(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, lang, text) with its counts, distances and verdict."""
    mine = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(features(by_language(mine, written(common_terms(mine), "common"))), "features")
    far = distances(by_language(rows, written(references(rows), "references")))
    short = (F.col("chars_distance") > GROSS) | ((F.col("chars_distance") > CHARS) & (F.col("words_distance") > SHORT_WORDS))
    chars = F.when(F.col("n_words") < LONG, short).otherwise(F.col("chars_distance") > CHARS)
    words = (F.col("n_terms") >= TERMS) & (F.col("words_distance") > WORDS)
    odd = F.coalesce(chars, F.lit(False)) | F.coalesce(words, F.lit(False))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~(F.col("base_failed") | odd)).alias("kept"), "chars_distance", "words_distance")


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")).drop("chars_distance", "words_distance")


#: The constants are written out, so that a wrong one shows.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w1, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) ks(k) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
x AS (SELECT r, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS s FROM d),
c AS (SELECT r, length(s) AS word_chars, length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(s, '[^a-z]', '', 'g')) AS c1, length(regexp_replace(s, '[^A-Z]', '', 'g')) AS c2, length(regexp_replace(s, '[^0-9]', '', 'g')) AS c3,
  length(regexp_replace(s, '[\x00-\x7F]', '', 'g')) AS c4, length(regexp_replace(s, '[^.,;:!?''"()\-]', '', 'g')) AS c5 FROM x),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r),
tt AS (SELECT r, lang, unnest(regexp_extract_all(lower(text), '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
nt AS (SELECT r, count(*) AS n_terms FROM tt GROUP BY r),
common AS (SELECT lang, term FROM (SELECT lang, term, count(DISTINCT r) AS n FROM tt GROUP BY lang, term) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 50),
f AS (SELECT tt.r, tt.lang, term, count(*) AS n FROM tt JOIN common USING (lang, term) GROUP BY ALL),
b AS (SELECT d.r, d.doc_id, d.lang, coalesce(n_words, 0) AS n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  c1, c2, c3, c4, c5, word_chars - c1 - c2 - c3 - c4 - c5 AS c6, coalesce(n_terms, 0) AS n_terms FROM d JOIN c USING (r) LEFT JOIN n USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r) LEFT JOIN nt USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
good AS (SELECT * FROM v WHERE NOT base_failed),
ref AS (SELECT lang, count(*) AS n, median(round(c1 * 1000 / word_chars)::INT) AS q1, median(round(c2 * 1000 / word_chars)::INT) AS q2, median(round(c3 * 1000 / word_chars)::INT) AS q3,
  median(round(c4 * 1000 / word_chars)::INT) AS q4, median(round(c5 * 1000 / word_chars)::INT) AS q5, median(round(c6 * 1000 / word_chars)::INT) AS q6 FROM good GROUP BY lang HAVING count(*) >= 20),
spread AS (SELECT f.lang, f.term, sum(f.n * 1000000 // good.n_terms) AS share FROM f JOIN good USING (r) GROUP BY ALL),
q AS (SELECT ref.lang, common.term, coalesce(share, 0) / (ref.n * 1000000.0) AS q FROM ref JOIN common USING (lang) LEFT JOIN spread ON spread.lang = ref.lang AND spread.term = common.term),
bins AS (SELECT r, unnest([c1, c2, c3, c4, c5, c6]) / word_chars AS p, unnest([q1, q2, q3, q4, q5, q6]) / (q1 + q2 + q3 + q4 + q5 + q6) AS q FROM v JOIN ref USING (lang) WHERE word_chars > 0),
dc AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS chars_distance FROM bins GROUP BY r),
known AS (SELECT v.r, coalesce(f.n, 0) / v.n_terms AS p, q.q FROM v JOIN q USING (lang) LEFT JOIN f ON f.r = v.r AND f.term = q.term WHERE v.n_terms > 0),
every AS (SELECT * FROM known UNION ALL SELECT r, 1 - sum(p), 1 - sum(q) FROM known GROUP BY r),
dw AS (SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS words_distance FROM every GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(CASE WHEN n_words < 120 THEN chars_distance > 0.3 OR (chars_distance > 0.18 AND words_distance > 0.37) ELSE chars_distance > 0.18 END, FALSE) OR coalesce(n_terms >= 200 AND words_distance > 0.3, FALSE)) AS kept
FROM v LEFT JOIN dc USING (r) LEFT JOIN dw USING (r)
"""
