"""Dictionary mentions by n-gram equi-join: no nested loop over text and dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def grams(docs: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(key, pos, gram) of all runs of 1 to ``longest`` words."""
    t = docs.select(F.col(key), tokens(F.col(text)).alias("t"))
    runs = [F.col("t")]
    for n in range(2, longest + 1):  # one word more at each place; past the end null
        runs.append(F.zip_with(runs[-1], F.slice("t", F.lit(n), F.greatest(F.size("t") - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    # words are exploded once with their runs, so no row carries the whole text
    at = t.select(key, F.posexplode(F.arrays_zip(*[r.alias(f"g{k}") for k, r in enumerate(runs)])).alias("at", "g"))
    each = at.select(key, (F.col("at") + 1).cast("bigint").alias("pos"), F.explode(F.array(*[F.col("g").getField(f"g{k}") for k in range(len(runs))])).alias("gram"))
    return each.where(F.col("gram").isNotNull())


#: A word or one sign, with the blanks before it.
_TOKEN = r"((?U)\s*(?:\w+|[^\w\s]))"
#: Most first tokens of a dictionary that are held as literals to thin out places before they become rows.
LITERALS = 2_000


def spaced(text: Column) -> Column:
    """Words and single signs in lower case; those after a blank begin with one space."""
    found = F.regexp_extract_all(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(_TOKEN), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?U)^\s+", " "))


def mentions(docs: DataFrame, key: str, text: str, dictionary: DataFrame, longest: int | None = None) -> DataFrame:
    """(key, pos, term, canonical, status): spans of more than one canonical name are ambiguous.

    ``dictionary`` has term and canonical; terms may hold signs and accents and count as whole terms: no word character
    stands beside a term's word character, nor beside its sign. ``pos`` is the number of the first word or sign, from 1.
    ``longest``, the most words and signs of a term, is found from the dictionary where it isn't given.
    """
    # how many names a term has is known from the dictionary: no window over the mentions
    names = dictionary.groupBy("term").agg(F.collect_set("canonical").alias("_names"))
    terms = names.select("term", F.array_join(spaced(F.col("term")), "").alias("_form"), spaced(F.col("term")).alias("_parts"), F.explode("_names").alias("canonical"), F.when(F.size("_names") > 1, "ambiguous").otherwise("evidenced").alias("status")).where("_form <> ''")
    lengths = terms.select(F.size("_parts").alias("n"), F.get("_parts", F.lit(0)).alias("head"))
    known = lengths.agg(F.max("n").alias("most"), F.approx_count_distinct("head").alias("heads")).first()
    if not known.most:
        return docs.select(key, F.lit(0).cast("bigint").alias("pos")).where("false").crossJoin(terms.select("term", "canonical", "status").where("false"))
    heads = [r.head for r in lengths.select("head").distinct().limit(LITERALS + 1).collect()] if known.heads <= LITERALS else []
    t = docs.select(F.col(key), spaced(F.col(text)).alias("t"))
    bare = lambda x: F.ltrim(x)
    word = lambda x: F.coalesce(x.rlike(r"(?U)^\w"), F.lit(False))
    ends = lambda x: F.coalesce(x.rlike(r"(?U)\w$"), F.lit(False))
    places = F.sequence(F.lit(1), F.size("t"))
    if 0 < len(heads) <= LITERALS:  # only places where some term may begin become rows
        places = F.filter(places, lambda i: bare(F.get("t", i - 1)).isin(heads))
    at = t.where("size(t) > 0").select(key, F.inline(F.transform(places, lambda i: F.struct(i.alias("pos"), F.get("t", i - 2).alias("before"), F.slice("t", i, longest + 1 if longest else known.most + 1).alias("s")))))
    n = F.sequence(F.lit(1), F.least(F.size("s"), F.lit(longest or known.most)))
    gram = at.select(key, "pos", "before", F.get("s", F.lit(0)).alias("first"), F.inline(F.transform(n, lambda k: F.struct(bare(F.array_join(F.slice("s", 1, k), "")).alias("form"), F.get("s", k - 1).alias("last"), F.get("s", k).alias("after")))))
    # a sign at a term's edge must not touch a word
    open_left = ~(F.col("first").rlike(r"(?U)^[^\w\s]") & ends(F.col("before")))
    open_right = ~(~ends(F.col("last")) & word(F.col("after")))
    hit = gram.where(open_left & open_right).join(terms, F.col("form") == F.col("_form"))
    return hit.select(key, F.col("pos").cast("bigint").alias("pos"), "term", "canonical", "status")


def first_by_priority(found: DataFrame, key: str, priority: DataFrame) -> DataFrame:
    """Per key the canonical name of the best priority, then of the earliest place."""
    j = found.join(priority, "canonical")
    return j.groupBy(key).agg(F.min_by("canonical", F.struct("priority", "pos")).alias("canonical"))


def coverage(docs: DataFrame, key: str, text: str, wanted: DataFrame, by: str) -> DataFrame:
    """Per (key, by): share of the wanted terms found, in per cent with one digit, and the missing ones in order."""
    total = wanted.groupBy(by).agg(F.count("*").alias("n_wanted"))
    have = docs.select(F.col(key), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    hit = have.join(wanted, "term").groupBy(key, by).agg(F.count("*").alias("n_found"))
    return hit.join(total, by).withColumn("coverage", F.bround(100.0 * F.col("n_found") / F.col("n_wanted"), 1))


def missing(docs: DataFrame, key: str, text: str, wanted: DataFrame, by: str) -> DataFrame:
    """Per (key, by): the wanted terms that the text lacks, in order; every document meets every list.

    ``wanted`` is a stated dictionary: its lists become literals, so no row is shuffled.
    """
    lists = wanted.groupBy(by).agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy(by).collect()
    rows = F.array(*[F.struct(F.lit(r[by]).alias(by), F.array(*[F.lit(x) for x in r.terms]).alias("_terms")) for r in lists])
    have = docs.select(F.col(key), F.array_distinct(tokens(F.col(text))).alias("_have"))
    return have.select(key, "_have", F.inline(rows)).select(key, by, F.array_except("_terms", "_have").alias("missing"))
