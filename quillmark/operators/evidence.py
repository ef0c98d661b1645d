"""Entities with the place they stand at: spans of dictionary terms, overlaps resolved, methods united, context masked.

A dictionary has kind, canonical, term and ord (the order of a name's terms). Places count characters from 0, ends are
exclusive. Terms count as in ``mentions``: whole, in any case, a run of blanks as one. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import running_sums
from .lines import numbered
from .mentions import LITERALS, spaced

MARGIN, MOST = 80, 240
# Fixed value: what a context must not show: addresses, numbers of named documents, runs of seven digits or more.
MASKED = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|(?i:\b(?:passport|cdc|indos|document|certificate)\s*(?:no\.?\s*:|number\s*:|#|:)\s*[A-Z0-9/-]+)|\b\d{7,}\b"
_TOKEN = r"(?U)(\s*(\w+|[^\w\s]))"
_SIGN = r"(?U)^[^\w\s]"


def masked(context: Column, most: int | None = MOST) -> Column:
    """The context with its marks; cut after it, unless ``most`` is None."""
    shown = F.regexp_replace(context, MASKED, r"\[REDACTED\]")
    return shown if most is None else F.left(shown, F.lit(most))


def spans(docs: DataFrame, key: str, text: str, dictionary: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(key, kind, canonical, term, ord, start, end, surface, before, after) of every whole term.

    ``before`` and ``after`` are the ``margin`` characters beside the span. Offsets are running sums of the lengths of
    tokens, so a text is tokenised once; only places where some term may begin become rows, and these meet the
    dictionary in an equi-join. A dictionary of up to LITERALS terms goes to the rows, so that they stay where their text
    is: docs that are dealt by key aren't shuffled again by what is grouped by it.
    """
    terms = dictionary.select("kind", "canonical", "term", "ord", F.array_join(spaced(F.col("term")), "").alias("_form"), F.size(spaced(F.col("term"))).alias("_n"), F.get(spaced(F.col("term")), F.lit(0)).alias("_head")).where("_form <> ''")
    known = terms.agg(F.max("_n").alias("most"), F.approx_count_distinct("_head").alias("heads"), F.count("*").alias("terms")).first()
    most = known.most or 1
    heads = [r[0] for r in terms.select("_head").distinct().limit(LITERALS + 1).collect()] if known.heads <= LITERALS else []
    whole = F.coalesce(F.col(text), F.lit(""))
    # each token with the blanks before it, and without
    raw = docs.select(F.col(key), F.regexp_extract_all(whole, F.lit(_TOKEN), 1).alias("r"), F.regexp_extract_all(whole, F.lit(_TOKEN), 2).alias("w")).where("size(r) > 0")
    low = F.zip_with("r", "w", lambda r, w: F.when(F.length(r) > F.length(w), F.concat(F.lit(" "), F.lower(w))).otherwise(F.lower(w)))
    cut = raw.select(key, "r", F.transform("w", lambda x: F.length(x)).alias("m"), F.transform("r", lambda x: F.length(x)).alias("n"), low.alias("t"))
    at = cut.select(key, "r", "m", "t", running_sums(F.col("n")).alias("ends"))
    places = F.sequence(F.lit(1), F.size("t"))
    if 0 < len(heads) <= LITERALS:
        places = F.filter(places, lambda i: F.ltrim(F.get("t", i - 1)).isin(heads))
    start = lambda i: F.get("ends", i - 1) - F.get("m", i - 1)
    blanks = lambda i: F.length(F.get("r", i - 1)) - F.get("m", i - 1)
    first = lambda i: F.greatest(i - margin, F.lit(1))
    left = lambda i: F.right(F.concat(F.array_join(F.slice("r", first(i), i - first(i)), ""), F.left(F.get("r", i - 1), blanks(i))), F.lit(margin))
    reach = lambda i: F.get("ends", F.least(i + most - 1, F.size("t")) - 1) - start(i) + margin
    right = lambda i: F.substring(F.array_join(F.slice("r", i, F.lit(most + margin)), ""), blanks(i) + 1, reach(i).cast("int"))
    row = lambda i: F.struct(start(i).alias("start"), F.get("t", i - 2).alias("_prev"), left(i).alias("before"), right(i).alias("_tail"), F.slice("t", i, F.lit(most + 1)).alias("s"), F.slice("ends", i, F.lit(most)).alias("e"))
    rows = at.select(key, F.inline(F.transform(places, row)))
    n = F.sequence(F.lit(1), F.least(F.size("s"), F.lit(most)))
    gram = rows.select(key, "start", "before", "_prev", "_tail", F.get("s", F.lit(0)).alias("_first"), F.inline(F.transform(n, lambda k: F.struct(F.ltrim(F.array_join(F.slice("s", 1, k), "")).alias("_form"), F.get("e", k - 1).alias("end"), F.get("s", k - 1).alias("_last"), F.get("s", k).alias("_next")))))
    named = terms.drop("_n", "_head")
    hit = gram.where(_open()).join(F.broadcast(named) if known.terms <= LITERALS else named, "_form")
    size = (F.col("end") - F.col("start")).cast("int")
    return hit.select(key, "kind", "canonical", "term", "ord", "start", "end", F.substring("_tail", F.lit(1), size).alias("surface"), "before", F.substring(F.col("_tail"), size + 1, F.lit(margin)).alias("after"))


def terms_found(docs: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, kind, canonical, term) of every whole term, as ``spans`` finds them, once for each place but without it."""
    terms = dictionary.select("kind", "canonical", "term", F.array_join(spaced(F.col("term")), "").alias("_form"), F.size(spaced(F.col("term"))).alias("_n"), F.get(spaced(F.col("term")), F.lit(0)).alias("_head")).where("_form <> ''")
    known = terms.agg(F.max("_n").alias("most"), F.approx_count_distinct("_head").alias("heads"), F.count("*").alias("terms")).first()
    most = known.most or 1
    heads = [r[0] for r in terms.select("_head").distinct().limit(LITERALS + 1).collect()] if known.heads <= LITERALS else []
    # runs of blanks are made one before the text is cut, so no token needs a look of its own
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    t = docs.select(F.col(key), F.regexp_extract_all(plain, F.lit(r"(?U)( ?(?:\w+|[^\w\s]))"), 1).alias("t")).where("size(t) > 0")
    places = F.sequence(F.lit(1), F.size("t"))
    if 0 < len(heads) <= LITERALS:
        starts = [x for h in heads for x in (h, f" {h}")]
        places = F.filter(places, lambda i: F.get("t", i - 1).isin(starts))
    rows = t.select(key, F.inline(F.transform(places, lambda i: F.struct(F.get("t", i - 2).alias("_prev"), F.slice("t", i, F.lit(most + 1)).alias("s")))))
    n = F.sequence(F.lit(1), F.least(F.size("s"), F.lit(most)))
    gram = rows.select(key, "_prev", F.get("s", F.lit(0)).alias("_first"), F.inline(F.transform(n, lambda k: F.struct(F.ltrim(F.array_join(F.slice("s", 1, k), "")).alias("_form"), F.get("s", k - 1).alias("_last"), F.get("s", k).alias("_next")))))
    named = terms.drop("_n", "_head")
    # only what is a term is looked at from its sides
    hit = gram.join(F.broadcast(named) if known.terms <= LITERALS else named, "_form").where(_open())
    return hit.select(key, "kind", "canonical", "term")


def _open() -> Column:
    """Whether no word character touches a sign at the edge of a run from ``_first`` to ``_last``."""
    word = lambda c, side: F.coalesce(F.col(c).rlike(r"(?U)^\w" if side == "head" else r"(?U)\w$"), F.lit(False))
    left = ~(F.ltrim("_first").rlike(_SIGN) & word("_prev", "tail") & ~F.col("_first").startswith(" "))
    return left & ~(~word("_last", "tail") & word("_next", "head"))


def _apart(found: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with ``name``: whether the span stays where of those that overlap only the longest do.

    Only spans of one chain of overlaps meet in a list.
    """
    order = [F.col("start"), F.desc("end")]
    before = F.max("end").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("_new", (before.isNull() | (before <= F.col("start"))).cast("int"))
    chained = apart.withColumn("_chain", F.sum("_new").over(Window.partitionBy(*by).orderBy(*order, "kind", "canonical", "term").rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rest = [c for c in found.columns if c not in by]
    ranked = F.struct((F.col("start") - F.col("end")).alias("_size"), "start", "kind", "canonical", "term", *[F.col(c).alias(f"_{c}") for c in rest if c not in ("start", "kind", "canonical", "term")])
    g = chained.groupBy(*by, "_chain").agg(F.sort_array(F.collect_list(ranked)).alias("_all"))
    clash = lambda a, b: (a["start"] < b["_end"]) & (b["start"] < a["_end"])
    nth = lambda i: F.get("_all", i)
    stays = F.aggregate(F.sequence(F.lit(1), F.size("_all") - 1), F.array(F.lit(0)), lambda acc, i: F.when(F.exists(acc, lambda k: clash(nth(k), nth(i))), acc).otherwise(F.concat(acc, F.array(i))))
    g = g.withColumn("_stays", F.when(F.size("_all") == 1, F.array(F.lit(0))).otherwise(stays))
    out = g.select(*by, F.inline(F.transform("_all", lambda x, i: F.struct(x.alias("x"), F.array_contains("_stays", i).alias(name)))))
    return out.select(*by, *[F.col("x")[c if c in ("start", "kind", "canonical", "term") else f"_{c}"].alias(c) for c in rest], name)


def longest_first(found: DataFrame, by: list[str]) -> DataFrame:
    """Of spans that overlap, the longest, then the earliest, then the first by kind and name; the others go."""
    return _apart(found, by, "_stays").where("_stays").drop("_stays")


def entities(found: DataFrame, key: str, methods: dict[str, list[str] | None]) -> DataFrame:
    """Spans united over methods: one row for each key, kind, name (without case) and start.

    ``methods`` names in order of precedence ``first_term`` (of a key, kind and name the earliest span of its first term
    that occurs), ``longest_first`` and ``every_term`` with the kinds each is used for (None: all). Of one place the first
    method wins, then the longest span. A span's row is marked by all methods in turn, so the spans are found once, and
    every step groups by the key first.
    """
    d, cols, places = found, found.columns, []
    for i, (method, kinds) in enumerate(methods.items()):
        used = F.lit(True) if kinds is None else F.coalesce(F.col("kind").isin(kinds), F.lit(False))
        if method == "first_term":
            first = F.row_number().over(Window.partitionBy(key, "kind", "canonical").orderBy("ord", "start", "term"))
            d = d.withColumn(f"_by{i}", used & (first == 1))
        elif method == "longest_first":
            d = _apart(d.withColumn("_used", used), [key, "_used"], f"_by{i}").withColumn(f"_by{i}", F.col(f"_by{i}") & F.col("_used")).drop("_used")
        elif method == "every_term":
            d = d.withColumn(f"_by{i}", used)
        else:
            raise ValueError(method)
        places.append(F.when(F.col(f"_by{i}"), i))
    names = F.array(*[F.lit(m) for m in methods])
    all_ = d.withColumn("_place", F.coalesce(*places)).where("_place IS NOT NULL").select(*cols, F.get(names, F.col("_place")).alias("method"), "_place")
    rest = [c for c in all_.columns if c not in (key, "kind", "start", "_place")]
    g = all_.groupBy(key, "kind", F.lower("canonical").alias("_name"), "start").agg(F.min_by(F.struct(*rest), F.struct("_place", -F.col("end"), "canonical", "term")).alias("x"))
    e = g.select(key, "kind", "start", "x.*")
    return e.select(key, "kind", "canonical", "term", "start", "end", "surface", "method", masked(F.concat("before", "surface", "after")).alias("evidence"), F.lit("needs_verification").alias("verification"))


def snippets(docs: DataFrame, key: str, text: str, dictionary: DataFrame, most: int = 300) -> DataFrame:
    """Per key, kind and name the first line that holds one of its terms, the longest term first; trimmed, cut, then masked."""
    at = numbered(docs, key, text).withColumn("_line", F.struct(key, "line_no"))
    hit = spans(at, "_line", "line", dictionary, margin=1).select(F.col(f"_line.{key}").alias(key), F.col("_line.line_no").alias("line_no"), "kind", "canonical", "term")
    best = hit.groupBy(key, "kind", "canonical").agg(F.min(F.struct((-F.length("term")).alias("_size"), "line_no", "term")).alias("x")).select(key, "kind", "canonical", "x.line_no", "x.term")
    j = best.join(at.select(key, "line_no", "line"), [key, "line_no"])
    return j.select(key, "kind", "canonical", "term", "line_no", masked(F.left(F.trim("line"), F.lit(most)), None).alias("snippet"))


def experience(found: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Per key of ``needed`` (key, canonical): names shown and not shown, each sorted, with the evidence of the first place."""
    have = found.groupBy(key, F.lower("canonical").alias("_name")).agg(F.min_by("evidence", F.struct("start", "kind")).alias("evidence"))
    j = needed.select(key, F.lower("canonical").alias("_name")).distinct().join(have, [key, "_name"], "left")
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("_name"))))
    g = j.groupBy(key).agg(names(F.col("evidence").isNotNull()).alias("demonstrated"), names(F.col("evidence").isNull()).alias("not_evidenced"), F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct(F.col("_name").alias("name"), "evidence")))).alias("evidence"))
    return g.withColumn("status", F.lit("needs_review"))
