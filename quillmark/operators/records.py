"""Extraction and repair of record fields as Columns, and lookups in dictionaries of stated size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, tokens
from .mentions import grams

# Words that decide fields.
DENIED = ["not held", "do not have", "does not have", "not available", "never obtained"]
DEPARTMENTS = [("eto", ["eto", "electro technical", "electrical"]), ("engine", ["engine", "engineer", "oiler", "motorman", "fitter", "mechanic", "wiper"]), ("deck", ["master", "officer", "deck", "bosun", "seaman", "boatswain", "jwko"])]
CONNECTORS = ["&", "and", "or"]
_TEXTS = "array<string>"


def _full(text: Column) -> Column:
    return F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")


def person_name(text: Column, banned: list[str]) -> Column:
    """The first line up to a dash, if it has 2 to 4 words, under 40 characters, no digit, sign or banned word; else Unknown."""
    first = F.trim(F.regexp_replace(F.get(_full(text), F.lit(0)), r"\s+", " "))
    name = F.trim(F.regexp_extract(first, r"^([^–-]*)", 1))
    fits = F.size(F.split(name, " ")).between(2, 4) & (F.length(name) < 40) & ~name.rlike(r"[0-9@:/+|.]")
    for word in banned:
        fits = fits & ~F.contains(F.lower(name), F.lit(word))
    return F.when(fits, name).otherwise("Unknown")


def has_phone(text: Column) -> Column:
    """Some run of at least 7 digits whose groups aren't all parts of dates (a month, or a year)."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\+?\d[\d\s().-]{5,}\d)"), 1)
    groups = lambda r: F.regexp_extract_all(r, F.lit(r"(\d+)"), 1)
    return F.exists(runs, lambda r: (F.length(F.regexp_replace(r, r"\D", "")) >= 7) & F.exists(groups(r), lambda g: ~g.rlike(r"^(?:(?:19|20)\d{2}|0?[1-9]|1[0-2])$")))


def is_heading(line: Column, names: list[str]) -> Column:
    """A line of at most 6 words and 60 characters that is a heading's name, alone or followed by another one or a joiner."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(line, F.lit(""))), r"^[ :•|]+|[ :•|]+$", ""))
    one = "|".join(sorted((n.lower() for n in names), key=len, reverse=True))
    return (low != "") & (F.size(F.split(low, r"\s+")) <= 6) & (F.length(low) <= 60) & low.rlike(rf"(?U)^(?:{one})\s*(?:$|(?:{one})$|[^\w\s]|(?:and|y|e|et|und)\s)")


def explicitly_missing(text: Column, term: Column) -> Column:
    """The text says that the term isn't held."""
    quoted = F.regexp_replace(F.lower(term), r"([^\p{L}\p{N}_\s])", r"\\$1")
    before = F.concat(F.lit(rf"(?:{'|'.join(DENIED)})\s+(?:the\s+)?"), quoted, F.lit(r"\b"))
    after = F.concat(quoted, F.lit(r"\s+(?:not held|not available)"))
    return F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.concat(before, F.lit("|"), after))


def partial_evidence(text: Column, term: Column) -> Column:
    """The first line that has at least half of a term's two or more words, but not all; null without one."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9+.#/-]+)"), 1))
    wanted = words(term)
    share = lambda x: F.size(F.array_intersect(wanted, words(x))) / F.size(wanted)
    hit = F.filter(lines(text), lambda x: (share(x) >= 0.5) & (share(x) < 1))
    return F.when(F.size(wanted) >= 2, F.substring(F.trim(F.get(hit, F.lit(0))), 1, 300))


def real_line(line: Column) -> Column:
    """Not a bare date, not letters glued to a long number, not one or two words without digit or acronym."""
    x = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), "[​‌‍⁠﻿]", ""))
    words = F.split(x, r"\s+")
    thin = (F.size(words) <= 2) & ~x.rlike(r"\d") & ~F.exists(words, lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & (F.lower(w) != w))
    glued = ~F.contains(x, F.lit(" ")) & x.rlike(r"[A-Za-z]{2,}\d{5,}|\d{5,}[A-Za-z]{2,}")
    return (x != "") & ~x.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$") & ~glued & ~thin


def unwrapped(items: Column) -> Column:
    """Lines that end in a connector are joined to the next one; blank lines go."""
    full = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    open_end = lambda x: F.regexp_replace(F.lower(F.element_at(F.split(x, r"\s+"), -1)), r"^[.,;:]+|[.,;:]+$", "").isin(CONNECTORS)
    empty = F.array().cast(_TEXTS)
    joined = lambda done, x: F.when((F.size(done) > 0) & open_end(F.element_at(done, -1)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), F.lit(" "), x)))).otherwise(F.array_append(done, x))
    safe = lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(joined(done, x))
    return F.aggregate(full, empty, safe)


def service_rows(text: Column, role: Column) -> Column:
    """Piped rows of eight columns as array<struct<role, company, dates, bullets>>, else the first five lines as one entry."""
    empty = F.array().cast(_TEXTS)
    title = F.when(F.lower(F.coalesce(role, F.lit("unknown"))).isin("unknown", ""), "Seafarer").otherwise(F.initcap(role))
    cells = F.transform(F.filter(_full(text), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 5), lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))
    data = F.filter(cells, lambda c: ~F.lower(F.get(c, F.lit(0))).isin("company name", "company"))
    cell = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(""))
    entry = lambda company, dates, bullets: F.struct(title.alias("role"), company.alias("company"), dates.alias("dates"), bullets.alias("bullets"))
    rows = F.transform(data, lambda c: entry(cell(c, 0), F.regexp_replace(F.concat(cell(c, 5), F.lit(" - "), cell(c, 6)), r"^[ -]+|[ -]+$", ""), F.when(cell(c, 1) != "", F.array(F.concat(F.lit("Served aboard "), cell(c, 1), F.lit(".")))).otherwise(empty)))
    whole = F.array(entry(F.lit(""), F.lit(""), F.slice(_full(text), 1, 5)))
    return F.when(F.size(rows) > 0, rows).when(F.size(_full(text)) > 0, whole).otherwise(F.slice(whole, 1, 0))


def gridded(text: Column) -> Column:
    return F.exists(lines(text), lambda x: F.regexp_count(x, F.lit(r"\|")) >= 5)


def without_shared_numbers(items: Column) -> Column:
    """Of entries that share a number of 10 or more digits only the longest stays, the first of equals."""
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"(\d{10,})"), 1)
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    beaten = lambda a: F.exists(placed, lambda b: F.arrays_overlap(numbers(a["x"]), numbers(b["x"])) & ((F.length(b["x"]) > F.length(a["x"])) | ((F.length(b["x"]) == F.length(a["x"])) & (b["i"] < a["i"]))))
    return F.transform(F.filter(placed, lambda a: ~beaten(a)), lambda a: a["x"])


def without_foreign_numbers(items: Column, source: Column) -> Column:
    """Numbers of 4 or more digits that the source lacks are cut out; entries that become equal or empty go."""
    cut = lambda x: F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\d{4,})"), 1)), x, lambda a, n: F.when(F.contains(source, n), a).otherwise(F.regexp_replace(a, F.concat(F.lit(r"[|:-]?\s*\b"), n, F.lit(r"\b\s*")), F.lit(" "))))
    clean = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(cut(x), r"\s+", " "), r"^[ |-]+|[ |-]+$", ""))
    placed = F.transform(clean, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    fresh = F.filter(placed, lambda a: (a["x"] != "") & ~F.exists(placed, lambda b: (F.lower(b["x"]) == F.lower(a["x"])) & (b["i"] < a["i"])))
    return F.when(F.coalesce(source, F.lit("")) == "", items).otherwise(F.transform(fresh, lambda a: a["x"]))


def to_slots(items: Column, slots: dict[str, str]) -> Column:
    """STRUCT<kept, slots map>: entries that name a slot's word fill it, the first one wins; the others are kept."""
    hit = lambda x: F.coalesce(*[F.when(F.contains(F.lower(x), F.lit(word)), F.lit(slot)) for word, slot in slots.items()], F.lit(None).cast("string"))
    prefix = r"(?i)^\s*(?:" + "|".join(slots) + r")\S*\s*[:|-]*\s*"
    value = lambda x: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, prefix, ""), r"^[ |-]+|[ |-]+$", ""), F.lit("")), x)
    named = F.transform(items, lambda x: F.struct(hit(x).alias("slot"), value(x).alias("value"), x.alias("x")))
    found = F.filter(named, lambda s: s["slot"].isNotNull())
    first = F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, s: F.when(F.map_contains_key(m, s["slot"]), m).otherwise(F.map_concat(m, F.create_map(s["slot"], s["value"]))))
    return F.struct(F.transform(F.filter(named, lambda s: s["slot"].isNull()), lambda s: s["x"]).alias("kept"), first.alias("slots"))


def department(rank: Column) -> Column:
    low = F.trim(F.replace(F.lower(F.coalesce(rank, F.lit(""))), F.lit("_"), F.lit(" ")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(d)) for d, parts in DEPARTMENTS for part in parts], F.lit(""))


def out_of_order(text: Column) -> Column:
    """Some start year (before a dash) is earlier than the one listed next."""
    years = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d{2}/(\d{4})\s*[-–]"), 1), lambda y: y.cast("int"))
    steps = F.zip_with(years, F.slice(years, F.lit(2), F.greatest(F.size(years) - 1, F.lit(0))), lambda a, b: a < b)
    return F.exists(steps, lambda s: F.coalesce(s, F.lit(False)))


def word_budget(texts: list[Column], entries: Column) -> Column:
    """Words of all texts, and for a list of service entries 10 and 8 for each."""
    count = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))
    return sum((count(c) for c in texts), F.lit(0)) + F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, 10 + 8 * F.size(entries)).otherwise(0)


def aliases(name: Column) -> Column:
    """Names without their bracketed part, its parts between slashes, and bracketed names of at most 12 characters."""
    plain = F.trim(F.regexp_replace(name, r"\([^)]*\)", ""))
    inner = F.flatten(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), 1), lambda g: F.split(g, r"(?i)\s*(?:/|,|\bor\b)\s*")))
    every = F.concat(F.array(plain), F.split(plain, r"\s*/\s*"), F.filter(inner, lambda x: F.length(F.trim(x)) <= 12))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def keyword_scores(docs: DataFrame, key: str, text: str, keywords: DataFrame, by: list[str], weight: float = 1.0, longest: int = 4) -> DataFrame:
    """Per document and group of ``keywords`` (by columns, keyword of lower-case words): matches in order and score.

    The score is the share found in per cent times ``weight``, 100 at most; groups without a match have no row.
    Documents meet keywords by equal word runs, never by a nested loop.
    """
    total = keywords.groupBy(*by).agg(F.count_distinct("keyword").alias("_n"))
    found = grams(docs, key, text, longest).select(key, F.col("gram").alias("keyword")).join(keywords.select(*by, "keyword").distinct(), "keyword")
    hit = found.groupBy(key, *by).agg(F.sort_array(F.collect_set("keyword")).alias("matches"))
    return hit.join(total, by).withColumn("score", F.least(F.lit(100.0), F.bround(100.0 * weight * F.size("matches") / F.col("_n"), 1))).drop("_n")


def looked_up(rows: DataFrame, registry: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the registry's columns, unknown keys with the defaults; keys meet without case and outer blanks."""
    folded = lambda c: F.lower(F.trim(c))
    r = registry.withColumn("_key", folded(F.col(on))).drop(on)
    out = rows.withColumn("_key", folded(F.col(on))).join(r, "_key", "left").drop("_key")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def signals(parts: dict[str, Column]) -> Column:
    """array<struct<kind, value>> of all kinds in order; a value that came before, whatever its case, isn't repeated."""
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("value"))
    every = F.concat(*[F.transform(F.coalesce(v, F.array().cast(_TEXTS)), named(k)) for k, v in parts.items()])
    placed = F.transform(every, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    low = lambda p: F.lower(p["s"]["value"])
    first = F.filter(placed, lambda a: (low(a) != "") & ~F.exists(placed, lambda b: (low(b) == low(a)) & (b["i"] < a["i"])))
    return F.transform(first, lambda p: p["s"])


def uncovered_lines(source: Column, output: Column) -> Column:
    """Real lines of the source of whose words of 3 or more characters under 60 per cent are in the output, and no code with a digit."""
    have = tokens(output)
    words = lambda x: F.filter(tokens(x), lambda w: F.length(w) >= 3)
    share = lambda x: F.size(F.filter(words(x), lambda w: F.array_contains(have, w))) / F.greatest(F.size(words(x)), F.lit(1))
    code = lambda x: F.exists(words(x), lambda w: w.rlike("[0-9]") & w.rlike("[a-z]") & F.array_contains(have, w))
    return F.filter(_full(source), lambda x: real_line(x) & (F.size(words(x)) > 0) & (share(x) < 0.6) & ~code(x))
