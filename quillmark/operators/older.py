"""The older scorer: 40 points of format, 20 of sections and 40 of keywords; issues are codes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import numbers

# Costs of tags and of missing contacts, ranks and words that count, sections with their points and words.
TAG_COST = {"TABLES_DETECTED": 8, "CONTENT_IN_HEADER": 6, "CONTENT_IN_FOOTER": 4, "IMAGES_OR_GRAPHICS_DETECTED": 5, "SCANNED_PDF_DETECTED_OCR_NEEDED": 15, "UNSUPPORTED_FILE_TYPE": 40, "MULTI_COLUMN_LAYOUT_DETECTED": 8}
NO_LINK_RANKS = ["deck cadet", "engine cadet", "oiler", "motorman", "fitter", "ab seaman", "able seaman", "bosun", "jwko"]
SIGNS = "★➤☑■◆✓●→✗"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
PASSIVE = ["was responsible for", "were responsible for", "has been", "have been", "was involved in", "was part of"]
PRONOUNS = ["I", "my", "we", "our", "me"]
MISSPELT = ["manger", "recieved", "acheived", "responsibilty", "managment", "experiance", "comunication"]
FIGURES = r"(?i)\d+\s*(?:%|years?|months?|vessels?|crew|GRT|DWT|million|thousand)|\b(?:GRT|DWT)\s*[:-]?\s*\d"
SECTIONS = {
    "summary": (4, ["professional summary", "summary", "profile", "objective", "about me"]),
    "experience": (6, ["work experience", "experience", "employment", "sea service", "vessel experience", "work history"]),
    "education": (3, ["education", "academic", "qualification", "training", "pre-sea"]),
    "skills": (4, ["skills", "competencies", "technical skills", "key skills"]),
    "certifications": (3, ["certifications", "certificates", "certification", "licence", "license"]),
}
VERBS = "led managed built developed designed implemented delivered coordinated executed achieved improved reduced increased trained supervised operated maintained conducted performed established commanded directed navigated oversaw inspected monitored diagnosed repaired enforced streamlined served assisted gained ensured provided supported".split()
BLOCKS = {
    "summary": r"(?is)professional summary\s*\n(.+?)(?:\n[A-Z ]{4,}\n|\z)",
    "experience": r"(?is)work experience\s*\n(.+?)(?:\nskills|\ncertif|\neducation|\z)",
    "certifications": r"(?is)certif\w+\s*\n(.+?)(?:\n[A-Z ]{4,}\n|\z)",
}
FILLER = "the and for are with this that have from will been has had but not all were when can required minimum essential mandatory knowledge experience on or in of a is to must should strong good ability skills role preferred valid current active least years year month months".split()
BASE_KEYWORDS, MOST_MISSING = 20, 15


def _words(words: list[str]) -> str:
    return rf"(?U)\b(?:{'|'.join(words)})\b"


def format_findings(text: Column, contact: Column, rank: Column) -> dict[str, tuple[int, Column]]:
    """Code -> (points, whether it applies); the tags' own costs come on top."""
    has = lambda name: F.coalesce(contact[name] != "", F.lit(False))
    low = F.lower(text)
    out = {
        "EMAIL_NOT_FOUND": (5, ~has("email")),
        "PHONE_NOT_FOUND": (3, ~has("phone")),
        "LINKEDIN_URL_MISSING": (2, ~has("linkedin") & ~F.coalesce(F.lower(rank).isin(NO_LINK_RANKS), F.lit(False))),
        "SPECIAL_UNICODE_SYMBOLS_DETECTED": (4, text.rlike(f"[{SIGNS}]")),
        "INCONSISTENT_DATE_FORMAT": (3, text.rlike(r"\d{2}/\d{4}") & text.rlike(rf"(?:{MONTHS})\w*\s+\d{{4}}")),
        "PASSIVE_VOICE_DETECTED": (3, text.rlike("(?i)" + _words(PASSIVE))),
        "PERSONAL_PRONOUNS_DETECTED": (3, text.rlike(_words(PRONOUNS))),
    }
    out |= {f"SPELLING_ERROR:{w}": (2, low.contains(w)) for w in MISSPELT}
    return out | {"NO_QUANTIFIED_ACHIEVEMENTS": (3, ~text.rlike(FIGURES))}


def block(name: str, sections: Column, text: Column) -> Column:
    """A section as parsed, or else what stands below its heading in the text; empty if neither."""
    found = F.regexp_extract(text, BLOCKS[name], 1)
    found = F.trim(found, F.lit(" \t\n\r")) if name == "summary" else found
    return F.when(F.coalesce(sections[name], F.lit("")) != "", sections[name]).otherwise(found)


def section_findings(text: Column, sections: Column, skills: Column) -> dict[str, Column]:
    """Code -> whether it applies; sections that lack cost their points, the others cost none."""
    out = {}
    for name in SECTIONS:
        out[f"{name.upper()}_MISSING"] = ~_has_section(name, text, sections)
    summary, work, certificates = (block(n, sections, text) for n in BLOCKS)
    ends = F.regexp_count(summary, F.lit("[.!?]+"))
    out |= {"SUMMARY_TOO_SHORT": (summary != "") & (ends < 3), "SUMMARY_TOO_LONG": (summary != "") & (ends > 6)}
    n_skills = F.coalesce(F.size(skills), F.lit(0))
    out |= {"LOW_SKILL_COUNT": n_skills < 10, "TOO_MANY_SKILLS": n_skills > 30}
    low = F.lower(work)
    verbs = sum((F.when(low.contains(v), 1).otherwise(0) for v in VERBS), F.lit(0))
    starts = F.regexp_extract_all(work, F.lit(r"\d{2}/(\d{4})\s*[-–]"), 1)
    rising = F.exists(F.arrays_zip(starts.alias("a"), F.slice(starts, 2, 1 << 30).alias("b")), lambda p: F.coalesce(p["a"] < p["b"], F.lit(False)))
    out |= {"FEW_ACTIVE_VERBS_IN_EXPERIENCE": (work != "") & (verbs < 3), "EXPERIENCE_NOT_REVERSE_CHRONOLOGICAL": (work != "") & rising}
    return out | {"CERTS_MISSING_ACRONYM_FORMAT": (certificates != "") & ~certificates.rlike(r"\([A-Z]{2,}\)")}


def _has_section(name: str, text: Column, sections: Column) -> Column:
    low = F.lower(text)
    return F.greatest(F.coalesce(F.trim(sections[name]) != "", F.lit(False)), *[low.contains(w) for w in SECTIONS[name][1]])


def scored(rows: DataFrame, text: str, tags: str, contact: str, sections: str, skills: str, rank: str, keyword_points: Column | None = None) -> DataFrame:
    """Rows with format_score, section_score, keyword_score, total_score, grade and issues.

    Nulls count as empty; without a posting the keywords get BASE_KEYWORDS. ``contact`` and ``sections`` are maps.
    """
    empty = F.create_map().cast("map<string,string>")
    d = rows.withColumns({"_text": F.coalesce(text, F.lit("")), "_contact": F.coalesce(contact, empty), "_sections": F.coalesce(sections, empty), "_tags": F.coalesce(tags, F.array().cast("array<string>"))})
    t, s = F.col("_text"), F.col("_sections")
    form, parts = format_findings(t, F.col("_contact"), F.col(rank)), section_findings(t, s, F.col(skills))
    cost = F.create_map(*[F.lit(x) for kv in TAG_COST.items() for x in kv])
    by_tags = F.aggregate("_tags", F.lit(0), lambda a, x: a + F.coalesce(cost[x], F.lit(0)))
    lost = sum((F.when(c, p).otherwise(0) for p, c in form.values()), by_tags)
    held = sum((F.when(_has_section(n, t, s), p).otherwise(0) for n, (p, _) in SECTIONS.items()), F.lit(0))
    codes = F.concat(F.array_compact("_tags"), F.array_compact(F.array(*[F.when(c, n) for n, (_, c) in form.items()], *[F.when(c, n) for n, c in parts.items()])))
    d = d.withColumns({"format_score": F.greatest(40 - lost, F.lit(0)), "section_score": held, "keyword_score": F.lit(BASE_KEYWORDS) if keyword_points is None else F.coalesce(keyword_points, F.lit(BASE_KEYWORDS)), "issues": codes})
    d = d.withColumn("total_score", F.col("format_score") + F.col("section_score") + F.col("keyword_score"))
    return d.withColumn("grade", numbers.grade(F.col("total_score"))).drop("_text", "_contact", "_sections", "_tags")


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s-]", " ")


def _kept(clean: Column, stop: list[str]) -> Column:
    """Words of two characters or more that aren't stop words."""
    words = F.regexp_extract_all(clean, F.lit(r"(?U)(\b\w\w+\b)"), 1)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def _counts(words: list[str]) -> Counter[str]:
    """Words, and pairs of neighbours among them."""
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without their words, with sums of squares of a document's terms, of those shared with its posting, and products."""
    for batch in batches:
        sums = []
        for words, wanted in zip(batch.column("_words").to_pylist(), batch.column("_asked").to_pylist()):
            own, other = _counts(words), _counts(wanted or [])
            both = [(own[x], m) for x, m in other.items() if x in own]
            sums.append((sum(n * n for n in own.values()), sum(m * m for m in other.values()), sum(n * m for n, m in both), sum(n * n for n, _ in both), sum(m * m for _, m in both)))
        rest = batch.drop_columns(["_words", "_asked"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(list(x), pa.int64()) for x in zip(*sums))] if sums else [*rest.columns, *[pa.array([], pa.int64())] * len(_SUMS)], names=[*rest.schema.names, *_SUMS])


_SUMS = ["d2", "p2", "dot", "ds", "ps"]


def keyword_points(docs: DataFrame, key: str, text: str, of: str, postings: DataFrame, posting: str, stop: list[str]) -> DataFrame:
    """(key, match_pct, cosine_pct, keyword_points, missing) of each document against the posting that its column ``of`` names.

    Both texts count as two documents of TF-IDF, so a shared term weighs 1 and any other 1 + ln 1.5: the norms follow from
    sums of squares and what is shared. Postings are a stated table and go to the documents, whose terms are counted in
    their row: none becomes a row, and nothing is shuffled. Without a posting or words in it the points are
    BASE_KEYWORDS and the figures null. Keys are unique, of documents and of postings; rows with a null key give none.
    """
    rare = (1.0 + F.log(F.lit(1.5))) ** 2
    d = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(of).alias("_of"), _clean(F.col(text)).alias("_c"))
    p = postings.select(F.col(of).alias("_of"), _clean(F.col(posting)).alias("_c"))
    words = F.array_distinct(F.split("_c", r"(?U)\s+"))
    asks = p.select("_of", F.filter(words, lambda w: (w != "") & ~w.isin(FILLER)).alias("wanted"), _kept(F.col("_c"), stop).alias("_asked"))
    both = d.join(F.broadcast(asks), "_of", "left").select("_key", "wanted", F.array_intersect("wanted", words).alias("found"), _kept(F.col("_c"), stop).alias("_words"), "_asked")
    kinds = StructType([both.schema["_key"], both.schema["wanted"], both.schema["found"], *[StructField(x, LongType()) for x in _SUMS]])
    full = both.mapInArrow(_shared, kinds)
    norm = lambda all_, same: rare * (F.coalesce(all_, F.lit(0)) - F.coalesce(same, F.lit(0))) + F.coalesce(same, F.lit(0))
    root = F.sqrt(norm(F.col("d2"), F.col("ds")) * norm(F.col("p2"), F.col("ps")))
    wanted, found = F.col("wanted"), F.coalesce("found", F.array().cast("array<string>"))
    asked = F.coalesce(F.size(wanted) > 0, F.lit(False))
    match_pct = F.round(F.size(found) / F.size(wanted) * 100, 1)
    cosine_pct = F.round(F.coalesce(F.try_divide(F.coalesce("dot", F.lit(0)), root), F.lit(0.0)) * 100, 1)
    out = full.select("_key", F.when(asked, match_pct).alias("match_pct"), F.when(asked, cosine_pct).alias("cosine_pct"), F.slice(F.array_sort(F.array_except(F.coalesce(wanted, F.array().cast("array<string>")), found)), 1, MOST_MISSING).alias("missing"))
    blended = F.round((F.col("match_pct") * 0.7 + F.col("cosine_pct") * 0.3) * 0.4, 9)
    points = F.when(blended.isNull(), BASE_KEYWORDS).otherwise(F.least(F.lit(40), F.greatest(F.lit(0), F.floor(blended).cast("int"))))
    return out.withColumn("keyword_points", points).withColumnRenamed("_key", key)
