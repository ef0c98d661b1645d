"""Golden cases of page geometry, layered scores and dated documents."""

import datetime

from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import documents, geometry, reports, resume

WORD = "p int, text string, x0 double, x1 double, top double, bottom double"
BOX = "p int, text string, x0 double, x1 double, y0 double, y1 double"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_words(spark):
    w = spark.createDataFrame([(1, "Training00000000000000000", 0.0, 250.0, 0.0, 5.0), (1, "GRT12345", 300.0, 310.0, 2.0, 7.0), (1, "b", 50.0, 60.0, 8.5, 12.0), (1, "a", 0.0, 10.0, 9.0, 12.0), (1, None, 0.0, 1.0, 30.0, 31.0)], WORD)
    s = geometry.split_glued(w)
    got = [(r.text, r.x0, r.x1) for r in s.orderBy("top", "x0").collect()]
    assert got[0] == ("Training", 0.0, 80.0) and got[1] == ("0" * 17, 80.0, 250.0) and got[2][0] == "GRT12345" and len(got) == 6
    assert [r.line for r in geometry.text_lines(s, ["p"]).orderBy("line_no").collect()] == ["Training " + "0" * 17 + " GRT12345", "a b", ""]
    boxes = spark.createDataFrame([(1, 0.0, 100.0, 8.0, 13.0), (2, 0.0, 900.0, 0.0, 900.0)], "p int, x0 double, x1 double, top double, bottom double")
    assert {r.text for r in geometry.outside(w, boxes, ["p"]).collect()} == {"Training00000000000000000", "GRT12345", None}


def test_gutter(spark):
    rows = [(1, "l", 40.0, 170.0), (1, "r", 400.0, 490.0), (2, "l", 40.0, 345.0), (2, "r", 350.0, 600.0), (3, "l", 40.0, 330.0), (3, "r", 354.0, 650.0), (3, "bridge", 331.0, 353.0)]
    w = spark.createDataFrame(rows, "p int, text string, x0 double, x1 double")
    pages = spark.createDataFrame([(k, 700.0) for k in (1, 2, 3, 4)], "p int, width double")
    got = {r.p: (r.split, r.found) for r in geometry.gutter(w, pages, ["p"]).collect()}
    assert got == {1: (285.0, True), 2: (350.0, False), 3: (342.0, True), 4: (350.0, False)}


def test_columns(spark):
    two = [(1, "t", x, x + 200.0, 100.0 * k, 100.0 * k + 60) for k in range(4) for x in (50.0, 350.0)]
    single = [(2, "t", 50.0, 550.0, 100.0 * k, 100.0 * k + 60) for k in range(6)]
    dates = [(3, "t", x0, x1, 100.0 * k, 100.0 * k + 60) for k in range(4) for x0, x1 in ((50.0, 250.0), (500.0, 560.0))]
    under_title = [(4, "title", 50.0, 550.0, 0.0, 50.0), *[(4, *r[1:4], r[4] + 100, r[5] + 100) for r in two]]
    pages = spark.createDataFrame([(k, 600.0, 800.0) for k in range(1, 6)], "p int, width double, height double")
    got = {r.p: r.columns for r in geometry.has_columns(spark.createDataFrame(two + single + dates + under_title, BOX), pages, ["p"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_margins_tables_portraits(spark):
    b = spark.createDataFrame([("d", k, t, y, y + 10) for k in (1, 2) for t, y in (("Page  Head", 2.0), (f"only {k}", 2.0), ("body", 400.0))], "d string, p int, text string, y0 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 800.0), ("d", 2, 800.0)], "d string, p int, height double")
    assert [(r.line, r.n_pages) for r in geometry.repeated_margin_lines(b, pages, "d", "p").collect()] == [("page head", 2)]
    t = spark.createDataFrame([(1, 4, [["a", "b\nc", "d"], [None, None, None], ["e", None, "f"]]), (2, 0, [["a", "b", "c"]] * 3), (3, 4, [["a"]])], "id int, n_rules int, rows array<array<string>>")
    assert [(r.id, r.text) for r in geometry.ruled_tables(t).collect()] == [(1, "a | b c | d\ne |  | f")]
    i = spark.createDataFrame([(1, "logo", 200.0, 60.0, 10.0, 800.0), (1, "face", 80.0, 90.0, 20.0, 800.0), (1, "square low", 80.0, 80.0, 700.0, 800.0)], "d int, n string, width double, height double, y0 double, page_height double")
    assert [r.n for r in geometry.portrait(i, "d").collect()] == ["face"]


def test_scores(spark):
    title = lambda r, h, s: one(spark, resume.title_match(F.lit(r), F.lit(h), F.lit(s)))
    assert title("Deck Officer", "Senior deck officer", "") == 100 and title("Deck Officer", "x", "A deck officer.") == 75
    assert title("Deck Officer", "Deck hand", None) == 25 and title(" ", "x", "x") is None and title("C++", "c++ and c", "") == 100
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    assert one(spark, resume.skills_coverage(words("Python", "Rust", "GMDSS", "GMDSS"), words("python"), F.lit("holds gmdss"))) == 75.0
    assert one(spark, resume.skills_coverage(F.array().cast("array<string>"), words("a"), F.lit("a"))) == 0.0
    assert one(spark, resume.date_consistency(F.lit("Jan 2020 - Mar 2021, 05/2022 and 2019"))) == 50.0 and one(spark, resume.date_consistency(F.lit("2019"))) is None
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, resume.section_completeness(yes, yes, yes, yes, yes, F.lit(0))) == 100 and one(spark, resume.section_completeness(no, no, no, no, yes, F.lit(2))) == 60 and one(spark, resume.section_completeness(no, no, no, no, no, F.lit(2))) == 50
    parts = {k: F.lit(v).cast("double") for k, v in {"keyword_match": 50, "skills_coverage": 100, "title_match": None, "section_completeness": 100, "date_consistency": None}.items()}
    assert one(spark, resume.overall(parts)) == 73.3
    assert one(spark, resume.recommendations(parts, F.lit("cook"), words("a"), F.array().cast("array<string>"))) == ["missing_keywords"]
    assert one(spark, resume.in_posting_order(words("z", "b", "A"), words("B", "a"))) == ["b", "A", "z"]


def test_service_and_rewrites(spark):
    words = lambda *x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
    r = one(spark, resume.service_score(F.lit("chief officer"), words("A", "B", "C", "D"), words("A", "B", "C", "D"), F.lit(84), F.lit(36), words("chemical tanker")))
    assert (r.score, r.grade, r.bonus, r.coverage) == (79, "STRONG", 14, "4/4")
    r = one(spark, resume.service_score(F.lit("unknown"), words("STCW", "ENG1"), words(), F.lit(0), F.lit(6), words()))
    assert (r.score, r.grade, r.missing, r.coverage) == (0, "WEAK", ["STCW", "ENG1"], "0/2")
    v = lambda b, a, add, gone: one(spark, resume.rewrite_verdict(F.lit(b).cast("int"), F.lit(a), words(*add), words(*gone)))
    assert [v(50, 60, ["HUET"], []), v(50, 60, [], ["BOSIET"]), v(50, 60, [], []), v(50, 50, [], []), v(50, 40, [], []), v(None, 40, [], [])] == ["factual_integrity_risk", "degraded", "improved", "neutral", "degraded", None]
    assert one(spark, resume.output_warnings(words("GMDSS | Year"), words(), F.lit(None).cast("array<string>"), F.lit(" "))) == ["placeholder", "no_experience", "few_skills", "no_summary"]
    on = lambda t, r, d: one(spark, resume.overlay_active(F.lit(t), F.lit(r), F.lit(None).cast("string"), F.lit(d), ["deck_officer"], ["generic", "none"]))
    assert [on("generic", "", "master"), on("generic", "master", ""), on("", "", "unknown"), on("", "", "master"), on("Deck-Officer", "", "")] == [False, True, False, True, True]
    assert one(spark, resume.first_given(F.lit(" "), F.lit(None).cast("string"), F.lit("rank"), F.lit("default"))) == "rank"


def test_format_findings(spark):
    doc = "Skills I have:\nshort\nshort\n" + "x" * 81 + "\n" + "y" * 81 + "\nJan 2020 — 05/2021"
    got = lambda p, t: [(f.code, f.severity) for f in one(spark, resume.format_findings(F.lit(t), text.lines(F.lit(t)), F.lit(p), F.lit(False)))]
    assert got("taleo", doc) == [("MULTI_COLUMN_LAYOUT", "high_attention"), ("CUSTOM_SECTION_HEADERS", "warning"), ("EM_DASH_DETECTED", "warning"), ("FILE_FORMAT_ADVISORY", "info")]
    assert [c for c, _ in got("workday", doc)][1] == "INCONSISTENT_DATE_FORMAT"
    assert got("successfactors", "Skills:\nJan 2020 - Feb 2021") == [("NON_STANDARD_SKILLS_HEADER", "warning")]
    assert got(None, "") == [] and got("successfactors", "skills\n2020") == [("DATE_FORMAT_MISMATCH", "warning")]


def test_certificate_validity(spark):
    doc = "Passport expires 03/2027\nENG1 issued 01/2025 valid until 12/2026\nYellow fever expired 12/2020\nVisa expiry pending\nGMDSS issued 02/02/2024, expiry unclear\nCoC issued Jan 2020\nENG1 expires 01/2030"
    names = ["Passport", "ENG1", "Yellow fever", "Visa", "GMDSS", "CoC", "Absent"]
    df = spark.createDataFrame([(1, doc), (2, None)], "id int, text string")
    a = spark.createDataFrame([(n, n.lower()) for n in names], "certificate string, alias string")
    got = {r.certificate: (r.status, str(r.expiry_date), str(r.issue_date)) for r in documents.certificate_validity(df, "id", "text", a, F.lit("2026-10-01").cast("date")).collect()}
    assert got == {
        "Passport": ("EXPIRING_SOON", "2027-03-31", "None"),
        "ENG1": ("EXPIRING_SOON", "2026-12-31", "2025-01-01"),
        "Yellow fever": ("EXPIRED", "2020-12-31", "None"),
        "Visa": ("DATE_AMBIGUOUS", "None", "None"),
        "GMDSS": ("REQUIRES_VERIFICATION", "None", "2024-02-02"),
        "CoC": ("EXPIRY_UNKNOWN", "None", "2020-01-01"),
    }


def test_sailings(spark):
    rows = [("b", 1, "CDC No: AB123456\nName: Sample Candidate\nThird Officer\nMV Star, 01/2020 - 06/2020", "text"), ("b", 2, "Second Officer MT Moon\n01/02/2021 to 03/04/2021\nnothing", "ocr"), ("c", 1, None, "ocr")]
    df = spark.createDataFrame(rows, "book string, page_number int, raw_text string, method string")
    got = [(r.page_number, r.rank, r.vessel.split(",")[0], r.sign_on, r.sign_off, r.confidence, r.is_last) for r in documents.sailings(df, "book", ["second officer", "third officer"], F.lit("2026-01-01").cast("date")).orderBy("page_number").collect()]
    d = datetime.date
    assert got == [(1, "third officer", "Star", d(2020, 1, 1), d(2020, 6, 1), 0.95, False), (2, "second officer", "Moon", d(2021, 2, 1), d(2021, 4, 3), 0.7, True)]
    n = df.where("page_number = 1 AND book = 'b'").select(documents.book_numbers(F.col("raw_text")).alias("x")).first().x
    assert (n.cdc, n.indos, n.name) == ("AB123456", None, "Sample Candidate")


def test_reports_and_decisions(spark):
    docs = spark.createDataFrame([(1, "Saved 1,200 and 45%. Mail sample@example.test — now 3."), (2, None), (3, "")], "id int, text string")
    got = {r.id: (r.facts, r.emails, r.findings, r.grade) for r in reports.layered(docs, "text", F.lit("taleo")).collect()}
    assert got[1] == (["1200", "45%", "3"], ["sample@example.test"], ["EM_DASH_DETECTED", "FILE_FORMAT_ADVISORY"], "PASS")  # 29.2 parse points and 45 of content
    assert got[2] == got[3] == ([], [], ["FILE_FORMAT_ADVISORY"], "FAIL")
    rows = [(1, 50, 70, ["a"], ["a"]), (2, 50, 70, ["a"], ["a", "b"]), (3, 50, 40, ["a"], ["a"]), (4, 50, 55, ["a"], []), (5, None, 55, [], [])]
    pairs = spark.createDataFrame(rows, "id int, before int, after int, old_facts array<string>, new_facts array<string>")
    got = {r.id: (r.verdict, r.quality, r.retry, r.kept) for r in reports.decided(pairs).collect()}
    assert got == {1: ("improved", "full", False, "rewritten"), 2: ("factual_integrity_risk", "full", False, "original"), 3: ("degraded", "none", True, "original"), 4: ("degraded", "partial", True, "rewritten"), 5: (None, "none", False, "rewritten")}
