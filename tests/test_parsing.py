"""Golden cases of the parse checks, the older scorer and the shapes of a candidate's record."""

import math

from pyspark.sql import functions as F

from quillmark.functions import dates
from quillmark.operators import older, parse_checks, profile, records


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def checked(spark, text, tags=(), ext="pdf", pages=None, cv_mode=False, **facts):
    given = None if pages is None else F.array(*[F.struct(F.lit(t).alias("text"), F.lit(n).alias("n_images")) for t, n in pages])
    v = parse_checks.view(F.lit(text), F.array(*map(F.lit, tags)).cast("array<string>") if tags is not None else F.lit(None).cast("array<string>"), F.lit(ext), given, **{k: F.lit(x) for k, x in facts.items()})
    row = spark.range(1).select(v.alias("v"))
    found = parse_checks.statuses(F.col("v"), cv_mode)
    row = row.select("v", *[c.alias(n) for n, c in found.items()])
    kept = {n: F.col(n) for n in found}
    r = row.select(*found, parse_checks.score(kept, ["extraction", "layout"]).alias("overall"), parse_checks.score(kept, ["content"]).alias("content"), parse_checks.extractability(F.col("v"), kept).alias("extractability"), F.size(parse_checks.report(kept)).alias("n")).first()
    return r.asDict()


GOOD = "Jo Doe jo.doe@mail.example +44 20 7946 0958\nExperience\n2019 worked on many large ships as an engineer\nEducation\n2010\nSkills\nwelding"


def test_parse_checks(spark):
    r = checked(spark, GOOD)
    assert (r["overall"], r["content"], r["extractability"], r["n"]) == (100, 100, "full", 7)
    assert r["tables"] is r["text_boxes"] is r["header_footer_content"] is r["page_count"] is r["text_coverage"] is None
    r = checked(spark, GOOD, ["CONTENT_IN_HEADER", "TABLES_DETECTED", "MULTI_COLUMN_LAYOUT_DETECTED", "IMAGES_OR_GRAPHICS_DETECTED"])
    assert (r["header_footer_content"], r["tables"], r["multi_column"], r["images"], r["overall"]) == ("warn", "warn", "fail", "warn", 100 - 6 - 6 - 12 - 2)
    r = checked(spark, GOOD, ext="DOCX", textbox_text="a few")
    assert (r["tables"], r["text_boxes"], r["header_footer_content"]) == ("pass", "warn", "pass")
    r = checked(spark, GOOD, pages=[("x", 1), (GOOD * 9, 0)], page_count=3, repeated_lines=2)
    assert (r["text_coverage"], r["page_count"], r["header_footer_content"], r["extractability"]) == ("warn", "warn", "warn", "partial")
    assert checked(spark, GOOD, page_count=3, cv_mode=True)["page_count"] == "pass" and checked(spark, GOOD, pages=[("x", 1)])["text_coverage"] == "fail"
    r = checked(spark, None, None, None)
    assert (r["text_layer"], r["contact_info"], r["section_headings"], r["dates"], r["overall"], r["content"], r["extractability"]) == ("fail", "fail", "fail", "warn", 70, 56, "none")
    assert checked(spark, "(cid:3)" * 3 + "�" + "x" * 40)["garbled_glyphs"] == "fail" and checked(spark, "" + "x" * 99)["garbled_glyphs"] == "warn"
    assert checked(spark, "x " * 200 + "jo.doe@mail.example +44 20 7946 0958")["contact_info"] == "warn"


def test_phone_needs_more_than_dates(spark):
    phone = lambda s: one(spark, records.has_phone(F.lit(s)))
    assert phone("45 22 45 12") and phone("+1\n234 567") and not phone("01 2019 - 12 2020") and not phone("12 11 10 9 8") and not phone(None)


def test_older_scorer(spark):
    schema = "id int, text string, tags array<string>, contact map<string,string>, sections map<string,string>, skills array<string>, rank string"
    text = "Professional Summary\nOne. Two. Three.\nSKILLS\nwelding\nWork Experience\n09/2020 - 05/2021 led, managed and built 5 vessels\n01/2022 - now\nEducation\nCertificates\nBasic Safety (BST)"
    rows = [
        (1, text, ["TABLES_DETECTED", "TABLES_DETECTED", "OTHER"], {"email": "e", "phone": "p"}, None, ["s"] * 12, "Oiler"),
        (2, None, None, None, None, None, None),
        (3, "I was responsible for managment ★ 01/2020 and Jan 2020", [], {"email": ""}, {"summary": "x", "experience": " "}, ["s"] * 31, None),
    ]
    got = {r.id: r for r in older.scored(spark.createDataFrame(rows, schema), "text", "tags", "contact", "sections", "skills", "rank").collect()}
    assert (got[1].format_score, got[1].section_score, got[1].total_score, got[1].grade) == (24, 20, 64, "PASS")
    assert got[1].issues == ["TABLES_DETECTED", "TABLES_DETECTED", "OTHER", "EXPERIENCE_NOT_REVERSE_CHRONOLOGICAL"]
    assert (got[2].format_score, got[2].section_score, got[2].grade) == (27, 0, "FAIL") and "SUMMARY_TOO_SHORT" not in got[2].issues
    assert got[3].format_score == 40 - 10 - 4 - 3 - 3 - 3 - 2 - 3 and {"SUMMARY_TOO_SHORT", "TOO_MANY_SKILLS", "FEW_ACTIVE_VERBS_IN_EXPERIENCE"} <= set(got[3].issues)


def test_older_keywords(spark):
    docs = spark.createDataFrame([(1, "Diesel engine, diesel pump", "a"), (2, None, "a"), (3, "x", "b"), (4, "x", None)], "id int, text string, vac string")
    posts = spark.createDataFrame([("a", "Required: diesel engine"), ("b", " ")], "vac string, post string")
    got = {r.id: r for r in older.keyword_points(docs, "id", "text", "vac", posts, "post", []).collect()}
    rare = 1 + math.log(1.5)
    # posting: required, diesel, engine, required diesel, diesel engine; document: diesel twice, engine, pump, diesel engine, engine diesel, diesel pump
    cosine = (2 + 1 + 1) / math.sqrt((4 + 1 + 1 + 3 * rare**2) * (3 + 2 * rare**2))
    assert got[1].match_pct == 100.0 and got[1].missing == [] and got[1].cosine_pct == round(cosine * 100, 1)
    assert got[1].keyword_points == int((70 + got[1].cosine_pct * 0.3) * 0.4)
    assert (got[2].match_pct, got[2].cosine_pct, got[2].keyword_points, got[2].missing) == (0.0, 0.0, 0, ["diesel", "engine"])
    assert [(got[k].match_pct, got[k].keyword_points) for k in (3, 4)] == [(None, 20), (None, 20)]
    assert older.keyword_points(docs.limit(0), "id", "text", "vac", posts, "post", ["x"]).count() == 0


def test_profile_shapes(spark):
    p = one(spark, profile.profile({"name": F.lit("N"), "email": F.lit("e"), "sea_months": F.lit("7"), "skills": F.lit(None).cast("array<string>")}))
    assert (p.name, p.contact.email, p.contact.phone, p.contact.all_phones, p.sea_months, p.skills, p.rank_detected, p.sections) == ("N", "e", None, [], 7, [], "unknown", {})
    ship = lambda *b: one(spark, profile.ship_tonnage(F.array(*map(F.lit, b)).cast("array<string>")))
    assert [ship("none", "Mate aboard Ocean Pearl (GRT 9"), ship("grt: 5,"), ship(), ship(None)] == ["Ocean Pearl (GRT 9)", "GRT 5", "", ""]
    assert one(spark, dates.first_range(F.lit("born 1990, Jan. 2019 – present"))) == "Jan. 2019 – present" and one(spark, dates.first_range(F.lit(None).cast("string"))) == ""
    cert = lambda x: one(spark, profile.is_certificate(F.lit(x).cast("string"), ["ROC", "Basic Safety"]))
    assert [cert(x) for x in ("Emergency Procedures", "basic", "cook", None)] == [True, True, False, False]
    content = F.create_map(F.lit("license"), F.array(F.lit("A")))
    heads = lambda officer: [x.heading for x in one(spark, profile.ordered_sections(content, F.lit(officer).cast("boolean")))]
    assert heads(True) == heads(None) == ["License"] and heads(False)[0] == "Training" and "Summary" not in heads(False)
