"""Golden cases of workflow reports, nested records, service months and headings."""

import datetime
import random
import unicodedata

from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import nested, service, workflow


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_service_months_from_lines(spark):
    as_of = F.lit("2024-06-01").cast("date")
    months = lambda t: one(spark, service.whole_months(service.service_periods(F.lit(t), as_of)))
    assert months("Master 01/2020 - 01/2021\nMate 06/2020 – 07/2021") == (datetime.date(2021, 7, 1) - datetime.date(2020, 1, 1)).days // 30
    assert months("Passport 01/2010 - 01/2020") == 0 + (datetime.date(2020, 1, 1) - datetime.date(2010, 1, 1)).days // 30 * 0
    assert months("2024-01-01 - present") == 5
    assert months("1999-01-01 - 2004-01-01") == 0
    assert months("from 01/2015 until 01/2016 then 03/2017") == 12
    assert months("01/2006 - 12/2025\n01/2006 - 12/2025") == 242 and months("") == months(None) == 0
    assert months("01/2005 - 2090-01-01") == 400


def test_normalized_text(spark):
    n = lambda t: one(spark, text.normalized(F.lit(t)))
    assert n("  E X P E R I E N C E at <b>x</b> <strong>Sea</strong>  ") == "experience at <b>x</b> sea"
    assert n("ﬁne re-\n  cord a b") == unicodedata.normalize("NFKC", "ﬁne re-cord a b") and n(None) == ""


def test_section_headings(spark):
    found = lambda t: one(spark, service.sections_found(F.lit(t)))
    assert found("Work Experience:\nbody of text that is longer than six words indeed\n• SKILLS •\nEducation and training") == ["experience", "education", "skills"]
    assert found("experienced sailor\nskills") == ["skills"]
    status = lambda x: one(spark, service.section_status(F.array(*[F.lit(i) for i in x]).cast("array<string>")))
    assert [status(x) for x in (["experience", "education", "skills"], ["experience", "skills"], ["education", "skills"], [])] == ["pass", "warn", "fail", "fail"]
    assert service.synonyms("skills", "en-GB") == service.synonyms("skills") and service.synonyms("nothing") == []


def test_json_repair(spark):
    rows = [(1, '{"Summary": "a", "summary_": "b", "skills": null}', False), (2, '{"skills": "x|y; z"', True), (3, None, False), (4, '{"data": {"Key Skills": [], "rank": {"a": "M", "b": ""}}}', True)]
    df = spark.createDataFrame(rows, "id int, raw string, cut boolean")
    got = {r.id: r.r for r in nested.repaired(df, F.col("raw"), F.col("cut"), "r").collect()}
    assert got[1].summary == "a" and got[1].skills == [] and got[2].skills is None and got[3].summary == "" and got[3].languages == []
    assert got[4].rank == "M" and got[4].skills == [] and got[4].summary is None
    assert one(spark, nested.json_text(F.lit("x {1} y {2} z"))) == "{1} y {2}" and one(spark, nested.json_text(F.lit("none"))) is None


def test_nested_shapes(spark):
    schema = "r struct<name:string, work:array<struct<title:string, years:string, bullets:array<string>>>>"
    df = spark.createDataFrame([((("N", [("A", "2020", ["x", " "]), ("B", None, None), (None, " ", ["Y"])])),)], schema)
    r = F.col("r")
    row = df.select(nested.leaves(r, ["name", "work[].title", "work[].bullets[]"]).alias("l"), nested.all_bullets(F.col("r.work")).alias("b"), nested.date_strings(F.col("r.work")).alias("d"), nested.contains_text(r, ["work[].title"], F.lit("B")).alias("has"), nested.contains_text(r, ["work[].title"], F.lit("b")).alias("low")).first()
    assert (row.l, row.b, row.d, row.has, row.low) == ("N\nA\nB\nx\nY", ["x", "Y"], ["2020"], True, False)
    assert one(spark, nested.with_missing(F.array(F.lit("Excel")), F.array(F.lit("excel"), F.lit("Word"), F.lit("Word")))) == ["Excel", "Word"]
    assert one(spark, nested.visible(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.array(F.lit("b")))) == {"a": "1"}
    made = one(spark, nested.as_resume(F.lit("N"), F.lit("T"), F.lit(None), F.array_repeat(F.lit("x"), 30), F.array(F.repeat(F.lit("y"), F.lit(300))), F.lit(None).cast("array<string>"), F.array(F.lit("en"))))
    assert len(made.workExperience[0].bullets) == 24 and len(made.education[0].institution) == 200 and made.summary == "" and made.additional.technicalSkills == []


CONTENT = "skills:array<string>, summary:array<string>, certifications:array<string>, education:array<string>, languages:array<string>, roles:array<struct<title:string, company:string, bullets:array<string>>>"


def plain_limits(c, officer):
    """Skills to 10, then bullets to 2 from the first role on, one after another."""
    skills, roles, most = ((18, 6, 1150) if officer else (15, 3, 600))
    s, summary = list((c[0] or [])[:skills]), list((c[1] or [])[:3])
    work = [[t, f, list((b or [])[:3])] for t, f, b in (c[5] or [])[:roles]]
    n = lambda x: len((x or "").split())
    total = lambda: sum(map(n, s + summary + (c[2] or []) + (c[3] or []) + (c[4] or []))) + (10 + 8 * len(work) if work else 0) + sum(n(t) + n(f) + sum(map(n, b)) for t, f, b in work)
    while total() > most and len(s) > 10:
        s.pop()
    while total() > most and any(len(b) > 2 for _, _, b in work):
        next(b for _, _, b in work if len(b) > 2).pop()
    return len(s), [len(b) for _, _, b in work], total(), total() > most


def test_length_limits(spark):
    rng = random.Random(9)
    text = lambda most: rng.choice([None, "", " ".join(["w"] * rng.randrange(1, most))])
    some = lambda k, most: rng.choice([None, [text(most) for _ in range(rng.randrange(k))]])
    rows = [(some(30, 8), some(6, 60), some(20, 40), some(4, 9), some(4, 3), rng.choice([None, [(text(6), text(6), some(6, rng.choice([20, 90, 160]))) for _ in range(rng.randrange(9))]])) for _ in range(1000)]
    rows.append((["s"] * 30, ["one two"] * 5, None, None, None, [(f"r{k}", "", [" ".join(["w"] * 100)] * 5) for k in range(8)]))
    df = spark.createDataFrame([(k, k % 2 == 0, r) for k, r in enumerate(rows)], f"k int, officer boolean, c struct<{CONTENT}>")
    got = nested.limited(df, "c", F.col("officer"), "x").collect()
    for r in got:
        assert (len(r.x.skills), [len(b.bullets) for b in r.x.roles], r.x.n_words, r.x.compact) == plain_limits(rows[r.k], r.officer)
        assert len(r.x.certifications) == len(rows[r.k][2] or [])
    assert [len(b.bullets) for b in got[-1].x.roles] == [2] * 6 and got[-1].x.compact
    assert any(r.x.compact for r in got) and any(not r.x.compact and 2 in map(len, (b.bullets for b in r.x.roles)) for r in got)


def test_workflow_reports(spark):
    d = datetime.date
    sail = spark.createDataFrame([("b", "mate", d(2020, 1, 1), d(2020, 2, 1)), ("b", "mate", d(2020, 1, 1), d(2020, 2, 1)), ("b", None, None, None), ("c", "cook", d(2021, 1, 1), None)], "k string, rank string, sign_on date, sign_off date")
    told = spark.createDataFrame([("c", "cook"), ("b", "cook")], "k string, rank string")
    got = {r.k: (r.ranks_without_evidence, r.n_repeated, r.status) for r in workflow.reconciled(told, sail, "k").collect()}
    assert got == {"b": (["mate"], 1, "review_required"), "c": ([], 0, "consistent")}
    totals = spark.createDataFrame([("b", "all", 1.5), ("b", "rank:mate", 1.0)], "k string, group_key string, service_months double")
    r = {x.k: x for x in workflow.officer_report(sail, told, totals, "k").collect()}
    assert r["b"].rank_history == ["mate"] and r["b"].latest_rank == "mate" and r["b"].service_months == 1.5 and r["c"].latest_rank is None
    need = spark.createDataFrame([("b", "LNG"), ("b", "lng"), ("b", "Cruise"), ("z", None)], "k string, n string")
    found = spark.createDataFrame([("b", "Lng"), ("b", None)], "k string, n string")
    assert [(x.demonstrated, x.not_evidenced, x.status) for x in workflow.ships_matched(found, need, "k", "n").collect()] == [(["lng"], ["cruise"], "needs_review")]
    assert one(spark, workflow.required_months(F.lit("Minimum 2.5 years"))) == 30 and one(spark, workflow.required_months(F.lit("none"))) is None
    c = {x.competency: (x.evidenced, x.evidence_level) for x in one(spark, workflow.competencies(F.lit("Independently maintained pumps; HV awareness, high voltage awareness")))}
    assert c["independent_maintenance"] == (True, "independently_performed") and c["high_voltage_awareness"] == (True, "mentioned_only") and c["department_management"][0] is False
    rep = one(spark, workflow.recruiter_report(F.lit("a"), F.lit("b"), F.array(F.lit("skills")), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")))
    assert rep.changes_made == ["resume_generated", "section:skills"] and rep.issues == [] and rep.generated_present
    fit = spark.createDataFrame([("b", "ok")], "k string, fit string")
    full = workflow.candidate_report(fit, workflow.ships_matched(found, need, "k", "n"), spark.createDataFrame([("b", "COC", "VALID")], "k string, certificate string, status string"), totals, "k").first()
    assert full.ships_missing == ["cruise"] and full.certificates[0].status == "VALID" and full.service_months == 1.5
