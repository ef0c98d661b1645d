"""The generic score against a plain version."""

import random
import re

from pyspark.sql import functions as F
from quillmark.operators import generic, parse_checks

SCHEMA = "id int, ats_score double, text string, bullets array<string>, skills array<string>, has_work boolean, contact boolean, sections array<string>, objective string, role string, wanted array<string>"


def plain(r):
    _, ats, text, bullets, skills, work, contact, sections, objective, role, wanted = r
    bullets, objective = [b.strip() for b in bullets or [] if b.strip()], objective or ""
    points, issues = (ats or 0.0) * 0.6, []

    def lose(cond, n, code):
        nonlocal points
        if cond:
            points -= n
            issues.append(code)

    lose("skills" not in (sections or []) or not skills, 10, "MISSING_SKILLS")
    lose(not contact, 8, "MISSING_CONTACT")
    lose(not re.search(r"\d", " ".join(bullets)), 8, "NO_QUANTIFIED_ACHIEVEMENTS")
    word = lambda w: bool(re.search(rf"(?<!\w){re.escape(w.strip().lower())}(?!\w)", objective.lower()))
    own = bool(role and role.strip() and role.lower() not in ("professional", "job") and word(role)) or any(s and s.lower() not in generic.PLAIN_TERMS and word(s) for s in wanted or [])
    lose(re.search(r"\b(objective|seeking|to obtain)\b", objective, re.I) and not own, 5, "GENERIC_OBJECTIVE")
    n = sum(bool(re.match(r"\W*(managed|assisted|helped|supported)\b", b, re.I)) and not re.search(r"\b(improv\w*|saved|result(ed)?)\b", b, re.I) for b in bullets)
    v = min(6, round(6 * n / len(bullets))) if bullets else 0
    lose(v, v, "VAGUE_DUTIES")
    words = len(re.findall(r"\b[\w'-]+\b", text or ""))
    if words < 300:
        points *= 0.75
        issues.append("THIN")
    if "experience" not in (sections or []) or not work:
        points = min(points, 30)
        issues.append("MISSING_WORK_EXPERIENCE")
    if words < 150:
        points = min(points, 20)
        issues.append("UNDER_150_WORDS")
    return max(0.0, min(60.0, points)), issues


def test_content_matches_a_plain_version(spark):
    rng = random.Random(4)
    pick = rng.choice
    rows = []
    for k in range(400):
        bullets = pick([None, [pick(["Managed crews", "managed it; saved 5 days", "- Helped, improving it", "kept logs", " ", "Supported 3 ships"]) for _ in range(rng.randrange(7))]])
        rows.append((k, pick([None, 0.0, 50.0, 100.0]), pick([None, "w " * 100, "it's re-done " * 100, "w " * 400]), bullets, pick([None, [], ["a"]]), pick([None, True, False]), pick([None, True, False]), pick([None, [], ["skills"], ["experience", "skills"]]), pick([None, "Seeking a job", "Objective: ECDIS post", "to obtain a mate role", "Seaman"]), pick([None, "mate", "Job", " "]), pick([None, [], ["ecdis"], ["job", "", None]])))
    df = spark.createDataFrame(rows, SCHEMA)
    for r in generic.content(df).collect():
        points, issues = plain(rows[r.id])
        assert abs(r.content_points - points) < 1e-9 and r.content_issues == issues, rows[r.id]


def test_scores_join_both_parts(spark):
    text = "Mail a.b@c.org, call +44 20 7946 0958\nExperience\n" + "word " * 320
    rows = [(1, 100.0, text, ["Cut costs by 12 %"], ["a"], True, True, ["skills", "experience", "education"], "", "", None), (2, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", parse_checks.view(F.col("text"), F.when(F.col("id") == 1, F.array(F.lit("TABLES_DETECTED"))), F.lit("pdf"), column_pages=F.lit(0)))
    found = parse_checks.statuses(F.col("v"))
    df = df.select("*", *[c.alias(n) for n, c in found.items()])
    got = {r.id: r for r in generic.scored(df, "v", {n: F.col(n) for n in found}).collect()}
    assert got[1].content_points == 60.0 and abs(got[1].parse_points - (94 * 0.4 + 2.4 - 15)) < 1e-9
    assert got[1].issues[0] == "TABLES_WARN" and got[2].total == 4 and got[2].grade == "FAIL" and got[2].issues[:1] == ["TEXT_LAYER_FAIL"] and got[2].parse_points <= 5
