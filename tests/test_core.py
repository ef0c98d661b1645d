"""Golden cases of the core library."""

import datetime
import decimal
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.functions import dates, numbers, text
from quillmark.operators import claims, dataprep, intervals, lifecycle, matching, mentions, retrieval
from quillmark.sources import files
from quillmark.streaming import jobs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_whole_terms(spark):
    has = lambda t, k: one(spark, text.has_term(F.lit(t), k))
    assert not has("javascript experience", "java") and has("Used Python and FastAPI", "python")
    assert not has("über", "ber") and not has("x", " ") and has("c/o on board", "C/O")


def test_calibration_and_grades(spark):
    got = [one(spark, numbers.calibrated(F.lit(float(x)))) for x in (39, 40, 60, 85, 90, 100)]
    assert got == [29.25, 40, 60, 85, 88, 94]
    assert [one(spark, numbers.grade(F.lit(x))) for x in (85, 75, 60, 59)] == ["EXCELLENT", "GOOD", "PASS", "FAIL"]
    assert one(spark, numbers.weighted_mean({"a": (F.lit(None).cast("double"), 0.4), "b": (F.lit(50.0), 0.2)})) == 50.0


def test_parse_points(spark):
    p = lambda t, c, ok: round(one(spark, numbers.parse_points(F.lit(94.0), F.lit(t), F.lit(c), F.lit(ok))), 6)
    assert p(True, False, True) == 25.0 and p(False, False, False) == 5.0


def d(s):
    return datetime.date.fromisoformat(s)


@pytest.fixture(scope="module")
def sea(spark):
    rows = [("a", 1, d("2020-01-01"), d("2021-01-01")), ("a", 2, d("2020-07-01"), d("2021-07-01")), ("b", 3, d("2020-01-01"), d("2020-02-01")), ("b", 4, d("2020-02-01"), d("2020-02-11")), ("b", 5, d("2020-02-01"), d("2020-02-01"))]
    return spark.createDataFrame(rows, "k string, p int, start date, end date")


def test_interval_algebra(spark, sea):
    assert {r.k: (r.n_merged, r.union_days) for r in intervals.totals(sea, ["k"]).collect()} == {"a": (1, 547), "b": (1, 41)}
    assert [(r.k, r.overlap_days) for r in intervals.overlaps(sea, "k", "p").collect()] == [("a", 184)]
    v = spark.createDataFrame([("a", d("2020-01-01"), d("2020-07-01"))], "k string, start date, end date")
    r = {x.k: x for x in intervals.verified_split(sea, v, "k").collect()}
    assert (r["a"].verified_days, r["a"].unverified_days) == (182, 365) and r["b"].verified_days == 0


def test_date_endpoints(spark):
    as_of = F.lit("2024-01-01").cast("date")
    e = lambda s, end: one(spark, dates.endpoint(F.lit(s), end, as_of))
    assert tuple(e("01/02/2022", False)) == (d("2022-02-01"), True, False)
    assert tuple(e("03/04/2022", True)) == (d("2022-04-04"), True, False)
    assert tuple(e("Mar 2022", True)) == (d("2022-04-01"), False, True)
    assert e("present", True).day == d("2024-01-01") and e("13/2020", True).day is None and e("junk", False).day is None
    assert [one(spark, dates.validity(F.lit(x).cast("date"), as_of)) for x in ("2023-12-31", "2024-06-01", "2030-01-01", None)] == ["EXPIRED", "EXPIRING_SOON", "VALID", "EXPIRY_UNKNOWN"]


def test_redaction_and_phrases(spark):
    assert one(spark, text.redacted(F.lit("mail sample@example.test or +1 (555) 010-0000, A1234567"))) == "mail [REDACTED] or [REDACTED], [REDACTED]"
    assert one(spark, text.plain_dashes(F.lit("a—b -- c"))) == "a - b - c"
    assert one(spark, text.replaced_phrases(F.lit("Leverage it, leverage"), {"leverage": "use"})) == "Use it, use"
    assert one(spark, text.sentences(F.lit("On M.V. Star now. Done!"))) == ["On M.V. Star now", "Done"]
    assert one(spark, text.lines(F.lit("a\r\nb\n"))) == ["a", "b"] and one(spark, text.lines(F.lit(""))) == []


def test_claims(spark):
    df = spark.createDataFrame([(1, "Saved $1.2M and 45% on 5 ships with python 3 and 10k users, 10k again"), (2, None)], "id int, text string")
    got = {r.claim: r.n for r in claims.numeric_claims(df, "id").collect()}
    assert got["$:1200000"] == 1 and got["%:45"] == 1 and got[":5"] == 1 and got[":10000"] == 2 and ":3" not in got
    old = spark.createDataFrame([(1, ":10000", 1)], "id int, claim string, n long")
    assert ":10000" in {r.claim for r in claims.novel_claims(claims.numeric_claims(df, "id"), old, "id").collect()}


def test_mentions(spark):
    df = spark.createDataFrame([(1, "Chief Officer and chief cook"), (2, ""), (3, None)], "id int, text string")
    words = spark.createDataFrame([("chief officer", "officer"), ("chief", "x"), ("chief", "y")], "term string, canonical string")
    got = sorted((r.pos, r.term, r.canonical, r.status) for r in mentions.mentions(df, "id", "text", words, 2).collect())
    assert got == [(1, "chief", "x", "ambiguous"), (1, "chief", "y", "ambiguous"), (1, "chief officer", "officer", "evidenced"), (4, "chief", "x", "ambiguous"), (4, "chief", "y", "ambiguous")]


def test_ranking_metrics(spark):
    rows = [("q", 1, 2), ("q", 2, 0), ("q", 3, 1)]
    r = retrieval.metrics(spark.createDataFrame(rows, "q string, rank int, rel int"), "q", "rel", "rank", 2).first()
    assert (r.precision_at_k, r.recall_at_k, r.f1_at_k) == (0.5, 0.5, 0.5) and abs(r.ndcg_at_k - 3 / (3 + 1 / 1.5849625)) < 1e-3


def test_rank_policy(spark):
    rows = [(1, "second officer", 2.0), (2, "second officer", 1.9), (3, "second officer", 2.01), (4, "second officer", None), (5, "chief eto", 12.0)]
    got = {r.id: (r.recommended_rank, r.status) for r in matching.rank_eligibility(spark.createDataFrame(rows, "id int, rank string, years double"), matching.ladder(spark)).collect()}
    assert got == {1: (None, "needs_review"), 2: ("third officer", "review_recommended"), 3: ("second officer", "review_recommended"), 4: (None, "needs_review"), 5: ("third eto", "review_recommended")}


def test_requirements_and_summary(spark):
    df = spark.createDataFrame([("v", "Cook\n\nRequired:\n- GMDSS\nPreferred:\n- French")], "v string, text string")
    assert [(r.line, r.priority) for r in matching.requirement_lines(df, "v").orderBy("line_no").collect()] == [("Cook", "unclear"), ("GMDSS", "mandatory"), ("French", "preferred")]
    items = spark.createDataFrame([("c", "mandatory", "confirmed_missing"), ("c", "preferred", "evidenced"), ("o", "mandatory", "not_evidenced"), ("p", "mandatory", "evidenced")], "k string, priority string, state string")
    got = {r.k: (r.score, r.eligibility) for r in matching.match_summary(items, ["k"]).collect()}
    assert got == {"c": (50.0, "not_eligible_confirmed_missing"), "o": (0.0, "needs_review"), "p": (100.0, "potentially_eligible")}


def test_dataprep(spark):
    rows = spark.createDataFrame([("g%d" % (k % 4), k) for k in range(20)], "g string, n int")
    s = dataprep.held_out_groups(rows, "g", 0.5)
    assert {r.g for r in s.where("split = 'validation'").collect()} == {"g2", "g3"}
    assert dataprep.held_out_groups(rows.where("g = 'g0'"), "g", 0.5).where("split = 'validation'").count() == 0
    e = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(50, 51)], "a long, b long")
    assert {r.component for r in dataprep.components(e).collect()} == {0, 50}


def test_docx_and_uploads(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    for name, data in {"a.docx": b.getvalue(), "b.docx": b"PK junk", "c.pdf": b"junk", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-6:]: (r.raw_text, r.structural_issues) for r in files.extracted(files.uploads(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ("Hello\nCell", ["TABLES_DETECTED"]), "b.docx": ("", ["DOCX_READ_ERROR: BadZipFile"]), "/c.pdf": ("", ["WRONG_SIGNATURE"]), "/d.txt": ("", ["UNSUPPORTED_TYPE"])}


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(k, t + datetime.timedelta(hours=k), f"h{k % 3}", 1.0) for k in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, h string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def drained(out, name, mode):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert drained(jobs.deduplicated(stream(), ["h"], "ts"), "dedup", "append").count() == 3
    assert lifecycle.first_in_window(df, ["h"], "ts", "event_id", 86400).count() == 3
    got = drained(jobs.windowed(stream(), "ts", ["h"], "6 hours"), "win", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.windowed(df, "ts", ["h"], "6 hours").collect()))


def plain_claims(text):
    """Numeric claims by a scan from the left, for texts of ASCII digits."""
    import re

    out = {}
    for m in re.finditer(r"(?<![\w.])([$€£₹])?(\d[\d,]*(?:\.\d+)?)(?:\s*(thousand|million|billion|percent|times|ms|gb|mb|tb|[kmbx%]))?(?![A-Za-z])", text, re.I):
        before, after = text[: m.start()], text[m.end() :]
        unit, number = (m[3] or "").lower(), m[2].replace(",", "")
        if re.search(r"(python|node(\.js)?|java|version|v)\s*$", before[-16:], re.I):
            continue
        near_year = re.search(r"(19|20)\d\d\s*[-/–]\s*$", before[-12:]) or re.match(r"\s*[-/–]\s*(19|20)\d\d", after[:12]) or re.search(r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*$", before[-12:], re.I)
        if not unit and not m[1] and "." not in number and 1900 <= int(number) <= 2100 and near_year:
            continue
        value = decimal.Decimal(number) * {"k": 10**3, "thousand": 10**3, "m": 10**6, "million": 10**6, "b": 10**9, "billion": 10**9}.get(unit, 1)
        kind = m[1] or {"%": "%", "percent": "%", "x": "x", "times": "x"}.get(unit, unit if unit in ("ms", "gb", "mb", "tb") else "")
        shown = f"{value:f}".rstrip("0").rstrip(".") if "." in f"{value:f}" else f"{value:f}"
        out[f"{kind}:{shown}"] = out.get(f"{kind}:{shown}", 0) + 1
    return out


def test_claims_against_a_plain_scan(spark):
    import random

    rng = random.Random(4)
    part = lambda: rng.choice(["Sold", "in", "since", "May", "Jan.", "python", "v", "node.js", "to", "-", "–", "/", "2018", "2020", "1999 ", "1899", "12", "3.50", "1,200", "007", "$5", "₹ 9", "€1.25m", "40%", "7 percent", "2 billion", "3x", "10k", "50kg", "9 ms", "1.2.3", "a5", "x", "."])
    texts = ["Sold 500 units in 2020", "grew since 2019", "2018 - 2020", "2018-2020 and 2021", "May 2020, 2 times", "over ₹5 and $1.2M", "0.50 00"] + ["".join(part() + rng.choice([" ", " ", "", "  "]) for _ in range(8)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in claims.numeric_claims(df, "id").collect():
        got.setdefault(r.id, {})[r.claim] = r.n
    for k, x in enumerate(texts):
        assert got.get(k, {}) == plain_claims(x), x


def test_mentions_with_signs_and_accents(spark):
    import random
    import re

    terms = ["c++", "vi/2", "café", "of the", "the", ".net", "m/v", "é"]
    rng = random.Random(5)
    bits = [*terms, "C++", "Café", "cafés", "asp.net", "c++x", "c ++", "of  the", "vi/22", "xm/v", "x", "(the)", "thé", "m/v."]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) for _ in range(6)) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = spark.createDataFrame([(x, x) for x in terms], "term string, canonical string")
    got = {}
    for r in mentions.mentions(df, "id", "text", words).collect():
        got[r.id, r.term] = got.get((r.id, r.term), 0) + 1
    want = {(k, x): n for k, t in enumerate(texts) for x in terms if (n := len(re.findall(rf"(?<!\w){re.escape(x)}(?!\w)".replace(r"\ ", r"\s+"), (t or "").lower())))}
    assert got == want


def test_first_in_window_counts_from_accepted_events(spark):
    t = datetime.datetime(2024, 1, 1)
    at = lambda h: t + datetime.timedelta(hours=h)
    rows = [("a", k, at(h)) for k, h in enumerate([0, 20, 40, 64, 64.5, 88.4])] + [(None, 20, at(1)), (None, 21, at(2)), ("b", 30, None), ("b", 31, at(5))]
    df = spark.createDataFrame(rows, "h string, event_id int, ts timestamp")
    assert {r.event_id for r in lifecycle.first_in_window(df.repartition(3), ["h"], "ts", "event_id", 86400).collect()} == {0, 2, 4, 20, 31}


def test_next_in_group_across_partitions(spark):
    from quillmark.operators import sequences

    rows = [("hot", k) for k in range(500)] + [("a", 1), ("z", 5), (None, 3), (None, 4), ("z", 5)]
    got = sequences.with_next(spark.createDataFrame(rows, "g string, n int").repartition(3), "g", "n", "nxt").collect()
    assert len(got) == len(rows) and all(r.nxt == (r.n + 1 if r.n < 499 else None) for r in got if r.g == "hot")
    assert sorted((r.n, r.nxt or 0) for r in got if r.g == "z") == [(5, 0), (5, 5)] and [r.nxt for r in got if r.g is None and r.n == 3] == [4]


def test_best_match_in_blocks(spark, monkeypatch):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = {r.id: r.match_id for r in retrieval.best_match(df, df, 0.5).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert {r.id: r.match_id for r in retrieval.best_match(df, df, 0.5).collect()} == want and len(want) == 60
    assert all(k != m for k, m in want.items())


def test_bm25_top_equals_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("the of a b c d e f g".split()) for _ in range(rng.randint(0, 30)))) for k in range(120)] + [(200, None)], "d long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "the a"), (2, "b c zz"), (3, ""), (4, "g")], "q long, text string")
    want = retrieval.top(retrieval.bm25(asked, docs, "q", "d").withColumn("score", F.round("score", 4)), "q", [F.desc("score"), F.col("d")], 5)
    want = sorted(map(tuple, want.select("q", "d", "score", "rank").collect()))
    for cells in (1 << 24, 3):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert sorted(map(tuple, retrieval.bm25_top(asked, docs, "q", "d", 5).select("q", "d", "score", "rank").collect())) == want
