"""Certificate states and officers' reports from texts."""

from pyspark.sql import functions as F
from quillmark.operators import standing, workflow

REG = [("STCW Basic Safety", "stcw"), ("STCW Basic Safety", "basic safety"), ("GMDSS", "gmdss"), ("Tanker Endorsement", "tanker end."), ("COC", "coc"), ("ECDIS", "ecdis")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_states(spark):
    docs = frame(spark, [(1, "Holds STCW\ndoes not have GMDSS, mail a@b.com\nCOC expired 2019\nCOC renewed\nnot held: tanker end."), (2, None), (3, "gmdss\nGMDSS lapsed")], "id int, text string")
    wanted = frame(spark, [(i, w) for i in (1, 2, 3) for w in ("Basic safety", "GMDSS operator", "coc", "Endorsement", "ECDIS", "Radar", "")], "id int, wanted string")
    claimed = frame(spark, [(2, "ecdis"), (1, "GMDSS"), (2, None)], "id int, certificate string")
    got = {(r.id, r.wanted): r for r in standing.certificate_states(docs, "id", "text", wanted, frame(spark, REG, "certificate string, alias string"), claimed).collect()}
    state = lambda i: {w: got[i, w].state for i2, w in got if i2 == i}
    assert state(1) == {"Basic safety": "evidenced_unverified", "GMDSS operator": "confirmed_missing", "coc": "expired", "Endorsement": "confirmed_missing", "ECDIS": "not_evidenced", "Radar": "not_evidenced", "": "not_evidenced"}
    assert state(2)["ECDIS"] == "evidenced_unverified" and state(2)["coc"] == "not_evidenced" and state(3)["GMDSS operator"] == "expired"
    assert "[REDACTED]" in got[1, "GMDSS operator"].evidence and len(got) == 21


def test_states_reach_suitability(spark):
    req = frame(spark, [(1, "certificate", "mandatory", "COC"), (1, "certificate", "optional", "GMDSS"), (2, "experience", "mandatory", "1 year")], "id int, type string, priority string, text string")
    states = frame(spark, [(1, "COC", "confirmed_missing"), (1, "GMDSS", "not_evidenced"), (2, "ECDIS", "evidenced_unverified")], "id int, wanted string, state string")
    every = standing.with_states(req, frame(spark, [(1, "ECDIS"), (2, "ECDIS")], "id int, certificate string"), states, "id")
    assert every.where("id = 1").count() == 2 and every.where("id = 2 AND text = 'ECDIS' AND state = 'evidenced_unverified'").count() == 1
    people = frame(spark, [(1, "mate", "mate", 9, 24.0), (2, "mate", "mate", 9, 24.0)], "id int, rank string, target string, rank_months int, relevant_months double")
    assert {r.id: r.status for r in workflow.suitability(people, every, "id").collect()} == {1: "ineligible_confirmed_requirement", 2: "potentially_eligible"}


def test_officers_from_text(spark):
    schema = "k string, page_number int, raw_text string, method string"
    resumes = frame(spark, [("a", 1, "Second Officer 01/2018 - 01/2019 MV Star", "text"), ("c", 1, "none", "text")], schema)
    books = frame(spark, [("a", 1, "second officer 01/2018 - 01/06/2018", "text"), ("a", 2, "Master 01/2020 - present\nnothing\nblank\nMate 01/2020 - present", "ocr"), ("b", 1, None, "text")], schema)
    stated = frame(spark, [("a",), ("b",), ("b",)], "k string")
    got = {r.k: r for r in standing.officer_from_text(resumes, books, "k", ["second officer", "master", "mate"], F.lit("2020-07-01").cast("date"), stated).collect()}
    assert set(got) == {"a", "b"} and got["b"].missing_detail and got["b"].status == "review_required"
    a = got["a"]
    assert (a.rank_history, a.latest_rank, a.status, a.ranks_without_evidence, a.missing_detail) == (["master", "mate", "second officer"], "mate", "review_required", ["master", "mate"], False)
    assert a.service_months == 18.0 and {x["rank"]: x.service_months for x in a.months_by_rank} == {"second officer": 12.0, "master": 6.0, "mate": 6.0}
