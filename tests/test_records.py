"""Golden cases of field extraction, repair and lookups."""

from pyspark.sql import functions as F

from quillmark.operators import records


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def texts(*x):
    return F.array(*[F.lit(w) for w in x]).cast("array<string>")


def test_fields(spark):
    name = lambda s: one(spark, records.person_name(F.lit(s), ["seafarer"]))
    assert [name(s) for s in ("\n Sample  Candidate - Cook\nx", "Seafarer One", "One", "A B 1", "", None)] == ["Sample Candidate", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown"]
    phone = lambda s: one(spark, records.has_phone(F.lit(s)))
    assert phone("call +1 555 010 0000") and not phone("12-05-2020") and not phone("123") and not phone(None)
    head = lambda s: one(spark, records.is_heading(F.lit(s), ["skills", "education", "work experience"]))
    assert head("Skills:") and head("Work Experience & Education") and head("Skills and tools") and not head("Skills matter") and not head(None)
    missing = lambda s, t: one(spark, records.explicitly_missing(F.lit(s), F.lit(t)))
    assert missing("GMDSS not held", "GMDSS") and missing("I do not have the C/O", "c/o") and not missing("GMDSS held", "GMDSS")
    part = lambda s, t: one(spark, records.partial_evidence(F.lit(s), F.lit(t)))
    assert part("x\n Ballast water work ", "ballast water management") == "Ballast water work" and part("ballast", "ballast") is None and part("a b", "water management") is None
    real = lambda s: one(spark, records.real_line(F.lit(s)))
    assert [real(s) for s in ("​21/12/1999", "Training00000", "industry", "STCW", "Passport No. 1", "Basic safety training", "", None)] == [False, False, False, True, True, True, False, False]
    dept = lambda s: one(spark, records.department(F.lit(s)))
    assert [dept(s) for s in ("chief_eto", "Second Engineer", "third officer", "cook", None)] == ["eto", "engine", "deck", "", ""]
    late = lambda s: one(spark, records.out_of_order(F.lit(s)))
    assert late("01/2019 - x\n02/2020 - y") and not late("02/2020 - y\n01/2019 - x") and not late("") and not late(None)


def test_repairs(spark):
    assert one(spark, records.unwrapped(texts("Crowd &", "Crisis Management", " ", "GMDSS", "a and", "b or", "c"))) == ["Crowd & Crisis Management", "GMDSS", "a and b or c"]
    assert one(spark, records.unwrapped(texts())) == []
    n = "1" * 12
    assert one(spark, records.without_shared_numbers(texts(f"(ECDIS) {n}", f"ECDIS course at school {n}", "x", "x"))) == [f"ECDIS course at school {n}", "x", "x"]
    assert one(spark, records.without_foreign_numbers(texts("CoC | 99998888", "CoC - 77776666", "GMDSS 12345"), F.lit("GMDSS 12345"))) == ["CoC", "GMDSS 12345"]
    s = one(spark, records.to_slots(texts("Passport: X1", "GMDSS", "passport Y2", "INDOS No 7"), {"passport": "passport", "indos": "indos"}))
    assert s.kept == ["GMDSS"] and s.slots == {"passport": "X1", "indos": "No 7"}
    rows = one(spark, records.service_rows(F.lit("Company Name | Vessel | T | G | R | On | Off | D\nAcme | Star | t | 1 | r | 01/2020 | 06/2020 | 9"), F.lit("chief cook")))
    assert [(r.role, r.company, r.dates, r.bullets) for r in rows] == [("Chief Cook", "Acme", "01/2020 - 06/2020", ["Served aboard Star."])]
    rows = one(spark, records.service_rows(F.lit("a\n\nb"), F.lit("unknown")))
    assert [(r.role, r.bullets) for r in rows] == [("Seafarer", ["a", "b"])] and one(spark, records.service_rows(F.lit(None).cast("string"), F.lit("x"))) == []
    assert one(spark, records.gridded(F.lit("a|b|c|d|e|f"))) and not one(spark, records.gridded(F.lit("a|b")))
    assert one(spark, records.word_budget([F.lit("a b"), F.lit(None).cast("string")], texts("x", "y"))) == 28
    assert one(spark, records.aliases(F.lit("Oil / Gas Tanker (OGT, very long bracketed name or X)"))) == ["oil / gas tanker", "oil", "gas tanker", "ogt", "x"]
    got = one(spark, records.signals({"skill": texts("Python", " "), "cert": texts("python", "GMDSS"), "none": F.lit(None).cast("array<string>")}))
    assert [(r.kind, r.value) for r in got] == [("skill", "Python"), ("cert", "GMDSS")]
    assert one(spark, records.uncovered_lines(F.lit("Basic safety training course\nCode AB123 something else entirely\nGMDSS radio operator"), F.lit("basic safety training, ab123"))) == ["GMDSS radio operator"]


def test_lookups(spark):
    docs = spark.createDataFrame([(1, "Guest safety and bridge watch"), (2, None)], "id int, text string")
    kw = spark.createDataFrame([("acme", "deck", "bridge watch"), ("acme", "deck", "colreg"), ("acme", "deck", "safety"), ("other", "deck", "absent")], "company string, department string, keyword string")
    got = [(r.id, r.company, r.matches, r.score) for r in records.keyword_scores(docs, "id", "text", kw, ["company", "department"], 1.5).collect()]
    assert got == [(1, "acme", ["bridge watch", "safety"], 100.0)]
    rows = spark.createDataFrame([(1, " ACME "), (2, "nobody"), (3, None)], "id int, company string")
    reg = spark.createDataFrame([("acme", "workday")], "company string, platform string")
    assert {r.id: r.platform for r in records.looked_up(rows, reg, "company", {"platform": "unknown"}).collect()} == {1: "workday", 2: "unknown", 3: "unknown"}
