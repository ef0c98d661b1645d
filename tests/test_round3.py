"""Claims with signs apart, phone numbers beside dates, masks at a cut."""

from pyspark.sql import functions as F
from quillmark.functions import text
from quillmark.operators import claims, evidence, resume


def claimed(spark, x, **how):
    return {r.claim: r.n for r in claims.numeric_claims(spark.createDataFrame([(1, x)], "id int, text string"), "id", **how).collect()}


def test_currency_apart(spark):
    assert claimed(spark, "a$$$ 170.116, b$ 5k, $7 3$ 4 y$9", apart=True) == {"$:170.116": 1, "$:5000": 1, "$:7": 1, ":3": 1, ":4": 1, "$:9": 1}
    assert claimed(spark, "a$$$ 170.116, b$ 5k, $7") == {":170.116": 1, ":5000": 1, "$:7": 1}


def test_phone_is_no_date(spark):
    codes = lambda x: spark.range(1).select(resume.format_findings(F.lit(x), text.lines(F.lit(x)), F.lit("successfactors"), F.lit(False)).code.alias("c")).first().c
    for phone in ("+1 (900) 555-2077", "(900) 555-2077", "900-555-2077"):
        assert "DATE_FORMAT_MISMATCH" not in codes(f"call {phone} now")
    for years in ("2019 - 2021", "2019-2021", "03/2019 - 04/2021", "in 2077"):
        assert "DATE_FORMAT_MISMATCH" in codes(years)


def test_snippet_is_cut_before_its_mask(spark):
    d = spark.createDataFrame([("ship", "link", "von", 0)], "kind string, canonical string, term string, ord int")
    docs = spark.createDataFrame([(1, "von " + "x" * 288 + " 1234567890123456")], "id int, text string")
    assert evidence.snippets(docs, "id", "text", d).first().snippet == "von " + "x" * 288 + " [REDACTED]"


def test_documents_are_spread(spark, tmp_path):
    from quillmark.plans.catalogue import t

    spark.range(20).selectExpr("id AS doc_id", "'x' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    d = t(spark, str(tmp_path), "documents")
    assert d.rdd.getNumPartitions() >= 4 and d.count() == 20
