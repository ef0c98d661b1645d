"""Batches that are cut and run again, the error channel, time limits, snapshots, whole records."""

import os
import time

import pytest
from pyspark.sql import functions as F
from quillmark.operators import whole
from quillmark.sources import batches

SCHEMA = "k string, v string"


def inputs(spark, n=60):
    return spark.createDataFrame([(f"k{i}", str(i) if i % 7 else "bad") for i in range(n)] + [("k1", "1"), (None, "5"), (None, "5")], SCHEMA)


def process(d):
    return batches.attempted(d, [(F.col("v").isNull(), "NULL"), (F.col("v").try_cast("int").isNull(), "NOT_A_NUMBER")], {"n": F.col("v").try_cast("int") * 2}).select("k", "n", "error")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_cut_run_is_resumed(spark, tmp_path):
    whole_run = rows(batches.resumed(inputs(spark), "k", process, str(tmp_path / "one"), 5))
    path = str(tmp_path / "two")
    part = batches.resumed(inputs(spark), "k", process, path, 5, stop_after=2)
    assert 0 < part.count() < len(whole_run)
    # a slice without its commit mark is as if it weren't there
    name = next(n for n in sorted(os.listdir(path)) if n.startswith("slice-"))
    os.remove(f"{path}/{name}/_SUCCESS")
    seen = []
    again = batches.resumed(inputs(spark), "k", lambda d: seen.append(1) or process(d), path, 5)
    assert rows(again) == whole_run and len(whole_run) == 61 and len(seen) == 5
    before = {n: os.path.getmtime(f"{path}/{n}") for n in os.listdir(path)}
    assert rows(batches.resumed(inputs(spark), "k", process, path, 5)) == whole_run
    assert before == {n: os.path.getmtime(f"{path}/{n}") for n in os.listdir(path)}
    assert batches.resumed(inputs(spark, 70), "k", process, path, 5).count() == 71
    c = batches.counts(spark.createDataFrame(whole_run, "k string, n int, error string")).first()
    assert (c.inputs, c.good, c.failed, c.reasons) == (61, 52, 9, ["9 NOT_A_NUMBER"])
    assert batches.resumed(inputs(spark).where("false"), "k", process, str(tmp_path / "none"), 5).count() == 0


def test_failures_stay_in_their_rows(spark):
    def f(x):
        if x == "slow":
            while True:
                time.sleep(0.01)
        return {"a": len(x), "b": str(int(x))}

    df = spark.createDataFrame([(1, "12"), (2, "x"), (3, "slow"), (4, None), (5, "7")], "id int, v string")
    got = {r.id: (r.result and r.result.a, r.error) for r in batches.applied(df, "id", "v", f, "struct<a:int,b:string>", 0.5).collect()}
    assert got == {1: (2, ""), 2: (None, "EXTRACTION_ERROR: ValueError"), 3: (None, "EXTRACTION_TIMEOUT"), 4: (None, "EXTRACTION_ERROR: TypeError"), 5: (1, "")}


def test_snapshots(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-20", "2024-02-01", "2024-02-01"):
        batches.snapshot(spark.range(3), str(tmp_path), day, 14)
    assert sorted(n for n in os.listdir(tmp_path) if n.startswith("snapshot")) == ["snapshot=2024-01-20", "snapshot=2024-02-01"]
    assert spark.read.parquet(str(tmp_path)).count() == 6


def test_whole_records(spark):
    reg = spark.createDataFrame([("rank", "master", "Master", 0, 1), ("rank", "mate", "chief mate", 0, 2), ("certificate", "STCW", "stcw", 0, 9), ("skill", "ECDIS", "ECDIS", 0, 9), ("vessel_type", "tanker", "oil tanker", 0, 9)], "kind string, canonical string, term string, ord int, priority int")
    text = "Ann Example Person\nann.person@ship.com +44 20 7946 0958 linkedin.com/in/ann-p\nChief Mate, then Master of an oil tanker 01/2020 - 07/2021, STCW, ECDIS and ecdis"
    docs = spark.createDataFrame([(1, text, ["TABLES_DETECTED"]), (2, None, None), (3, "too short", None)], "id int, text string, tags array<string>")
    p = {r.id: r for r in whole.parsed(docs, "id", "text", reg, ["curriculum"], F.lit("2024-01-01").cast("date")).collect()}
    assert (p[1].name, p[1].rank, p[1].skills, p[1].certificates, p[1].vessels, p[1].sea_months) == ("Ann Example Person", "master", ["ECDIS"], ["STCW"], ["tanker"], 18)
    assert p[1].contact == {"email": "ann.person@ship.com", "phone": "442079460958", "linkedin": "linkedin.com/in/ann-p"} and p[2].rank == "unknown"
    f = {r.id: r for r in whole.flat(docs, "id", "text", "tags", reg, {"": ["STCW", "GMDSS"]}, {"": 12}, [], F.lit("2024-01-01").cast("date")).collect()}
    assert (f[1].error, f[1].cert_coverage, f[1].missing_certs, f[1].structural_issues, f[1].skills_count) == ("", "1/2", "GMDSS", "TABLES_DETECTED", 1) and f[1].ats_score > 0
    assert (f[2].error, f[2].person, f[2].ats_score, f[2].email, f[3].error) == ("EMPTY_OR_UNREADABLE", "ERROR", 0, None, "EMPTY_OR_UNREADABLE")
    assert len(f[1]) == 18


@pytest.mark.parametrize("bad", ["'", "\\", "$1", "(", "%"])
def test_odd_terms(spark, bad):
    reg = spark.createDataFrame([("skill", "x", f"a{bad}b", 0, 1)], "kind string, canonical string, term string, ord int, priority int")
    assert [r.skills for r in whole.names_found(spark.createDataFrame([(1, f"so a{bad}b it is")], "id int, text string"), "id", "text", reg).collect()] == [["x"]]
