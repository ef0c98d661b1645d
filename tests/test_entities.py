"""Entities with places: offsets, overlaps, precedence of methods, masked context."""

import random
import re

from pyspark.sql import functions as F
from quillmark.functions.arrays import running_sums
from quillmark.operators import evidence

TERMS = [("rank", "Chief Officer", "chief officer", 0), ("rank", "Chief Officer", "c/o", 1), ("rank", "Officer", "officer", 0), ("ship", "Fähre", "fähre", 0), ("ship", "ro-ro", "ro-ro", 0), ("ship", "crude", "crude oil tanker", 0), ("ship", "oil", "oil tanker", 0), ("ship", "tanker", "Tanker", 0), ("ship", "OIL", "tanker  operations", 0), ("ship", "none", " ", 0)]
TEXTS = {1: "Chief\n Officer, C/O on Fähre. Crude Oil Tanker operations; mail me at some.one@ship.com 12345678 ro-ro", 2: None, 3: "", 4: "(ro-ro) ro-rox xro-ro fährex tanker,tanker", 5: "officer " * 700 + "Officer", 6: "É" * 100 + " tanker " + "ß" * 100}


def found(spark):
    d = spark.createDataFrame(TERMS, "kind string, canonical string, term string, ord int")
    docs = spark.createDataFrame([(k, v, "x", 3) for k, v in TEXTS.items()], "id int, text string, kind string, start int")
    return evidence.spans(docs.repartition(2), "id", "text", d)


def brute():
    out = set()
    for k, t in TEXTS.items():
        for kind, name, term, _ in TERMS:
            words = term.split()
            if words:
                edge = lambda c, side: (r"(?<![\w])" if side == "l" else r"(?![\w])") if re.match(r"\w", c) else ""
                for m in re.finditer(edge(term.strip()[0], "l") + r"\s+".join(map(re.escape, words)) + edge(term.strip()[-1], "r"), t or "", re.I):
                    out.add((k, kind, name, m.start(), m.end(), m.group()))
    return out


def test_spans_have_places(spark):
    got = found(spark).collect()
    assert {(r.id, r.kind, r.canonical, r.start, r.end, r.surface) for r in got} == brute()
    for r in got:
        t = TEXTS[r.id]
        assert r.before == t[max(0, r.start - 80) : r.start] and r.after == t[r.end : r.end + 80]


def test_longest_first(spark):
    kept = evidence.longest_first(found(spark), ["id"]).collect()
    assert sorted((r.start, r.term) for r in kept if r.id == 1) == [(0, "chief officer"), (16, "c/o"), (23, "fähre"), (40, "tanker  operations"), (97, "ro-ro")]
    assert len([r for r in kept if r.id == 5]) == 701
    # the same by a plain loop over random spans
    rng = random.Random(2)
    rows = [(k % 3, "k", f"n{rng.randrange(3)}", "t", s, s + rng.randrange(1, 9)) for k in range(200) for s in [rng.randrange(120)]]
    df = spark.createDataFrame(rows, "id int, kind string, canonical string, term string, start long, end long")
    want = []
    for i in range(3):
        taken = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (r[4] - r[5], r[4], r[2])):
            if all(r[4] >= x[5] or x[4] >= r[5] for x in taken):
                taken.append(r)
        want += taken
    assert sorted(tuple(r) for r in evidence.longest_first(df, ["id"]).select("id", "kind", "canonical", "term", "start", "end").collect()) == sorted(want)


def test_methods_are_united(spark):
    e = evidence.entities(found(spark), "id", {"first_term": ["rank"], "longest_first": ["ship"], "every_term": ["ship"]}).collect()
    one = {(r.kind, r.canonical, r.start): r for r in e if r.id == 1}
    assert one["rank", "Chief Officer", 0].method == "first_term" and ("rank", "Chief Officer", 16) not in one and one["rank", "Officer", 7].surface == "Officer"
    assert one["ship", "crude", 30].method == "every_term" and one["ship", "oil", 36].method == "every_term" and one["ship", "OIL", 40].method == "longest_first"
    assert "[REDACTED]" in one["ship", "ro-ro", 97].evidence and "12345678" not in one["ship", "ro-ro", 97].evidence and "@" not in one["ship", "crude", 30].evidence
    same = [("a", "n", "Name", 0, 1), ("a", "n", "NAME", 0, 2)]
    df = spark.createDataFrame([(1, k, c, t, 0, s, s + n, "x", "", "") for k, c, t, s, n in same], "id int, kind string, canonical string, term string, ord int, start long, end long, surface string, before string, after string")
    assert evidence.entities(df, "id", {"every_term": None}).count() == 1


def test_snippets_and_experience(spark):
    d = spark.createDataFrame([("cert", "STCW", "stcw", 0), ("cert", "STCW", "stcw basic", 1)], "kind string, canonical string, term string, ord int")
    docs = spark.createDataFrame([(1, "  stcw here passport no: A123 \n STCW Basic a@b.com, CDC #77\nstcw basic"), (2, "stcwx"), (3, None)], "id int, text string")
    (r,) = evidence.snippets(docs, "id", "text", d).collect()
    assert (r.id, r.term, r.line_no, r.snippet) == (1, "stcw basic", 1, "STCW Basic [REDACTED], [REDACTED]")
    need = spark.createDataFrame([(1, "stcw"), (1, "GMDSS"), (2, "STCW"), (2, "stcw")], "id int, canonical string")
    got = {r.id: r for r in evidence.experience(evidence.entities(evidence.spans(docs, "id", "text", d), "id", {"every_term": None}), need, "id").collect()}
    assert (got[1].demonstrated, got[1].not_evidenced, len(got[1].evidence)) == (["stcw"], ["gmdss"], 1) and (got[2].demonstrated, got[2].not_evidenced, got[2].status) == ([], ["stcw"], "needs_review")


def test_running_sums(spark):
    arrays = [[], [5], list(range(255)), list(range(256)), list(range(257)), [1] * 5000, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for r in df.select("i", running_sums(F.col("a")).alias("s")).collect():
        a = arrays[r.i]
        assert r.s == (None if a is None else [sum(a[: k + 1]) for k in range(len(a))])
