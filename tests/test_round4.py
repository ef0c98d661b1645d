"""Rows that stay where their text or page is; equal periods in a union."""

import random
import re

import pytest
from pyspark.sql import functions as F
from quillmark.operators import evidence, geometry, intervals, older


def exchanges(df):
    """How often rows are shuffled; what is sent to all tasks doesn't count."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?:hash|range|Round|Single)", plan))


def dealt(spark, rows, names):
    return spark.createDataFrame(rows, names).repartition(4, "id")


def test_entities_stay_with_their_text(spark):
    d = spark.createDataFrame([("rank", "Mate", "mate", 1), ("rank", "Mate", "second mate", 0), ("ship", "tanker", "tanker", 0)], "kind string, canonical string, term string, ord int")
    docs = dealt(spark, [(1, "mate, second mate of a tanker"), (2, "Mate mate"), (3, None)], "id int, text string")
    found = evidence.spans(docs, "id", "text", d)
    e = evidence.entities(found, "id", {"first_term": ["rank"], "longest_first": None, "every_term": ["ship"]})
    # the one shuffle is that by which the documents are dealt
    assert exchanges(found) == exchanges(e) == 1
    assert {(r.id, r.canonical, r.start, r.end, r.method) for r in e.collect()} == {(1, "Mate", 0, 4, "longest_first"), (1, "Mate", 6, 17, "first_term"), (1, "tanker", 23, 29, "longest_first"), (2, "Mate", 0, 4, "first_term"), (2, "Mate", 5, 9, "longest_first")}
    with pytest.raises(ValueError):
        evidence.entities(found, "id", {"other": None})


def test_keywords_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "diesel engine, diesel pump", "a"), (2, "x", "b"), (3, "deck", "a")], "id int, text string, vac string")
    posts = spark.createDataFrame([("a", "diesel engine engine"), ("b", "-")], "vac string, post string")
    got = older.keyword_points(docs, "id", "text", "vac", posts, "post", [])
    # no word becomes a row
    assert exchanges(got) == 0 and "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.match_pct, r.missing) for r in got.collect()} == {1: (100.0, []), 2: (0.0, ["-"]), 3: (0.0, ["diesel", "engine"])}


def test_equal_periods_bridge_no_gap(spark):
    """The page of F5: two equal spans after a gap."""
    spans = spark.createDataFrame([(1, a, b) for a, b in ((7.0, 10.0), (19.0, 23.0), (37.0, 37.5), (40.0, 40.5), (40.0, 40.5), (43.0, 45.5))], "p int, a double, b double")
    assert geometry.union_length(spans, ["p"], "a", "b").first().union_length == 10.5
    days = spans.select("p", *[F.date_add(F.lit("2020-01-01"), (F.col(c) * 2).cast("int")).alias(n) for c, n in (("a", "start"), ("b", "end"))], F.lit("x").alias("g"))
    assert {(r.group_key, r.n_merged, r.union_days, r.n_periods) for r in intervals.group_totals(days, "p", ["g"]).collect()} == {("all", 5, 21, 6), ("g:x", 5, 21, 6)}


def plain_columns(boxes, width, height):
    """has_columns of one page, box by box."""
    real = [b for b in boxes if None not in b]
    if len(boxes) < geometry.LEAST_ON_PAGE or not height > 0:
        return False
    for g in geometry.GUTTERS:
        x, low, bands = width * g / 100, 0.0, []
        for y0, y1 in sorted((b[2], b[3]) for b in real if b[0] < x < b[1] and b[3] > b[2]):
            bands.append((low, y0))
            low = max(low, y1)
        for lo, hi in [*bands, (low, height)]:
            sides = []
            for right in (False, True):
                s = [b for b in real if (b[0] >= x and b[1] > x if right else b[1] <= x) and b[3] > lo and b[2] < hi and hi > lo]
                cover, at = 0.0, lo
                for y0, y1 in sorted((b[2], b[3]) for b in s):
                    cover, at = cover + max(0.0, min(y1, hi) - max(y0, at)), max(at, min(y1, hi))
                flush = s and sum(max(b[1] for b in s) - b[1] <= 2 for b in s) / len(s) >= 0.8 and max(b[1] - b[0] for b in s) < 0.3 * width
                sides.append(len(s) >= 3 and cover >= 0.05 * height and not (right and flush))
            if all(sides):
                return True
    return False


def test_columns_make_no_row_of_each_gutter(spark):
    """F8: boxes without a place, upside down, equal, above the page; pages without boxes or height."""
    r = random.Random(3)
    rows = []
    for p in range(300):
        for _ in range(r.randint(0, 14)):
            x, y = r.choice([2, 42, 42, r.randint(0, 60)]), r.randint(-3, 20) * 5
            rows.append((p, *[None if r.random() < 0.02 else float(v) for v in (x, x + r.choice([5, 20, 30, 36]), y, y + r.choice([-5, 0, 10, 10, 20]))]))
    boxes = spark.createDataFrame([*rows, *rows[:20], (None, 1.0, 2.0, 3.0, 4.0)], "p int, x0 double, x1 double, y0 double, y1 double").repartition(3)
    pages = spark.createDataFrame([(p, 80.0, 0.0 if p % 50 == 0 else 100.0) for p in range(301)], "p int, width double, height double")
    found = geometry.has_columns(boxes, pages, ["p"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and exchanges(found) <= 4
    want = {p: plain_columns([x[1:] for x in [*rows, *rows[:20]] if x[0] == p], 80.0, 0.0 if p % 50 == 0 else 100.0) for p in range(301)}
    assert {r.p: r.columns for r in found.collect()} == want and 20 < sum(want.values()) < 280


def test_terms_found_as_spans(spark):
    """signs, runs of blanks, capitals; found without places and contexts."""
    d = spark.createDataFrame([(k, n, x, 0) for k, n, x in (("skill", "C++", "c++"), ("skill", "C", "c"), ("rank", "Mate", "second  mate"), ("rank", "Mate", "mate"), ("skill", "net", ".net"))], "kind string, canonical string, term string, ord int")
    docs = dealt(spark, [(1, " C++ and c\t c++x"), (2, "Second\n\n MATE, asp.net"), (3, "use .NET; xc++ ((c))"), (4, None), (5, " ")], "id int, text string")
    cols = ["id", "kind", "canonical", "term"]
    found = evidence.terms_found(docs, "id", "text", d)
    assert exchanges(found) == 1 and sorted(found.collect()) == sorted(evidence.spans(docs, "id", "text", d).select(*cols).collect())
    assert {(r.id, r.term) for r in found.collect()} >= {(1, "c++"), (1, "c"), (2, "second  mate"), (2, "mate"), (3, ".net"), (3, "c")}
