"""Steps whose rows or memory in a task must not grow faster than their input."""

import math
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from quillmark.operators import geometry, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [10_000, 4])
def test_best_match_makes_no_pair_rows(spark, monkeypatch, block):
    """Odd vectors too: zeros, nulls, other lengths, repeated ids, equal vectors, halves of the last digit."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rows = [(k, [float(k * 7 % 11), float(k % 5), 1.0]) for k in range(24)] + [(30, [0.0, 0.0, 0.0]), (31, None), (32, [1.0, None, 2.0]), (33, [1.0, 2.0]), (33, [2.0, 1.0]), (34, [2.0, 4.0]), (35, []), (36, [float("nan"), 1.0, 1.0]), (40, [1.0, 0.0, 0.0, 0.0]), (41, [0.0000005, 1.0, 0.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    clean = df.where("id IS NULL OR id <> 36")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return float(Decimal(repr(sum(x * y for x, y in zip(a, b)) / n)).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)) if n else None

    own = [(k, v) for k, v in rows if k is not None and k != 36]
    want = {}
    for k, v in own:
        for m, w in own:
            c = cosine(v, w)
            if m != k and (k not in want or (c is not None, c or 0, -m) > want[k][0]):
                want[k] = (c is not None, c or 0, -m), m, c
    found = retrieval.best_match(clean, clean, 0.65)
    assert {r.id: (r.match_id, r.similarity) for r in found.collect()} == {k: x[1:] for k, x in want.items()}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert all(math.isnan(r.similarity) for r in retrieval.best_match(df.where("id = 36"), df, 0.65).collect())
    assert retrieval.best_match(df.where("id < 0"), df, 0.65).count() == 0 == retrieval.best_match(df.where("id = 1"), df.where("id = 1"), 0.65).count()


def test_pair_tfidf_makes_no_term_rows(spark):
    pairs = spark.createDataFrame([(1, "a b b", "b c"), (2, "A x", "a X"), (3, "a", None), (4, "--", ""), (5, "p q", "r"), (6, "k", "m"), (6, "m", "k k")], "k int, a string, b string")
    found = retrieval.pair_tfidf(pairs, ["k"], "a", "b")
    s = (math.log(1.5) + 1) ** 2
    got = {r.k: r.cosine for r in found.collect()}
    assert got == pytest.approx({1: 2 / math.sqrt((4 + s) * (1 + s)), 2: 1.0, 3: None, 5: 0.0, 6: 3 / math.sqrt(2 * 5)})
    assert "Generate" not in plan(found) and "Join" not in plan(found)


def test_best_split_makes_no_row_of_each_choice(spark):
    """Words without a place, a top or a text too, equal words, pages without words in two columns."""
    words = [(p, f"{'skills' if (p + k) % 9 == 0 else 'ab'}{k % 3}", float(k % 2 * 50 + k % 5 * 3), float(k % 2 * 50 + k % 5 * 3 + 6), float(k // 4 * 2)) for p in range(6) for k in range(40)]
    words += [(1, None, 4.0, 9.0, 6.0), (1, "x", 70.0, 75.0, None), (2, "lone", None, None, 500.0), (2, "lone", None, 3.0, 900.0), (7, "a", 1.0, 2.0, 3.0), (None, "a", 1.0, 2.0, 3.0)]
    w = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double").repartition(3)
    pages = spark.createDataFrame([(p, 100.0) for p in range(9)], "page int, width double")
    found = geometry.best_split(w, pages, ["page"], 5.0)
    got = {r.page: r for r in found.collect()}
    assert sorted(got) == list(range(6)) and all("\n" in r.text for r in got.values())
    # a line on no side counts as a stray one
    assert got[2].stray == got[5].stray + 2 and got[2].split == got[5].split
    gutters = {r.page: r.split for r in geometry.gutter(w, pages, ["page"], 5.0).collect()}
    assert all(r.split == gutters[p] for p, r in got.items() if r.choice == 0)
    assert "Window" not in plan(found) and "Generate" not in plan(found)
