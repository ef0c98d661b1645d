"""Datasets without leaks, components by union-find, lists filled up to a quota."""

import os
import random

from pyspark.sql import functions as F
from quillmark.operators import dataprep, datasets


def test_components_and_hold_out(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [("hub", f"h{k}") for k in range(300)] + [("self", "self")] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    least: dict = {}
    for x in list(root):
        least[find(x)] = min(x, least.get(find(x), x))
    got = {r.node: r.component for r in dataprep.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: least[find(x)] for x in root}
    assert dataprep.components(spark.createDataFrame([], "a string, b string")).count() == 0
    for n, fraction in ((1, 0.2), (2, 0.2), (7, 0.5), (40, 0.2), (33, 0.05)):
        names = [f"g{k:02}" for k in range(n)]
        rows = spark.createDataFrame([(g, k) for g in names for k in range(3)], "g string, k int")
        held = {r.g for r in dataprep.held_out_groups(rows, "g", fraction).where("split = 'validation'").collect()}
        want = 0 if n == 1 else max(1, min(n - 1, round(n * fraction)))
        assert held == set(names[n - want :] if want else [])


def test_prepared(spark, tmp_path):
    rng = random.Random(5)
    feedback = [(rng.choice(["rewrite_preference", "score_correction", None]), f"mail a.b@c.org or +44 20 7946 0958 or 12345 {k}", "passport no: X12345", None, f"g{k % 7}", f"ref{k}", k) for k in range(80)]
    rankings = [(f"v{rng.randrange(30)}", f"c{rng.randrange(60)}", k) for k in range(70)] + [("v0", "c0", 1), ("v0", "c1", 1)]
    p = datasets.prepared(spark.createDataFrame(feedback, "kind string, prompt string, preferred string, rejected string, split_group string, consent_record_ref string, n int"), spark.createDataFrame(rankings, "vacancy_ref string, candidate_ref string, relevance int"))
    for a, b, cols in (("rewrite_train", "rewrite_valid", ["source_group"]), ("ranking_train", "ranking_valid", ["vacancy_ref"]), ("ranking_train", "ranking_valid", ["candidate_ref"])):
        assert p[a].count() and p[b].count() and p[a].select(cols).intersect(p[b].select(cols)).count() == 0
    r = p["rewrite_train"].first()
    assert r.prompt.startswith("mail [redacted email] or [redacted number] or 12345") and r.chosen == "passport [redacted]" and r.rejected == ""
    assert p["corrections_review"].where("preferred LIKE '%X12345%' OR prompt LIKE '%@%'").count() == 0
    m = {x.dataset: x for x in datasets.written(p, str(tmp_path)).collect()}
    assert m["ranking_train"].n_rows + m["ranking_valid"].n_rows == 72 and sum(m[k].n_rows for k in ("rewrite_train", "rewrite_valid", "corrections_review")) == 80
    again = {x.dataset: x for x in datasets.written({k: d.repartition(3) for k, d in p.items()}, str(tmp_path / "b")).collect()}
    assert m == again and sorted(os.listdir(tmp_path))[0] == "b" and (tmp_path / "manifest").exists()


def test_filled_lists(spark):
    def plain(items, defaults, quota):
        own, seen = [], set()
        for x in items or []:
            if x is not None and x.lower().strip() not in seen:
                seen.add(x.lower().strip())
                own.append(x)
        have, out = {x.lower() for x in own}, [(x, "source") for x in own]
        for x in defaults or []:
            if x is not None and x.lower() not in have and len(out) < quota and x.lower().strip() not in {d.lower().strip() for d, o in out if o == "padded"}:
                out.append((x, "padded"))
        return out

    rng = random.Random(1)
    some = lambda: rng.choice([None, [rng.choice(["a", " A", "b ", "B", "c", None, "", "d"]) for _ in range(rng.randrange(9))]])
    rows = [(k, some(), some(), rng.randrange(8)) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, i array<string>, d array<string>, q int")
    for r in df.select("k", datasets.filled(F.col("i"), F.col("d"), F.col("q")).alias("f"), datasets.filled(F.col("i"), F.col("d"), F.col("q"), False).alias("g")).collect():
        want = plain(*rows[r.k][1:])
        assert [tuple(x) for x in r.f] == want, rows[r.k]
        assert [tuple(x) for x in r.g] == [x for x in want if x[1] == "source"]
