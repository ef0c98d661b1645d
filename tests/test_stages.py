"""Stages of a rewrite and column splits against plain versions."""

import random
import re

from pyspark.sql import functions as F
from quillmark.operators import geometry, stages


def plain_stage(original, first, strict):
    facts = lambda t: {re.sub(r"[,.]+(%?)$", r"\1", x).replace(",", "") for x in re.findall(r"\d[\d,.]*%?", t or "")}
    units = lambda t: sorted(re.findall(r"\d+ gb", t or ""))
    (t0, s0) = original

    def look(attempt):
        if attempt is None or attempt[0] is None:
            return "failed", None
        if any(units(attempt[0]).count(x) > units(t0).count(x) for x in units(attempt[0])):
            return "rejected", None
        return "written", bool(facts(attempt[0]) - facts(t0))

    (o1, risk), trail = look(first), []
    after = first[1] if o1 == "written" else s0
    trail = ["score", "rewrite", "rescore" if o1 == "written" else "fallback"]
    taken = False
    if risk or (o1 == "written" and after - s0 < 15):
        trail.append("strict")
        o2, risk2 = look(strict)
        if o2 == "written" and not risk2 and (risk or strict[1] > after):
            taken, risk, after = True, False, strict[1]
    if risk or after < s0:
        return "original", s0, [*trail, "rollback", "done"]
    return "strict" if taken else "rewritten" if o1 == "written" else "fallback", after, [*trail, "done"]


def test_stages_match_a_plain_run(spark):
    rng = random.Random(6)
    text = lambda: rng.choice([None, "", "kept 5 gb of logs", "kept 6 gb", "no figures", "in 2020 on 3 ships", "5 gb 5 gb", "on 3 ships"])
    rows = [((text(), rng.randrange(100)), rng.choice([None, (text(), rng.randrange(100))]), rng.choice([None, (text(), rng.randrange(100))])) for _ in range(400)]
    originals = spark.createDataFrame([(k, *r[0]) for k, r in enumerate(rows)], "k int, text string, score int")
    attempts = spark.createDataFrame([(k, s, *a) for k, r in enumerate(rows) for s, a in ((False, r[1]), (True, r[2])) if a], "k int, strict boolean, text string, score int")
    done = stages.run(originals, attempts, "k")
    for r in done.collect():
        assert (r.state, r.score, [s.stage for s in r.trail]) == plain_stage(*rows[r.k]), rows[r.k]
    assert {r.state for r in done.collect()} == {"rewritten", "strict", "fallback", "original"}
    trail = stages.audit(done, "k")
    assert trail.where("stage = 'done'").count() == 400 and trail.where("step = 1 AND stage <> 'score'").count() == 0
    assert stages.run(originals.where("false"), attempts, "k").count() == 0


def plain_split(words, width, least):
    """Best of the gutter (given) and five ratios, as (choice, headings, stray, text)."""
    def lay(part):
        out, last = [], None
        for w in sorted(part, key=lambda w: (w[3], w[1], w[0])):
            if last is None or w[3] - last > 3:
                out.append([])
            out[-1].append(w)
            last = w[3]
        lines = [" ".join(w[0] for w in sorted(x, key=lambda w: (w[1], w[3], w[0]))) for x in out]
        return [x for x in lines if not (len(x.strip()) == 1 and x.strip().isalpha())]

    best = None
    for k, split in enumerate([least, *[width * r for r in (0.45, 0.5, 0.55, 0.6, 0.65)]]):
        left, right = lay([w for w in words if w[1] < split]), lay([w for w in words if w[1] >= split])
        text = "\n".join(left) + "\n" + "\n".join(right)
        stray = sum(1 for x in left + right if len(x.split()) <= 1 and not x.isupper() and len(x) < 15)
        head = sum(h in text.lower() for h in ("summary", "experience", "education", "skills", "certifications", "license", "documents", "courses"))
        if best is None or (head, -stray, len(text)) > best[0]:
            best = ((head, -stray, len(text)), k, text)
    return best[1], best[2]


def test_best_split(spark):
    rng = random.Random(8)
    rows, pages = [], []
    for p in range(12):
        cut = rng.choice([30, 45, 60])
        for _ in range(60):
            right = rng.random() < 0.5
            x = rng.uniform(cut + 8, 90) if right else rng.uniform(0, cut - 20)
            rows.append((p, rng.choice(["skills", "EDUCATION", "word", "a", "two", "licensed"]) + rng.choice(["", "", "s"]), round(x, 2), round(x + 9, 2), rng.randrange(40) * 2.0))
        pages.append((p, 100.0))
    rows += [(90, "one", float(k), k + 1.0, 0.0) for k in range(30)]  # one column
    w = spark.createDataFrame(rows, "page int, text string, x0 double, x1 double, top double")
    pg = spark.createDataFrame([*pages, (90, 100.0)], "page int, width double")
    got = {r.page: r for r in geometry.best_split(w, pg, ["page"], 5.0).collect()}
    gut = {r.page: r.split for r in geometry.gutter(w, pg, ["page"], 5.0).collect()}
    assert 90 not in got and len(got) >= 8
    for p, r in got.items():
        own = [(t, a, b, top) for q, t, a, b, top in rows if q == p]
        assert (r.choice, r.text) == plain_split(own, 100.0, gut[p])
    assert len({r.choice for r in got.values()}) > 1
    assert geometry.best_split(w.where(F.lit(False)), pg, ["page"]).count() == 0
