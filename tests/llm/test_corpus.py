import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from quillmark.llm import collocation, divergence, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, rank int, phrase string, n_words int, salt int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "a", "a b c", "a b c", "É é É É é É", "x" * 200_000, "a " * 3_000, "a\tb\tb\x0bc c\r\nd.e,f", "the of the of the of " * 40, "#*$ %&| <>" * 30, "one two\none two\n\none two\n two"]


def rows(seed=1, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "And", "to", "Éa", "in", "red fox", "new york city", "w" + str(rng.randrange(60))])
    out = [(k, " ".join(word() + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.choice([5, 60, 130, 260]))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", None, "", "s3"])) for k in range(n)]
    out += [(1000 + k, t, "en", "s1") for k, t in enumerate(ODD)] + [(None, "the of and to", "lone", None)] + [(7, "red fox red fox", "en", "s2")] * 12
    return [(*r, 1, "x", 2, "y", 3, 4) for r in out]


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def by_sql(data, sql):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r[:4]) for r in data])
    r = c.sql(sql)
    return r.columns, r.fetchall()


def same(got, names, want):
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got))) == sorted(map(repr, want))


def test_divergence_matches_sql(spark):
    data = rows()
    names, want = by_sql(data, divergence.OP12_SQL)
    got = divergence.audited(table(spark, data).repartition(5)).collect()
    assert got[0].asDict().keys() == set(names) and any(r.part == "term" for r in got)
    same(got, names, want)


def test_divergence_without_vocabulary(spark):
    data = [(k, None, lang, s, 1, "", 1, "", 1, 1) for k, (lang, s) in enumerate([("en", "a"), ("en", "b"), ("en", "c"), ("fr", "a"), (None, None)])]
    got = divergence.audited(table(spark, data)).collect()
    assert sorted((r.lang, r.source, r.item, r.value, r["rank"]) for r in got) == [("en", "a", "b", 0, 1), ("en", "a", "c", 0, 2), ("en", "b", "a", 0, 1), ("en", "b", "c", 0, 2), ("en", "c", "a", 0, 1), ("en", "c", "b", 0, 2)]
    assert divergence.audited(table(spark, [])).count() == 0


def test_shares_are_exact(spark):
    big = spark.createDataFrame([(10**15 - 3, 10**15 + 7, 12345), (0, 0, 1)], "n long, t long, v long")
    got = [r.p for r in big.select(divergence.share("n", "t", "v").alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in [(10**15 - 3, 10**15 + 7, 12345), (0, 0, 1)]]


def phrases_brute(data, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3):
                counts.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    best = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    found = []
    for (lang, p), a in best.items():
        if any(len(q) > len(p) and m == lang and 100 * f >= 50 * a and p in [q[k : k + len(p)] for k in range(len(q) - len(p) + 1)] for (m, q), f in best.items()):
            continue
        s, _, l, r = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, -s, -a, " ".join(p).encode(), a, l, r, totals[lang], s))
    out, place = [], Counter()
    for lang, _, _, p, *rest in sorted(found):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], p.decode(), *rest))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 3, "PATTERNS": 2, "GATHERED": 7}, {"CHUNK": 50, "PATTERNS": 1000, "GATHERED": 100}])
def test_collocations_match_plain_counts(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(collocation, name, value)
    data = rows(n=60) if sizes.get("CHUNK") != 3 else [r for r in rows(n=40) if len(r[1] or "") < 900]
    # with few bits most runs are counted although their cells fall short
    got = collocation.collocations(table(spark, data).repartition(3), least=10, top=30, bits=1 << (15 if sizes else 28)).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == phrases_brute(data, 10, 30)
    assert len(got) > 10


def test_chunks_and_automata(monkeypatch):
    monkeypatch.setattr(collocation, "CHUNK", 4)
    monkeypatch.setattr(collocation, "PATTERNS", 3)
    text = "a b a b a b a b c a b. a b c c c c; b a"
    full = np.full(1 << 12, 255, np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, None])], names=["lang", "text"])
    got = Counter()
    for b in collocation._scanned(iter([batch]), full):
        for r in b.to_pylist():
            got[r["phrase"]] += r["n"]
    want = Counter()
    for piece in re.split("[.;]", text):
        w = piece.split()
        want[""] += len(w)
        for n in (1, 2, 3):
            want.update(" ".join(w[k : k + n]) for k in range(len(w) - n + 1))
    assert got == want


def test_collocations_of_nothing(spark):
    assert collocation.collocations(table(spark, [])).count() == 0
    assert collocation.collocations(table(spark, [(1, None, None, None, 1, "", 1, "", 1, 1), (2, "a b", "en", "s", 1, "", 1, "", 1, 1)])).count() == 0


def test_scores_are_exact(spark):
    nums = [(10**11 + 7, 10**11 + 9, 10**11 + 11), (10, 1, 3)]
    df = spark.createDataFrame(nums, "a long, l long, r long")
    assert [r.s for r in df.select(collocation.score(df.a, df.l, df.r).alias("s")).collect()] == [10**6 * a * a // (l * r) for a, l, r in nums]


def test_quality_rules_match_sql(spark):
    data = rows(3, 240) + [(2000, " ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26)}%%%" for k in range(200)), "en", "s", 1, "", 1, "", 1, 1)]
    names, want = by_sql(data, quality_rules.OP11_SQL)
    got = quality_rules.judged(table(spark, data).repartition(4)).collect()
    same(got, names, want)
    assert {r.kept for r in got} == {True, False} and any(not r.base_failed and not r.kept for r in got)


def test_repeats_brute(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(12)] + [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (30, 90, 300)] + ODD
    got = {r.doc_id: r for r in quality_rules.judged(table(spark, [(k, t, "en", "s", 1, "", 1, "", 1, 1) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[k].n_words, got[k].n_repeat_words, got[k].word_chars, got[k].n_dup_lines, got[k].n_symbols) == (len(w), len(covered), sum(map(len, w)), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t or ""))), t


def test_quality_rules_are_native(spark, tmp_path):
    table(spark, rows(n=30)).write.parquet(str(tmp_path / "documents.parquet"))
    df = quality_rules.op11_quality_rules(spark, str(tmp_path))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert quality_rules.judged(table(spark, [])).count() == 0


def test_quality_rules_judge_by_language(spark):
    rng = random.Random(2)
    common = "the of and to in that is was for on with as by at from".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)) + "."
    odd = {900: prose(300).replace(" ", "%%% "), 901: prose(300).upper(), 902: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300))}
    data = [(k, prose(rng.choice([60, 200, 400])), "en", "s", 1, "", 1, "", 1, 1) for k in range(60)] + [(k, t, "en", "s", 1, "", 1, "", 1, 1) for k, t in odd.items()]
    got = {r.doc_id: r for r in quality_rules.judged(table(spark, data)).collect()}
    assert all(got[k].kept for k in range(60)) and not any(got[k].kept or got[k].base_failed for k in odd)
