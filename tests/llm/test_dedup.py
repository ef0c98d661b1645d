import hashlib
import random
import re

import numpy as np
import pytest
from brute import near
from quillmark.llm import components, exact_dedup, line_dedup, near_dedup, textkit

SCHEMA = "doc_id long, text string, rep string, n int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz AA Bb".split()) + str(rng.randint(0, 30)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " "), (4, "a\tb"), (5, "a  b"), (6, "a b"), (6, "a b"), (None, "a b"), (None, None), (7, "x" * 300_000), (8, "x" * 300_000), (9, "É é"), (10, "\n\n")]


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for d, _ in rows:
        pass
    for (d, _), t in zip(rows, norm):
        ids = [x for (x, _), u in zip(rows, norm) if u == t]
        known = [x for x in ids if x is not None]
        out.append((d, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [4096, 2])
def test_exact_classes(spark, fan_in):
    rows = ODD + [(100 + k, "same") for k in range(20)]
    got = exact_dedup.exact_classes(table(spark, rows).repartition(5), fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("fan_in", [4096, 2])
def test_colliding_fingerprints_are_compared(spark, fan_in):
    rows = [(k, f"text {k % 5}") for k in range(30)]
    got = exact_dedup.exact_classes(table(spark, rows).repartition(6), print_of=lambda b: (1, 2, len(b)), fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_brute(rows)


def test_fingerprints_combine():
    data = bytes(np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8))
    whole = exact_dedup.fingerprint(data)
    parts = [exact_dedup.chunk_hash(data[k : k + 1000]) for k in range(0, len(data), 1000)]
    total = parts[0]
    for p in parts[1:]:
        total = exact_dedup.combined(total, p)
    assert (*total[0], total[1]) == whole
    assert exact_dedup.fingerprint(b"ab") != exact_dedup.fingerprint(b"ba")


def lines_brute(rows, least, keep_first, least_chars=1):
    docs = sorted({(d is not None, d or 0, t or "", d) for d, t in rows}, key=lambda x: (x[0], x[1]))
    at = {}
    for _, _, t, d in docs:
        for k, line in enumerate(t.split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(key) >= least_chars:
                at.setdefault(key, []).append((d, t, k))
    gone = set()
    for where in at.values():
        if len({(d, t) for d, t, _ in where}) >= least:
            gone |= set(where[1:] if keep_first else where)
    out = []
    for d, t in rows:
        t = t or ""
        kept = [line for k, line in enumerate(t.split("\n")) if (d, t, k) not in gone]
        out.append((d, t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 3])
def test_lines_dropped(spark, least):
    rng = random.Random(3)
    pool = ["Hot line", "b", "c  c", "  d ", "é", "", "A b", "zz"]
    rows = ODD + [(50 + k, "\n".join([" hot LINE"] + [rng.choice(pool) for _ in range(rng.randint(0, 6))])) for k in range(60)]
    df = table(spark, rows).repartition(4)
    got = line_dedup.without_lines(df, line_dedup.keep_bitmaps(df, least, 1, keep_first=False))
    assert got.columns[:4] == df.columns
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == lines_brute(rows, least, False)


def test_first_lines_kept(spark):
    rows = [(k, f"hot\nown {k}\nHOT ") for k in range(40)] + [(90, "hot"), (91, None)]
    df = table(spark, rows).repartition(3)
    got = line_dedup.without_lines(df, line_dedup.keep_bitmaps(df, 10, 1, keep_first=True)).collect()
    assert sum(r.kept_text.lower().count("hot") for r in got) == 1
    assert [r.kept_text for r in got if r.doc_id == 0] == ["hot\nown 0"]
    assert all(f"own {r.doc_id}" in r.kept_text for r in got if r.doc_id < 40)


def test_bitmaps_are_whole():
    keep = line_dedup.bitmap(np.array([0, 9]))
    assert line_dedup.unpacked(keep, 12).tolist() == [False] + [True] * 8 + [False, True, True]


def near_rows(rng):
    base = [prose(rng, 60) for _ in range(6)]
    rows = list(ODD)
    for k in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 99)}"
        rows.append((1000 + k, " ".join(w) if k % 3 else "\n".join(w).upper()))
    rows += [(2000, "one two"), (2001, "one  two"), (2002, "one two three four five"), (2003, prose(rng, 20_000))]
    return rows


@pytest.mark.parametrize("small", [12, 1])
def test_near_groups(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rows = near_rows(random.Random(5))
    got = near_dedup.near_groups(table(spark, rows).repartition(4), 0.85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(near(rows, 85), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_one_id(spark):
    rng = random.Random(17)
    rows = []
    for k in range(2500):
        w = [str(rng.randint(0, 10**6)) for _ in range(40)]
        rows += [(None if k % 2 else 7, " ".join(w)), (None if k % 2 else 7, " ".join([*w, "more"]))]
    rows += [(None, rows[1][1])] * 300 + [(3, rows[0][1])]
    got = near_dedup.near_groups(table(spark, rows).repartition(4), 0.85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(near(rows, 85), key=repr)


def test_near_pairs_close_to_the_threshold_are_found(spark):
    rng = random.Random(18)
    rows = []
    for k in range(1500):  # runs of one text: similarity x / (x + 2 * cut) of its shingles
        w = [str(rng.randint(0, 10**6)) for _ in range(400)]
        cut = rng.choice([26, 28, 29, 30, 31, 34])
        rows += [(2 * k, " ".join(w[:-cut])), (2 * k + 1, " ".join(w[cut:]))]
    got = near_dedup.near_groups(table(spark, rows).repartition(4), 0.85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near(rows, 85))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = h[:2000], h[500:2500]
    x, y = near_dedup.sketch(a), near_dedup.sketch(b)
    assert (near_dedup.merged(x, y) == near_dedup.sketch(h[:2500])).all()
    assert abs(near_dedup.estimated(x, y, len(a), len(b)) - 0.6) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 150: 150, 200: 150}


def test_shingles_match_plain_words():
    import pyarrow as pa
    from brute import shingles

    texts = [None, "", "a b", "A b c d e f", "é É  x\x0by\x0c z q", "w" * 3_000_000 + " x y z u v", "a b c d e a b c d e"]
    sets = textkit.shingle_sets(textkit.words(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]


def test_empty_tables(spark):
    empty = table(spark, [])
    assert exact_dedup.exact_classes(empty).count() == 0
    assert near_dedup.near_groups(empty).count() == 0
    assert line_dedup.without_lines(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_near_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(200))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " more"
    rows = [(1, a), (None, near(a)), (None, b), (2, near(c)), (2, d), (0, c), (3, e), (3, e), (3, near(e)), (None, f), (None, f), (4, ""), (None, None)]
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)
    got = corpus_pipeline.near_stage(spark, df, "")
    assert got.columns == df.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    assert len(got) == 8
    assert {g for g in got if g[0] != 3} == {(1, a), (None, b), (2, d), (0, c), (None, f), (4, ""), (None, None)}
    assert [g for g in got if g[0] == 3][0] in [(3, e), (3, near(e))]
