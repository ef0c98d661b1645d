import random
import re

import numpy as np
import pytest
from brute import WORD
from quillmark.llm import boosting, decontamination, html_main, mixing, resampling, token_counts, toxicity

ODD = [None, "", " ", "é" * 50_000, "a b c", "a b c"]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], "doc_id long, text string, source string, size int, target string")


def fill(sizes, total, cap=2.0, cycle=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: cycle[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if level * w[s] > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in names}
        full |= new


@pytest.mark.parametrize("block", [4096, 16])
def test_mixing(spark, block):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.choice([1, 3, 9, 30, 100])), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(400)]
    rows += [(None, None, "a"), (5, "x y", "a"), (5, "x y", "a"), (900, "", "empty")]
    plain = docs(spark, rows)
    df = plain.select("doc_id", "source", mixing.n_words(plain.text).alias("size"))
    got = mixing.mixed(df.repartition(3), block=block).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = fill(sizes, 1.5 * sum(sizes.values()))
    for s, target in want.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 100
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    again = mixing.mixed(df.repartition(5), block=block).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_deals_equal_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = spark.createDataFrame([(None, "a", 7)] * 500 + [(1, "b", 3)] * 200 + [(k, "b", k % 5) for k in range(100)], "doc_id long, source string, size int")
    run = mixing._block

    def counted(last):
        f = run(last)
        return lambda pdf: (f(pdf) if len(pdf) < 200 else pdf[:0][["row_key", "doc_id", "size", "nil", "name", "base", "p"]])

    monkeypatch.setattr(mixing, "_block", counted)  # a block that holds all equal rows would lose them
    got = mixing.mixed(rows, block=32).collect()
    assert len(got) == 800 and sum(r.taken for r in got if r.source == "a") > 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    p, size = rng.random(500), rng.integers(0, 900, 500).astype(float)
    q = mixing.flown(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4


def test_flight_keeps_probabilities():
    p, size = np.array([0.2, 0.7, 0.5, 0.4, 0.9, 0.3]), np.array([3.0, 1, 4, 1, 5, 9])
    mean = np.mean([mixing.flown(p, size, np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_resampling_matches_plain_counts(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("good fine nice".split() if k % 2 else "bad poor sad".split()) for _ in range(30)), "s") for k in range(200)] + [(1000 + k, t, None) for k, t in enumerate(ODD)] + [(None, "a b", None)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 100)] + [(None, 1, 0), (150, None, 0)], "doc_id long, quality int, toxic int")
    got = resampled = resampling.resampled(docs(spark, rows).repartition(3), labels).collect()
    assert len(resampled) == len(rows) and sum(r.selected for r in got) == round(0.5 * len(rows))
    assert sorted(r.sample_rank for r in got) == list(range(1, len(rows) + 1))
    keys = [r.gumbel_key for r in sorted(got, key=lambda r: r.sample_rank)]
    assert keys == sorted(keys, reverse=True)
    grams = lambda t: (w := re.findall(r"[a-z]+", t)) + [" ".join(x) for x in zip(w, w[1:])]
    raw, target = {}, {}
    for d, t, _ in rows:
        for g in grams(t or ""):
            raw[g] = raw.get(g, 0) + 1
            if d is not None and d < 100 and d % 2:
                target[g] = target.get(g, 0) + 1
    p = lambda c, g: np.log((c.get(g, 0) + 1) / (sum(c.values()) + resampling.BUCKETS))
    for r in got:
        if r.doc_id is not None and r.doc_id < 200:
            t = rows[r.doc_id][1]
            assert abs(r.log_weight - sum(p(target, g) - p(raw, g) for g in grams(t))) < 0.05
    assert sum(r.selected for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 2) >= 95


def test_html():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div><article><h1>Head &amp;amp;</h1><p><b>One<br><p>Two\n words &eacute;</p><script>x='</p>'</script></article><div id=comments><p>Nice post I must say so.</p></div><footer>F</footer>"
    assert html_main.main_text(page) == "Head &amp;\n\nOne\n\nTwo words é"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<<<>") .replace("<<<>", "") == ""
    assert html_main.main_text("<p>" + "word " * 100_000).count("word") == 100_000


def test_minimum_cut_is_least():
    rng = random.Random(6)
    for _ in range(60):
        n = 6
        keep, drop = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, float(rng.randint(0, 4))) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(d if s else k for s, k, d in zip(x, keep, drop)) + sum(c for a, b, c in edges if x[a] != x[b])
        got = html_main.content_side(n, list(map(float, keep)), list(map(float, drop)), edges)
        assert cost(got) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_html_table(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "u", "<article><p>x</p></article>")]
    got = html_main.extracted(spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "x", 1), (1, "", 0), (1, "", 0)]


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("sun moon tree lake road hill boat fish".split())
    rows = []
    for k in range(600):
        w = [word() for _ in range(40)]
        if k % 5 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["idiot", "gromblefoo", "gromblebar"])
        rows.append((k, " ".join(w), "s"))
    rows += [(2000 + k, t, None) for k, t in enumerate(ODD)] + [(None, "x", None)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows).repartition(3)
    model = toxicity.trained(df, labels)
    got = toxicity.scored(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got)
    bare = toxicity.trained(df, labels.where("false"))
    assert {r.score for r in toxicity.scored(df, bare).collect()} == {0.0}


def test_isotonic_rises():
    x, p = boosting.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_longest_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontamination.lcs(a, b)[0] == t[-1, -1]


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randint(0, 60))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 60)))) for k in range(20)]
    rows, want = [], set()
    for k in range(150):
        w = [word() for _ in range(rng.randint(0, 300))]
        if k % 5 == 0:
            i, t = items[k % 20]
            t = t.split()
            if k % 10 == 0:
                del t[3 :: 8]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "," for x in t] if k % 3 else t
            want.add((k, i))
        rows.append((k, " ".join(w), "s"))
    rows += [(2000 + k, t, None) for k, t in enumerate(ODD)] + [(None, items[0][1], None)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x y z")], "item_id long, text string")
    df = docs(spark, rows).repartition(3)
    fitted = decontamination.fitted_items(df, bench)
    got = decontamination.hits(df, fitted).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    kept = decontamination.without_hits(df, fitted)
    assert kept.columns == df.columns and kept.count() == len(rows) - len(want) - 1
    assert decontamination.hits(df, decontamination.fitted_items(df, bench.where("false"))).count() == 0


def test_decontamination_of_many_items(spark, monkeypatch):
    rng = random.Random(10)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randint(0, 60))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 59)))) for k in range(2000)]
    rows, want = [], set()
    for k in range(100):
        w = [word() for _ in range(rng.randint(50, 200))]
        if k % 2:
            i = k * 20 + 3
            at = rng.randint(0, len(w))
            w[at:at] = items[i][1].split()
            want.add((k, i))
        rows.append((k, " ".join(w), "s"))
    df = docs(spark, rows).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.hits(df, decontamination.fitted_items(df, bench)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    # an item of more windows than a part holds, and parts in passes of their own
    monkeypatch.setattr(decontamination, "PART", 8)
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 1 << 18)
    fitted = decontamination.fitted_items(df, spark.createDataFrame([items[23], (5000, rows[50][1] + " " + rows[48][1]), items[63]], "item_id long, text string"))
    long = docs(spark, [*rows[:4], (500, rows[50][1] + " " + rows[48][1], "s")])
    got = decontamination.hits(long, fitted).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 23), (3, 63), (500, 5000)]
    assert sorted(r.doc_id for r in decontamination.without_hits(long, fitted).collect()) == [0, 2]


def test_decontamination_of_hot_items(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randint(0, 999))
    often = [word() for _ in range(12)]
    items = [(0, " ".join(word() for _ in range(16))), (1, " ".join(often)), (2, " ".join(word() for _ in range(40)))]
    own, edited = items[0][1].split(), items[0][1].split()
    del edited[7::8]
    body = [word() for _ in range(150)]
    rows, want = [], set()
    for k in range(300):
        w = [word() for _ in range(150)]
        if k % 3 == 0:  # the hot group: one text that holds item 0
            w = [*body[:70], *own, *body[70:]]
            want.add((k, 0))
        elif k % 30 == 1:
            w[61:61] = edited if k % 60 == 1 else own
            want.add((k, 0))
        elif k % 30 == 2:
            w[90:90] = often
            want.add((k, 1))
        else:
            for x in rng.sample(often, 6):
                w[rng.randint(0, 149)] = x
        rows.append((k, " ".join(w), "s"))
    df = docs(spark, rows).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.hits(df, decontamination.fitted_items(df, bench)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)


def test_token_counts_round_trip(spark):
    texts = [*ODD, "Hello world, this is text. " * 30, "word " * 40_000]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(None, "z", None)]
    streams = token_counts.packed(docs(spark, rows).repartition(2), block=64)
    assert "tokens" not in streams.columns
    lengths = token_counts.scanned(streams, block=64)
    named = streams.select("stream", "block_no", "doc_ids").join(lengths, ["stream", "block_no"]).collect()
    got = sorted(((d, n) for r in named for d, n in zip(r.doc_ids, r.lengths)), key=repr)
    enc = token_counts.encoder(token_counts.vocabulary(token_counts.VOCABULARY))
    assert got == sorted(((d, len(enc.encode_ordinary(t or ""))) for d, t, _ in rows), key=repr)
    assert all(len(r.doc_ids) == len(r.lengths) for r in named)


def test_blocks_where_python_cannot_open_the_folder(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "can_open", lambda uri: False)
    streams = token_counts.packed(docs(spark, [(1, "a b c " * 100, None), (2, None, None)]), block=64)
    assert "tokens" in streams.columns
    assert sorted(n for r in token_counts.scanned(streams, block=64).collect() for n in r.lengths)[0] == 0


@pytest.mark.parametrize("ranges", [True, False])
def test_token_files_without_last_separator(spark, tmp_path, monkeypatch, ranges):
    ids = np.array([5, 6, 9, 9, 7, 7, 7, 7, 7, 9, 1, 2], dtype="<u4")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    monkeypatch.setattr(token_counts, "can_open", lambda uri: ranges)
    files = token_counts.token_files(spark, str(tmp_path), width=4, block=3)
    assert ("tokens" in files.columns) != ranges
    got = sorted(token_counts.scanned(files, end=9, width=4, block=3).collect(), key=lambda r: r.block_no)
    assert [n for r in got for n in r.lengths] == [2, 0, 5] and sum(r.open_tokens for r in got) == 2


def test_empty_tables(spark):
    empty = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert mixing.mixed(empty).count() == 0
    assert resampling.resampled(empty, labels).count() == 0
    assert toxicity.scored(empty, toxicity.trained(empty, labels)).count() == 0
    assert decontamination.hits(empty, decontamination.fitted_items(empty, bench)).count() == 0
    assert token_counts.scanned(token_counts.packed(empty)).count() == 0
    assert html_main.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
