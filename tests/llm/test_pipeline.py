import random
import re

import corpus_pipeline
import pytest
from brute import WORD, near
from quillmark.llm import toxicity
from test_others import fill

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped string, copies int, taken string, kept_text string, doc int, _row string, _id int"


def plain_lines(rows):
    """Rows (doc_id, text) without lines of LINE_DOCS documents, but for the first by (document, place)."""
    def first(at):
        (d, t), k = at
        return (d is not None, d or 0), t or "", k

    where: dict = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if key:
                where.setdefault(key, set()).add(((d, t), k))
    gone = set()
    for at in where.values():
        if len({d for d, _ in at}) >= corpus_pipeline.LINE_DOCS:
            gone |= at - {min(at, key=first)}
    out = []
    for d, t in rows:
        kept = [line for k, line in enumerate((t or "").split("\n")) if ((d, t), k) not in gone]
        out.append("\n".join(kept) if len(kept) < (t or "").count("\n") + 1 else t)
    return out


def words_of(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randint(0, 400))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(12)]
    rows, labels = [], []
    for k in range(420):
        t = text(rng.randint(40, 120))
        if k % 7 == 0:
            w = t.split()
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "scum"])
            t = " ".join(w)
        elif k % 7 == 1:
            t = f"{t}\nAll rights are reserved here\n{word()}"
        elif k % 7 == 2:
            at = len(t) // 2
            at = t.index(" ", at)
            t = t[:at] + " " + items[k % 12][1] + t[at:]
        elif k % 7 == 3 and k > 20:
            w = rows[k - 7][1].split()
            w[5] = "changed"
            t = " ".join(w)
        rows.append((k, t, rng.choice(["s1", "s2", None])))
        labels.append((k, 1, int(k % 7 == 0)))
    a, b = text(90), text(90)
    rows += [(None, a, "s1"), (None, b, None), (None, b + " more", "s2"), (500, a + " more", "s1"), (501, text(60), "s2"), (501, text(70), "s2"), (501, rows[4][1], "s1"), (502, None, None), (503, "", "s1"), (None, None, None), (504, "é" * 200_000, "s1"), (505, "one two", "s2"), (506, "one two", "s2")]
    folder = str(tmp_path_factory.mktemp("sf"))
    extra = lambda k: (77, "own", 5, "mine", "kept", 9, "r", 3)
    full = [(d, t, None if k % 5 else "en", s, len(t or ""), *extra(k)) for k, (d, t, s) in enumerate(rows)]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain(spark, folder, rows, items):
    """What run() must keep before the mix, by other means: sets of (doc_id, text) and how many of each group."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.trained(docs, labels)
    import pyarrow as pa

    score = model.score(pa.array([t for _, t, _ in rows], pa.string()))
    rest = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    texts = plain_lines([r[:2] for r in rest])
    found = near(list(enumerate(texts)), round(100 * corpus_pipeline.SIMILARITY))
    groups: dict = {}
    for (i, _, c), (d, _, s), t in zip(found, rest, texts):
        groups.setdefault(c, []).append(((d is None, d or 0), i, d, t, s))
    kept = []
    for members in groups.values():
        best = min(members)[0]
        kept.append([m[2:] for m in members if m[0] == best])
    items = [words_of(t) for _, t in items]

    def holds(t):
        w = words_of(t)
        return any(w[k : k + len(i)] == i for i in items for k in range(len(w)))

    return [g for g in kept if not holds(g[0][1])]


def test_run_matches_a_plain_version(spark, corpus):
    folder, rows, items = corpus
    want = plain(spark, folder, rows, items)
    got = corpus_pipeline.run(spark, folder).collect()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    assert set(got[0].asDict()) == {*names}
    # the mix takes words near each source's target from just these rows
    sizes: dict = {}
    for g in want:
        sizes[g[0][2]] = sizes.get(g[0][2], 0) + len(WORD.findall(g[0][1] or ""))
    possible = {(d, t, s) for g in want for d, t, s in g}
    assert {(r.doc_id, r.text, r.source) for r in got} <= possible
    assert len(got) == len({(r.doc_id, r.text, r.source) for r in got}) <= len(want)
    for s, target in fill(sizes, 1.5 * sum(sizes.values())).items():
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - target) <= 130
        assert all(r.copies in (1, 2) and r.taken == r.copies * len(WORD.findall(r.text or "")) for r in own)
    assert all((r.n_lines, r.n_dropped, r.kept_text, r.doc, r._row, r._id) == (77, "own", "kept", 9, "r", 3) for r in got)
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_stages_before_the_mix_keep_just_the_plain_rows(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "test")
        assert docs.columns == names
    want = plain(spark, folder, rows, items)
    got = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert len(got) == len(want)
    for g in want:
        assert sum(x in g for x in got) == 1


def test_empty_tables_go_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
