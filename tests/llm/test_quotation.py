import random
import re

import pytest
from quillmark.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)


def plain_units(lines):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower() for x in lines]
    paragraphs, run = [], []
    for x in [*norm, ""]:
        if x:
            run.append(x)
        elif run:
            paragraphs.append(" ".join(run))
            run = []
    found = {" ".join(paragraphs), *paragraphs, *norm, *(s for p in paragraphs for s in re.split(r"(?<=[.!?…])\s+", p))}
    return found - {""}


def split(text):
    """(own lines with an empty one at each quote, [(depth, lines)])."""
    own, quotes, last = [], [], 0
    for line in (text or "").split("\n"):
        m = re.match(r"^((?:[ \t]*>)+)[ \t]?(.*)$", line)
        depth = m[1].count(">") if m else 0
        if depth:
            if depth != last:
                quotes.append((depth, []))
                own.append("")
            quotes[-1][1].append(m[2])
        else:
            own.append(line)
        last = depth
    return own, quotes


def plain(rows):
    """(conv, turn, role, text without quotes) -> (position, reply_to, thread), for texts without introducing lines."""
    out = {}
    for conv in {r[0] for r in rows}:
        msgs = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = [plain_units(split(m[3])[0]) for m in msgs]
        parent, linked = [], []
        for i, m in enumerate(msgs):
            votes = {}
            for depth, lines in split(m[3])[1]:
                for u in plain_units(lines):
                    at = next((j for j in range(i - 1, -1, -1) if u in said[j]), None)
                    if at is not None:
                        votes[depth, at] = votes.get((depth, at), 0) + len(u.split(" "))
            best = min(votes, key=lambda k: (k[0], -votes[k], -k[1])) if votes else None
            linked.append(best[1] if best else None)
            parent.append(best[1] if best else i - 1 if i else None)
        order = []

        def read(i):
            order.append(i)
            for j in range(i + 1, len(msgs)):
                if parent[j] == i:
                    read(j)

        read(0)
        for i, m in enumerate(msgs):
            top = i
            while linked[top] is not None:
                top = linked[top]
            out[m] = (order.index(i), parent[i], top)
    return out


def conversation(rng, conv, n):
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randint(0, 40))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(2, 9))).capitalize() + rng.choice([".", ".", "?", ""])
    msgs = []
    for k in range(n):
        lines = []
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if not msgs:
                break
            source, depth = split(rng.choice(msgs))[0], rng.choice([1, 1, 2])
            words = " ".join(source).split(" ")
            kind = rng.random()
            if kind < 0.4:  # all of it, wrapped anew
                at = rng.randint(1, max(1, len(words)))
                quote = [" ".join(words[:at]), " ".join(words[at:])]
            elif kind < 0.7:
                quote = [rng.choice(source)]
            else:
                quote = [f"{word()} never said"]
            lines += [">" * depth + rng.choice(["", " "]) + q.upper() for q in quote]
            lines += rng.choice([[], [""], ["ok"]])
        lines += [sentence() for _ in range(rng.randint(0, 3))] + rng.choice([[], ["thanks"], ["", sentence()]])
        msgs.append("\n".join(lines))
    return [(conv, k, rng.choice(["user", "assistant"]), t) for k, t in enumerate(msgs)]


@pytest.mark.parametrize("stretch", [4096, 3])
def test_against_a_plain_version(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotation, "ROWS", stretch)
    rng = random.Random(51)
    rows = [r for c in range(32) for r in conversation(rng, c, rng.randint(1, 14))] + conversation(rng, None, 40)
    want = plain(rows)
    got = quotation.linked(table(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    mine = {(r.conv_id, r.turn): (r.position, r.reply_to, r.thread) for r in got}
    assert mine == {m[:2]: x for m, x in want.items()}
    assert sum(r.by_quote for r in got) > 60 and any(r.position != r.turn for r in got)


def test_worked_example(spark):
    rows = [
        (1, 0, "user", "First line here\nSecond LINE"), (1, 1, "assistant", "An answer"), (1, 2, "user", "On Monday, Ann wrote:\n> first   line here second\n> line\n\nI disagree"),
        (1, 3, "user", "> An answer\n>> first line here\nthanks"), (2, 0, "user", "> First line here"), (2, 1, None, None), (None, None, "user", ""), (3, 5, "user", "x"), (3, 5, "user", "x"),
    ]
    got = quotation.linked(table(spark, rows)).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [one[k].reply_to for k in range(4)] == [None, 0, 0, 1]
    assert [one[k].thread for k in range(4)] == [0, 1, 0, 1]
    assert [one[k].position for k in (0, 1, 3, 2)] == [0, 1, 2, 3]
    assert one[2].text == "I disagree" and one[3].text == "thanks" and one[3].n_quotes == 2
    assert {(r.turn, r.reply_to, r.text) for r in got if r.conv_id == 2} == {(0, None, ""), (1, 0, "")}
    assert quotation.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_short_common_line_weighs_less_than_a_passage(spark):
    long = "This is the passage that the reply is about and it goes on for a while"
    rows = [(1, 0, "user", long), (1, 1, "user", "thanks"), (1, 2, "user", "> " + long.replace(" reply ", "\n> reply ") + "\n>\n> thanks\nyes")]
    got = {r.turn: r for r in quotation.linked(table(spark, rows)).collect()}
    assert got[2].reply_to == 0 and got[2].text == "yes"
