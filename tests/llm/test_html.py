import itertools
import random
import time

import pytest
from quillmark.llm import html_main, page_model

W, STRENGTH = page_model.fitted()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="text tags">the body of it</div></article>', "the body of it"),
        ('<main><div class="side-by-side"><p>Left column words here.</p></div></main>', "Left column words here."),
        ('<article><h1>T</h1><p>Some text of the paper here.</p><section id="discussion"><p>We found that it works in most of the cases seen.</p></section></article>', "T\n\nSome text of the paper here.\n\nWe found that it works in most of the cases seen."),
        ('<div class="has-sidebar layout"><article><p>Own words.</p></article><div class="sidebar"><p>Other words, many of them, in a row.</p></div></div>', "Own words."),
        ('<article><p>First part.</p><div class="ad-slot"><p>Buy now, it is cheap.</p></div><p>Second part.</p><section class="comments"><p>Nice post, thank you for it.</p></section></article>', "First part.\n\nSecond part."),
        ('<article><p class="x>Hello you there</article>', "Hello you there"),
        ('<article><p class="x>Hello there.</p><p class="y">World.</p></article>', "Hello there.\n\nWorld."),
        ('<article><p data-x="<b>no</b>" title=\'a > b\'>Yes it is.</p></article>', "Yes it is."),
        ("just text without tags", "just text without tags"),
        ("<nav><p>a</p></nav>", ""),
    ],
)
def test_pages(page, text):
    assert html_main.main_text(page) == text


def test_the_cut_is_the_least_of_all_labellings_of_a_page():
    rng = random.Random(31)
    n = 0
    while n < 25:
        page = page_model.generated(rng)
        found, tree = html_main.parsed(page)
        if not 0 < len(found) <= 11:
            continue
        n += 1
        odds = html_main.log_odds(found, W)
        edges = html_main.smoothness(found, tree)
        cost = lambda x: sum(-min(o, 0) if ok else max(o, 0) for o, ok in zip(odds, x)) + sum(STRENGTH * c for a, b, c in edges if x[a] != x[b])
        best = min(map(cost, itertools.product([False, True], repeat=len(found))))
        assert abs(cost(html_main.labelled(page, W, STRENGTH)[1]) - best) < 1e-6


def test_the_cut_changes_labels_for_the_better():
    rng = random.Random(32)
    pages = [page_model.generated(rng) for _ in range(300)]
    total = changed = 0
    for page in pages:
        found, ok = html_main.labelled(page, W, STRENGTH)
        if found:
            total += len(found)
            changed += int(((html_main.log_odds(found, W) > 0) != ok).sum())
    with_cut, without = page_model.wrong(pages, W, STRENGTH), page_model.wrong(pages, W, 0.0)
    assert STRENGTH > 0 and changed > 0 and with_cut < without
    assert with_cut <= 0.04 * total  # held-out accuracy of at least 0.96


def test_time_grows_with_the_page():
    def took(page):
        began = time.perf_counter()
        html_main.main_text(page)
        return time.perf_counter() - began

    for one in ("<div>", "<p class='x>ab ", "<b><i>", "<li><p>x"):
        took(one * 2000)
        assert took(one * 40_000) < 60 * max(took(one * 2000), 0.005)
