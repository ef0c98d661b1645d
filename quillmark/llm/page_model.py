"""The block classifier of html_main, fitted on generated pages whose labels are known.

A generator writes pages of many layouts, each block with a first letter that tells its label and that no feature sees.
The weights are a ridge logistic regression on some of the pages; the strength of the smoothness edges is the one of a
few that labels the fewest blocks of the other pages wrong. Everything is drawn from fixed seeds.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from .html_main import labelled, parsed, rows

PAGES, HELD = 500, 150
STRENGTHS = (0.0, 1.0, 2.0, 4.0, 6.0, 9.0)
RIDGE = 0.05

_SYLLABLES = "ba re to lin ka mos ver di sul pen or ta gri el non sha".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(lo, hi)))

    def keep(self, lo: int = 1, hi: int = 80) -> str:
        """Prose of an article, now and then with links or without a full stop."""
        r, text = self.rng.random(), self.words(lo, hi)
        if r < 0.12:
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 6)}'
        return "K " + text + ("" if r > 0.9 else ".")

    def drop(self, lo: int = 1, hi: int = 12) -> str:
        return "D " + self.words(lo, hi) + self.rng.choice(["", "", ".", "!"])

    def links(self) -> str:
        items = "".join(f'<li><a href="/y">{self.drop(1, 3)}</a></li>' for _ in range(self.rng.randint(2, 8)))
        return f"<ul>{items}</ul>"

    def boilerplate(self, names: list[str], tag: str = "div") -> str:
        """An element of a name that tells, holding text, a list of links, or both."""
        name = self.rng.choice(names)
        if self.rng.random() < 0.4:
            name = self.rng.choice(["site", "top", "inner", "x1"]) + self.rng.choice("-_") + name
        within = self.rng.choice([f"<p>{self.drop(3, 40)}</p>", self.drop(2, 25), self.links(), f"<h3>{self.drop(1, 3)}</h3>{self.links()}"])
        return f'<{tag} {self.rng.choice(["class", "id"])}="{name}">{within}</{tag}>'

    def group(self) -> str:
        """Boilerplate of a name that tells nothing: links, and prose that alone could be an article's."""
        parts = [self.links(), f"<p>{self.drop(8, 40)}.</p>", f"<p><a href='/z'>{self.drop(2, 9)}</a></p>", self.links(), f"<h3>{self.drop(1, 4)}</h3>", f"<p><a href='/z'>{self.drop(2, 9)}</a></p>"]
        return f'<div class="x{self.rng.randint(1, 9)}">{"".join(self.rng.sample(parts, self.rng.randint(3, 6)))}</div>'

    def tagged(self) -> str:
        tag = self.rng.choice(["aside", "nav", "form", "footer"])
        return f"<{tag}>{self.rng.choice([self.links(), f'<p>{self.drop(2, 30)}</p>', self.drop(2, 15)])}</{tag}>"


_STRONG = "ad advert sponsored promo banner cookie-consent notice newsletter share related recommended sidebar widget menu breadcrumb pagination comments search footer".split()
_WEAK = "rail header legal disclaimer discussion tags meta byline".split()
_CONTENT = "article story post entry content text body".split()


def generated(rng: random.Random) -> str:
    w = _Writer(rng)
    if rng.random() < 0.06:  # nothing but text
        text = w.keep(1, 60)
        return rng.choice([text, f"<p>{text}</p>", f"<div><p>{text}</p></div>", f"<html><body>{text}<p>{w.keep(1, 40)}</p></body></html>"])
    body = [f"<h1>{w.keep(2, 10)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.54:
            body.append(f"<p>{w.keep()}</p>")
        elif kind < 0.58:
            body.append(f"<p><a href='/z'>{w.keep(1, 8)}</a></p>")
        elif kind < 0.62:
            body.append(f"<div>{w.keep(1, 4)}</div>")
        elif kind < 0.70:
            body.append(f"<h2>{w.keep(1, 5)}</h2>")
        elif kind < 0.78:
            body.append("<ul>" + "".join(f"<li>{w.keep(1, 15)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.82:
            body.append(f"<div>{w.keep(2, 40)}</div>")
        elif kind < 0.86:
            body.append(f'<div class="{rng.choice(_WEAK)}"><p>{w.keep(8, 60)}</p></div>')
        elif kind < 0.88:
            body.append(f'<div class="{rng.choice(_WEAK)}">{w.drop(1, 5)}</div>')
        else:
            body.append(w.boilerplate(_STRONG) if rng.random() < 0.7 else w.tagged())
    if rng.random() < 0.3:
        body.append('<section class="comments">' + "".join(f"<p>{w.drop(2, 40)}</p>" for _ in range(rng.randint(1, 4))) + "</section>")
    article = "".join(body)
    holder = rng.random()
    if holder < 0.6:
        article = f"<article>{article}</article>"
    elif holder < 0.8:
        article = f'<div class="{rng.choice(_CONTENT)}">{article}</div>'
    elif holder < 0.85:
        article = f"<div>{w.keep(2, 60)}</div>"
    if rng.random() < 0.3:
        article = f"<main>{article}</main>"
    around = [w.tagged, w.group, lambda: w.boilerplate(_STRONG), lambda: f"<header><p>{w.drop(1, 8)}</p></header>", lambda: f"<div>{w.links()}</div>", lambda: f"<footer>{w.drop(2, 25)}</footer>", lambda: f'<div class="{rng.choice(_WEAK)}">{w.drop(1, 6)}</div>']
    before = "".join(rng.choice(around)() for _ in range(rng.randint(0, 3)))
    after = "".join(rng.choice(around)() for _ in range(rng.randint(0, 3)))
    return f"<html><body>{before}{article}{after}</body></html>"


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (y - p) - RIDGE * w
        bend = (x.T * (p * (1 - p))) @ x + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def is_content(text: str) -> bool:
    """The label of a generated block."""
    return text.startswith("K")


def wrong(pages: list[str], weights: np.ndarray, strength: float) -> int:
    """Blocks of generated pages that get the wrong label."""
    return sum(is_content(b.text) != ok for page in pages for b, ok in zip(*labelled(page, weights, strength)))


@lru_cache(maxsize=1)
def fitted() -> tuple[np.ndarray, float]:
    """(weights, strength of the edges)."""
    rng = random.Random(41)
    pages = [generated(rng) for _ in range(PAGES)]
    found = [parsed(page)[0] for page in pages[HELD:]]
    weights = _regression(np.concatenate([rows(x) for x in found if x]), np.array([float(is_content(b.text)) for x in found for b in x]))
    return weights, min(STRENGTHS, key=lambda s: wrong(pages[:HELD], weights, s))
