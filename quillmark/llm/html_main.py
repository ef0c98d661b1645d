"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks, parted at block-level tags. A linear classifier turns each block's features (what encloses
it, class names, link share, length, tag) into log odds of being content; those are the terminal capacities.
Neighbouring blocks, the more the nearer they stand in the element tree, and blocks of one parent are joined by
smoothness edges. The maximum flow's cut parts content from boilerplate. The classifier's weights and the strength of
the edges are fitted on generated pages with known labels (page_model), never on the input. Scripts, styles, forms'
controls, comments and hidden templates are no text at all.

A null or empty page has an empty text. Rows are the unit; repeated page ids are separate pages. Broken markup never
fails: unclosed elements end with their parents, and a tag with an unclosed quote ends at its first ">". Time grows in
proportion to the page, also where elements are nested deeply. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slices

# Fixed lists of HTML element names.
RAW = frozenset("script style template textarea title noscript iframe xmp noembed noframes".split())
SILENT = frozenset("script style template textarea title noscript iframe xmp noembed noframes select option button head svg math canvas object audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An opening tag ends an open element of these, as in HTML's parsing rules.
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
NAV, FOOTER, ASIDE, FORM, HEADER, ARTICLE, MAIN, STRONG, WEAK, NAMED = (1 << k for k in range(10))
TAGS = {"nav": NAV, "menu": NAV, "footer": FOOTER, "aside": ASIDE, "form": FORM, "dialog": FORM, "header": HEADER, "article": ARTICLE, "main": MAIN}
#: Parts of class, id and role names: of boilerplate, of boilerplate or content, of content, and of wrappers that only tell of others.
STRONG_NAMES = re.compile(r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|trending|sidebar|widget\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|pager|toolbar|masthead|footer|copyright|comments?|commentlist|replies|respond|disqus|contentinfo|complementary|search|skip)$", re.I)
WEAK_NAMES = re.compile(r"(?:rail|header|foot|legal|disclaimer|discussion|tags?|meta|byline|teasers?)$", re.I)
CONTENT_NAMES = re.compile(r"(?:article|story|post|entry|main|content|body|text|articlebody|prose)$", re.I)
WRAPPER_NAMES = re.compile(r"(?:has|with|no|without|layout|page|wrap|wrapper|container|grid|row|cols?|columns?|open|closed)$", re.I)
#: The only names of an article that make it boilerplate.
ARTICLE_NAMES = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|related|comments?|reply|replies)$", re.I)

_ATTRIBUTES = r"(?>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)(?:({_ATTRIBUTES})(?:>|$)|([^>]*)(?:>|$))", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")

#: Steps in the element tree beyond which two neighbouring blocks count as strangers.
FAR = 8
#: Most log odds that one block can have.
MOST = 12.0


class Block:
    __slots__ = ("text", "linked", "parent", "flags", "tag")

    def __init__(self, text: str, linked: int, parent: int, flags: int, tag: str):
        self.text, self.linked, self.parent, self.flags, self.tag = text, linked, parent, flags, tag


def named(tag: str, names: list[str]) -> int:
    """What the class, id and role names of an element tell."""
    flags = 0
    for name in names:
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if tag == "article":
            flags |= STRONG if any(map(ARTICLE_NAMES.match, parts)) else 0
        elif not any(map(WRAPPER_NAMES.match, parts)):
            flags |= STRONG if any(map(STRONG_NAMES.match, parts)) else 0
            flags |= WEAK if any(map(WEAK_NAMES.match, parts)) else 0
            flags |= NAMED if any(map(CONTENT_NAMES.match, parts)) else 0
    if flags & STRONG:
        return STRONG
    return NAMED if flags & NAMED else flags


class _Page:
    """The open elements while a page is read."""

    def __init__(self):
        self.out: list[Block] = []
        #: Of every element its parent, and of each open one: name, number, flags, silent.
        self.parent_of = [0]
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        #: Places in the stack: of the elements of each name, and of those that part blocks.
        self.places: dict[str, list[int]] = {}
        self.parting = [0]
        self.parts: list[str] = []
        self.linked = self.links = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            holder = self.stack[self.parting[-1]]
            self.out.append(Block(text, self.linked, holder[1], self.stack[-1][2], holder[0]))
        self.parts.clear()
        self.linked = 0

    def take(self, text: str) -> None:
        if text and not self.stack[-1][3]:
            self.parts.append(text)
            if self.links:
                self.linked += len(text)

    def close(self, depth: int) -> None:
        """Close the element at this place in the stack and all within it."""
        for name, *_ in self.stack[:depth - 1 if depth else None:-1]:
            self.places[name].pop()
            self.links -= name == "a"
        del self.stack[depth:]
        while self.parting[-1] >= depth:
            self.parting.pop()

    def open(self, name: str, attributes: str) -> None:
        _, parent, flags, silent = self.stack[-1]
        tag = TAGS.get(name, 0)
        if tag == HEADER and flags & (ARTICLE | MAIN):  # an article's own heading
            tag = 0
        if tag == ARTICLE and flags & ARTICLE:  # by HTML's rules, a reader's comment or the like
            tag |= WEAK
        flags |= tag
        if attributes and name not in ("body", "html", "main"):
            flags |= named(name, " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).split())
        silent = silent or name in SILENT or bool(attributes and _HIDDEN.search(attributes))
        self.parent_of.append(parent)
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.parting.append(len(self.stack))
        self.stack.append((name, len(self.parent_of) - 1, flags, silent))
        self.links += name == "a"


def parsed(page: str) -> tuple[list[Block], list[int]]:
    """Text blocks in page order, with what encloses them; and of every element its parent."""
    p, at = _Page(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            p.take(page[at:])
            break
        if m.start() > at:
            p.take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            if p.places.get(name):
                depth = p.places[name][-1]
                if p.parting[-1] >= depth:
                    p.flush()
                p.close(depth)
            continue
        if name in VOID:
            if name == "br":
                p.take(" ")
            elif name == "hr":
                p.flush()
            continue
        for open_, by in CLOSES.items():
            # only through inline elements and itself
            if name in by and p.places.get(open_) and p.parting[-1] == p.places[open_][-1]:
                p.flush()
                p.close(p.places[open_][-1])
        if name not in INLINE:
            p.flush()
        if name in RAW:
            p.open(name, attributes)
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            p.take(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
            p.close(len(p.stack) - 1)
        elif not attributes.endswith("/"):
            p.open(name, attributes)
    p.flush()
    return p.out, p.parent_of


def blocks(page: str) -> list[Block]:
    return parsed(page)[0]


FEATURES = ["one", "words", "linked", "ends", "prose", "cell", "nav", "footer", "aside", "form", "header", "article", "main", "strong", "weak", "named", "share"]


def features(b: Block, page_chars: int) -> list[float]:
    """Of a block of a page that has so many characters of text."""
    has = lambda flag: float(bool(b.flags & flag))
    return [
        1.0, min(np.log1p(b.text.count(" ") + 1) / 3, 1.5), min(1.0, b.linked / max(1, len(b.text))), float(b.text[-1] in ".!?…:;\"”»"),
        float(b.tag in ("p", "h1", "h2", "h3", "blockquote", "pre")), float(b.tag in ("li", "td", "th", "dt", "dd")),
        has(NAV), has(FOOTER), has(ASIDE), has(FORM), has(HEADER), has(ARTICLE), has(MAIN), has(STRONG), has(WEAK), has(NAMED), len(b.text) / page_chars,
    ]


def rows(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    total = max(1, sum(len(b.text) for b in found))
    return np.array([features(b, total) for b in found])


def log_odds(found: list[Block], weights: np.ndarray) -> np.ndarray:
    return np.clip(rows(found) @ weights, -MOST, MOST)


def apart(a: int, b: int, parent_of: list[int]) -> int:
    """Steps between two elements over their nearest common ancestor, at most FAR; a child's number is above its parent's."""
    n = 0
    while a != b and n < FAR:
        if a > b:
            a = parent_of[a]
        else:
            b = parent_of[b]
        n += 1
    return n


def smoothness(found: list[Block], parent_of: list[int]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, by their distance in the element tree, and between blocks of one parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, 1 / (1 + apart(found[i - 1].parent, b.parent, parent_of))))
        above = parent_of[b.parent]
        if above in last and last[above] != i - 1:
            edges.append((last[above], i, 0.5))
        last[above] = i
    return edges


def content_side(n: int, keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay with the source after a maximum flow: keep are capacities from the source, drop to the sink."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(keep[i], drop[i])
        if keep[i] - both > 0:
            edge(s, i, keep[i] - both, 0.0)
        if drop[i] - both > 0:
            edge(i, t, drop[i] - both, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:  # level graph, then blocking flow by an explicit path
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in head[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
            elif turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    turn[a] += 1
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def labelled(page: str, weights: np.ndarray, strength: float) -> tuple[list[Block], list[bool]]:
    found, parent_of = parsed(page)
    if not found:
        return [], []
    odds = log_odds(found, weights)
    edges = [(i, j, strength * w) for i, j, w in smoothness(found, parent_of)]
    return found, content_side(len(found), np.maximum(odds, 0).tolist(), np.maximum(-odds, 0).tolist(), edges)


def main_text(page: str | None, weights: np.ndarray | None = None, strength: float | None = None) -> str:
    if weights is None:
        from .page_model import fitted

        weights, strength = fitted()
    found, keep = labelled(page or "", weights, strength)
    return "\n\n".join(b.text for b, ok in zip(found, keep) if ok)


def _extracted(batches: Iterator[pa.RecordBatch], weights: np.ndarray, strength: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([main_text(h, weights, strength) for h in part.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """Every row of (page_id, url, html): page_id, url, text, n_chars."""
    from .page_model import fitted

    weights, strength = fitted()
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(lambda it: _extracted(it, weights, strength), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
