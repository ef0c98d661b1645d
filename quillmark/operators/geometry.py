"""Operators on positioned words and boxes of pages. ``page`` is the list of columns that name a page.

Everything is a join or a window by page (and band), so no page is ever gathered with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from .intervals import merged

# Places tried for a gutter, in per cent of the width, and what a column must have.
GUTTERS = range(25, 76, 2)
LEAST_BOXES, LEAST_ON_PAGE, LEAST_COVERAGE = 3, 4, 0.05
RIGHT_EDGE, RIGHT_FLUSH, RIGHT_WIDTH = 2.0, 0.8, 0.3
MARGIN = 0.08


def split_glued(words: DataFrame) -> DataFrame:
    """Words of letters directly followed by 10 or more digits become two, cut at the letters' share of the width."""
    shape = r"^([A-Za-z][A-Za-z'-]+)(\d{10,})$"
    head, tail = (F.regexp_extract("text", shape, k) for k in (1, 2))
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.length(head) / F.length("text"))
    part = lambda text, x0, x1: F.struct(text.alias("text"), x0.alias("x0"), x1.alias("x1"))
    parts = F.when(F.length(tail) > 0, F.array(part(head, F.col("x0"), cut), part(tail, cut, F.col("x1")))).otherwise(F.array(part(F.col("text"), F.col("x0"), F.col("x1"))))
    out = words.withColumn("_p", F.explode(parts))
    return out.withColumns({c: F.col("_p")[c] for c in ("text", "x0", "x1")}).drop("_p")


def outside(words: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Words whose centre is in no box of their page; edges count as inside."""
    w, b = words.alias("w"), boxes.alias("b")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    on = x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.top"), F.col("b.bottom"))
    for k in page:
        on = on & F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}"))
    return w.join(b, on, "left_anti")


def text_lines(words: DataFrame, page: list[str], gap: float = 3.0) -> DataFrame:
    """(page, line_no from 0, line): a step of more than ``gap`` from the word before opens a line; words go left to right."""
    w = Window.partitionBy(*page).orderBy("top", "x0", "text")
    stepped = words.withColumn("_new", F.coalesce((F.col("top") - F.lag("top").over(w) > gap).cast("int"), F.lit(0)))
    numbered = stepped.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = numbered.groupBy(*page, "line_no").agg(F.sort_array(F.collect_list(F.struct("x0", "top", "text"))).alias("x"))
    return g.select(*page, "line_no", F.array_join(F.transform("x", lambda s: s["text"]), " ").alias("line"))


def union_length(spans: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Per keys the length of the union of the spans."""
    return merged(spans, keys, low, high).groupBy(*keys).agg(F.sum(F.col(high) - F.col(low)).alias("union_length"))


def _widest(words: DataFrame, page: list[str], least: float) -> DataFrame:
    m = merged(words, [*page, "_width"], "x0", "x1")
    gaps = m.withColumn("_end", F.lag("x1").over(Window.partitionBy(*page, "_width").orderBy("x0"))).withColumn("_gap", F.col("x0") - F.col("_end")).withColumn("_mid", (F.col("x0") + F.col("_end")) / 2)
    good = gaps.where((F.col("_gap") >= least) & F.col("_mid").between(F.col("_width") * 0.1, F.col("_width") * 0.9))
    return good.groupBy(*page).agg(F.max_by("_mid", F.struct("_gap", -F.col("_mid"))).alias("_split"))


def gutter(words: DataFrame, pages: DataFrame, page: list[str], least: float = 15.0) -> DataFrame:
    """(page, split, found): the middle of the widest empty strip between columns.

    ``pages`` has width. Strips lie in the inner 80 per cent of the width. A page without one is looked at again
    without the words that cross its middle; if that fails too the split is the middle and ``found`` is false.
    """
    sized = words.select(*page, "x0", "x1").join(pages.select(*page, F.col("width").alias("_width")), page)
    middle = F.col("_width") / 2
    first = _widest(sized, page, least)
    again = _widest(sized.where(~((F.col("x0") < middle) & (F.col("x1") > middle))), page, least).withColumnRenamed("_split", "_again")
    out = pages.join(first, page, "left").join(again, page, "left")
    found = F.coalesce("_split", "_again")
    return out.select(*page, F.coalesce(found, F.col("width") / 2).alias("split"), found.isNotNull().alias("found"))


def has_columns(boxes: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """(page, columns): whether some gutter has, beside a band that no box crosses, text columns on both sides.

    ``boxes`` has x0, x1, y0, y1, ``pages`` width and height. A side needs LEAST_BOXES boxes and LEAST_COVERAGE of the
    height; a narrow right side whose boxes end flush (dates, say) isn't a column.
    A page's boxes come together once, as a list in its row, and all gutters are tried in that row, so no box is a row of
    each gutter. Pages grow with the boxes: none is broadcast.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    lists = boxes.groupBy(*page).agg(F.collect_list(F.struct(*[number(c) for c in ("x0", "x1", "y0", "y1")])).alias("_b"))
    sized = pages.select(*page, number("width"), number("height")).join(lists.where(F.size("_b") >= LEAST_ON_PAGE).hint("merge"), page, "left")
    kinds = StructType([*[sized.schema[k] for k in page], StructField("columns", BooleanType())])
    return sized.mapInArrow(_columned, kinds)


def _columned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with whether their boxes (``_b``) stand in columns."""
    for batch in batches:
        lists = batch.column("_b")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        sides = [flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "x1", "y0", "y1")]
        width, height = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("width", "height"))
        yes = _in_columns(np.repeat(np.arange(len(size)), size), *sides, width, height)
        own = batch.drop_columns(["_b", "width", "height"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(yes, pa.bool_())], names=[*own.schema.names, "columns"])


def _reach(group: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """The largest of the ranks (below ``n``) so far in each group of an array in order of groups."""
    return np.maximum.accumulate(group * n + rank) - group * n


def _in_columns(page: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """For each page of a batch whether some gutter parts columns; boxes without a place (NaN) are on no side."""
    yes = np.zeros(len(width), bool)
    ok = ~(np.isnan(x0) | np.isnan(x1) | np.isnan(y0) | np.isnan(y1)) & (height[page] > 0) & ~np.isnan(width[page])
    order = np.flatnonzero(ok)[np.lexsort((y1[ok], y0[ok], page[ok]))]
    page, x0, x1, y0, y1 = (v[order] for v in (page, x0, x1, y0, y1))
    ends, rank = np.unique(y1, return_inverse=True)
    n = len(ends) + 1
    for g in GUTTERS:
        # a page that has columns at one gutter needs no other
        at = np.flatnonzero(~yes[page])
        if not len(at):
            break
        p, a, b, r = page[at], y0[at], y1[at], rank[at]
        x = (width * g / 100)[p]
        left, right = x1[at] <= x, x0[at] >= x
        # stretches that some box crosses
        c = np.flatnonzero((x0[at] < x) & (x1[at] > x) & (b > a))
        cp, far = p[c], _reach(p[c], r[c], n)
        new = np.ones(len(c), bool)
        new[1:] = (cp[1:] != cp[:-1]) | (a[c][1:] > ends[far[:-1]])
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(c))[: len(start)] - 1
        sp, s0, s1 = cp[start], a[c][start], ends[far[last]]
        # free bands: before, between and after them
        known = np.unique(p)
        bp, lo, hi = np.concatenate([known, sp]), np.concatenate([np.zeros(len(known)), np.maximum(s1, 0.0)]), height[np.concatenate([known, sp])]
        first = np.flatnonzero(np.append(True, sp[1:] != sp[:-1])[: len(sp)])
        hi[np.searchsorted(known, sp[first])] = s0[first]
        inner = np.flatnonzero(sp[1:] == sp[:-1])
        hi[len(known) + inner] = s0[inner + 1]
        free = np.flatnonzero(hi > lo)
        free = free[np.lexsort((lo[free], bp[free]))]
        bp, lo, hi = bp[free], lo[free], hi[free]
        # the bands of a page are apart and in order, so a box meets a run of them; complex numbers compare by page, then place
        d = np.flatnonzero(left | right)
        begin, end = np.searchsorted(bp + 1j * hi, p[d] + 1j * a[d], "right"), np.searchsorted(bp + 1j * lo, p[d] + 1j * b[d], "left")
        m = np.maximum(end - begin, 0)
        if not m.sum():
            continue
        box = np.repeat(d, m)
        band = np.arange(len(box)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin, m)
        group = band * 2 + ~left[box]
        o = np.argsort(group, kind="stable")
        box, band, group = box[o], band[o], group[o]
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        nth = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
        count = np.diff(np.append(cut, len(group)))
        far = _reach(nth, r[box], n)
        before = np.full(len(box), -np.inf)
        before[1:] = np.where(nth[1:] == nth[:-1], ends[far[:-1]], -np.inf)
        top, bottom = np.maximum(a[box], lo[band]), np.minimum(b[box], hi[band])
        cover = np.add.reduceat(np.maximum(bottom - np.maximum(top, np.minimum(before, hi[band])), 0.0), cut)
        u0, u1 = x0[at][box], x1[at][box]
        flush = np.add.reduceat((np.maximum.reduceat(u1, cut)[nth] - u1 <= RIGHT_EDGE).astype(float), cut) / count
        of, is_right = band[cut], group[cut] % 2 == 1
        narrow = is_right & (flush >= RIGHT_FLUSH) & (np.maximum.reduceat(u1 - u0, cut) < RIGHT_WIDTH * width[bp[of]])
        good = of[(count >= LEAST_BOXES) & (cover >= LEAST_COVERAGE * height[bp[of]]) & ~narrow]
        yes[bp[good[1:][good[1:] == good[:-1]]]] = True
    return yes


def repeated_margin_lines(boxes: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, line, n_pages): texts in the top or bottom MARGIN of two or more pages, folded to lower case and single blanks."""
    b = boxes.join(pages.select(doc, page, "height"), [doc, page])
    near = b.where((F.col("y0") > F.col("height") * (1 - MARGIN)) | (F.col("y1") < F.col("height") * MARGIN))
    line = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    return near.select(doc, page, line.alias("line")).where("line <> ''").groupBy(doc, "line").agg(F.count_distinct(page).alias("n_pages")).where("n_pages >= 2")


def ruled_tables(tables: DataFrame) -> DataFrame:
    """Tables (n_rules: ruling lines of the page, rows: array of arrays of cells) that are really ruled, as piped ``text``."""
    ruled = tables.where((F.col("n_rules") > 0) & (F.size("rows") >= 3) & (F.size(F.get("rows", F.lit(0))) >= 3))
    cells = F.transform("rows", lambda r: F.transform(r, lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    full = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    return ruled.withColumn("text", F.array_join(F.transform(full, lambda r: F.array_join(r, " | ")), "\n"))


def portrait(images: DataFrame, doc: str) -> DataFrame:
    """Of each document's first-page images (width, height, y0, page_height) the squarest that may be a portrait."""
    shape = F.col("width") / F.col("height")
    fit = images.where(F.col("width").between(40, 250) & F.col("height").between(40, 250) & shape.between(0.55, 1.4) & (F.col("y0") < F.col("page_height") * 0.35))
    w = Window.partitionBy(doc).orderBy(F.abs(1 - shape), "y0", "width")
    return fit.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# Words that show a heading, ratios tried for a split, what makes a page one of two columns and a line a stray one.
HEADINGS = ["summary", "experience", "education", "skills", "certifications", "license", "documents", "courses"]
SPLITS = [0.45, 0.50, 0.55, 0.60, 0.65]
LEFT_SHARE, LEAST_RIGHT, STRAY = (0.25, 0.75), 10, 15


def _strip(spans: list[tuple[float, float]], width: float, least: float) -> float | None:
    """The middle of the widest empty strip between sorted spans in the inner 80 per cent of the width, the first of equals."""
    end = best = found = None
    for x0, x1 in spans:
        if end is not None and x0 > end:
            gap, middle = x0 - end, (x0 + end) / 2
            if gap >= least and width * 0.1 <= middle <= width * 0.9 and (best is None or gap > best):
                best, found = gap, middle
        end = x1 if end is None else max(end, x1)
    return found


def _laid_out(batches: Iterator[pa.RecordBatch], least: float, gap: float = 3.0) -> Iterator[pa.RecordBatch]:
    """Pages whose words (``_w``, by x0, top and text) are in two columns, with their lines by ``_ways``."""
    for batch in batches:
        lists, width = batch.column("_w"), batch.column("_width").to_pylist()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        place, tops, texts = (flat.field(k) for k in ("x0", "top", "text"))
        ends, texts = flat.field("x1").to_pylist(), texts.to_pylist()
        placed, has_top = (x.is_valid().to_numpy(zero_copy_only=False) for x in (place, tops))
        starts = place.to_pylist()
        x, top = (np.asarray(v.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)) for v in (place, tops))
        first = np.cumsum(size) - size
        pages, splits = [], []
        for k, (a, n, w) in enumerate(zip(first.tolist(), size.tolist(), width)):
            if w is None or not n:
                continue
            left = int((placed[a : a + n] & (x[a : a + n] < w / 2)).sum())
            if not LEFT_SHARE[0] < left / n < LEFT_SHARE[1] or n - left <= LEAST_RIGHT:
                continue
            spans = [(p, q) for p, q in zip(starts[a : a + n], ends[a : a + n]) if p is not None and q is not None and q > p]
            found = _strip(spans, w, least)
            if found is None:
                found = _strip([(p, q) for p, q in spans if not (p < w / 2 < q)], w, least)
            pages.append(k)
            splits.append([w / 2 if found is None else found, *(w * r for r in SPLITS)])
        ways = []
        if pages:
            n = size[pages]
            page = np.repeat(np.arange(len(pages)), n)
            at = np.arange(len(page)) + np.repeat(first[pages] - np.cumsum(n) + n, n)
            for k in range(len(SPLITS) + 1):
                # words without a place are on no side (2), but have lines too
                side = np.where(placed[at], (x[at] >= np.array([v[k] for v in splits])[page]).astype(np.int8), 2)
                order = np.lexsort((at, top[at], has_top[at], side, page))
                o, key = at[order], page[order] * 3 + side[order]
                opens = np.ones(len(o), bool)
                opens[1:] = (key[1:] != key[:-1]) | (has_top[o[1:]] & has_top[o[:-1]] & (top[o[1:]] - top[o[:-1]] > gap))
                line = np.cumsum(opens)
                o, cuts = o[np.lexsort((o, line))].tolist(), np.append(np.flatnonzero(opens), len(o)).tolist()
                sides: list[list[str]] = [[] for _ in range(3 * len(pages))]
                for g, i, j in zip(key[opens].tolist(), cuts, cuts[1:]):
                    sides[g].append(" ".join(t for t in map(texts.__getitem__, o[i:j]) if t is not None))
                ways.append([{"choice": k, "split": v[k], "left": sides[3 * i], "right": sides[3 * i + 1], "none": sides[3 * i + 2]} for i, v in enumerate(splits)])
        own = batch.drop_columns(["_w", "_width"]).take(pa.array(pages, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([list(x) for x in zip(*ways)], _WAYS)], names=[*own.schema.names, "_ways"])


_WAYS = pa.list_(pa.struct([("choice", pa.int32()), ("split", pa.float64()), *((side, pa.list_(pa.string())) for side in ("left", "right", "none"))]))


def best_split(words: DataFrame, pages: DataFrame, page: list[str], least: float = 15.0) -> DataFrame:
    """(page, choice, split, headings, stray, text) of pages of two columns: the best of six ways to part them.

    Choice 0 is the gutter, the others are SPLITS of the width. A page's words come together once, as a list in its row, and
    all choices are laid out in that row, so no word is a row of each choice and nothing more is sorted or shuffled. The best
    has most headings, then fewest stray lines (a short single word that isn't in capitals), then the longest text, then the
    first place.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    lists = words.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct(number("x0"), number("top"), "text", number("x1")))).alias("_w"))
    # pages grow with the words: none is broadcast
    sized = lists.join(pages.select(*page, number("width").alias("_width")).hint("merge"), page)
    side = "array<string>"
    kinds = StructType([*[sized.schema[k] for k in page], StructField("_ways", ArrayType(StructType.fromDDL(f"choice int, split double, left {side}, right {side}, none {side}")))])
    laid = sized.select(*page, "_w", "_width").mapInArrow(lambda it: _laid_out(it, least), kinds)

    def lone(line: Column) -> Column:
        bare = F.trim(line)
        capital = (F.upper(bare) == bare) & (F.lower(bare) != bare)
        return (bare != "") & ~bare.rlike(r"(?U)\s") & ~capital & (F.length(bare) < STRAY)

    # one step after the other, so that each is made once
    kept = lambda x: F.filter(x, lambda line: ~F.trim(line).rlike(r"(?U)^\p{Alpha}$"))
    whole = lambda x: F.array_join(F.transform(x, lambda line: F.rtrim(line)), "\n")
    steps = [
        lambda w: F.struct(w["choice"].alias("choice"), w["split"].alias("split"), kept(w["left"]).alias("left"), kept(w["right"]).alias("right"), kept(w["none"]).alias("none")),
        lambda w: F.struct(w["choice"].alias("choice"), w["split"].alias("split"), F.concat_ws("\n", whole(w["left"]), whole(w["right"])).alias("text"), F.concat(w["left"], w["right"], w["none"]).alias("lines")),
        lambda w: F.struct(w["choice"].alias("choice"), w["split"].alias("split"), w["text"].alias("text"), F.lower(w["text"]).alias("low"), F.size(w["lines"]).alias("n"), F.size(F.filter(w["lines"], lone)).cast("bigint").alias("stray")),
    ]
    ways = F.col("_ways")
    for step in steps:
        ways = F.transform(ways, step)
    headings = lambda w: sum((F.contains(w["low"], F.lit(h)).cast("int") for h in HEADINGS), F.lit(0))
    ranked = F.transform(F.filter(ways, lambda w: w["n"] > 0), lambda w: F.struct(headings(w).alias("headings"), (-w["stray"]).alias("less"), F.length(w["text"]).alias("length"), (-w["choice"]).alias("place"), w["split"].alias("split"), w["text"].alias("text")))
    best = laid.select(*page, F.array_max(ranked).alias("_b")).where("_b IS NOT NULL")
    return best.select(*page, (-F.col("_b.place")).alias("choice"), "_b.split", "_b.headings", (-F.col("_b.less")).alias("stray"), "_b.text")
