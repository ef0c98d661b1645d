"""Vectorised words, hashes and shingles of whole texts, read from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: Bytes covered by one table of powers; a longer word gets a table of its own length.
_SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True at the bytes that part words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: As BLANK, and all other ASCII characters but letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as one view, and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    view = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return view, off - off[0]


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``budget`` bytes of text, or one row."""
    _, off = raw_bytes(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + budget, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


@dataclass
class Words:
    """Words in page order: byte range in ``data``, number of the text, 64-bit hash; ``bounds`` part the words of the n texts."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(texts: pa.Array, parts: np.ndarray = BLANK) -> Words:
    """Lower-cased words of whole texts: A-Z, and with NOT_ALNUM also the accented letters of Latin-1."""
    raw, off = raw_bytes(texts)
    n_docs = len(off) - 1
    data = LOWER[raw]
    if parts is NOT_ALNUM and len(data) > 1:  # in UTF-8 these are C3 80 to C3 9E, and C3 97 isn't a letter
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[second] += 32
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~parts[data]
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | breaks[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | breaks[1:])) + 1
    bounds = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    h = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _SEGMENT, "right")))
        lo, hi = start[a], end[b - 1]
        up, down = _powers(max(_SEGMENT, int(hi - lo)))
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        h[a:b] = (total[end[a:b] - lo] - total[start[a:b] - lo]) * down[start[a:b] - lo]
        a = b
    h = mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, start, end, doc, h, bounds)


_STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbouring word hashes."""
    n = max(0, len(h) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += h[k : k + n] * _STEPS[k]
    return mixed(total)


def shingle_sets(w: Words, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes; with fewer words the whole sequence is one shingle; no words, none."""
    runs = windows(w.hash, width)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mixed(windows(w.hash[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
