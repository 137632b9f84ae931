"""Problem 5: split oversized chunks at natural boundaries (dynamic programming).

Only rows above the limit reach Python.  For each text the boundaries are
graded paragraph, line, sentence, word; the coarsest grade is chosen at which
cutting everywhere leaves no segment over the limit.  Over the boundaries of
that and the coarser grades a dynamic programme chooses the cuts: a cut costs
by its grade, a piece by the square of its distance from the even size.  Every
piece but the first begins with an overlap taken from the end of the piece
before, starting at a word, and counts it within the limit.  A segment that
fits the limit but leaves no room for an overlap may be cut at finer grades too,
so no piece goes without.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE

GRADES = ("paragraph", "line", "sentence", "word")
_PATTERNS = (
    re.compile(r"\f|\r?\n(?:[ \t]*\r?\n)+"),
    re.compile(r"\r?\n"),
    re.compile(r"(?<=[.!?])\s+"),
    re.compile(r"\s+"),
)
_SPACES = np.array([ord(c) for c in WHITE], np.uint32)
COST = {"paragraph": 0.0, "line": 0.05, "sentence": 0.1, "word": 0.4, "none": 1.0}


def visible(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For every position 0..n the first visible character at or after it, and the end of the last one before it."""
    seen = ~np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _SPACES)
    n = len(seen)
    at = np.arange(n)
    first = np.append(np.minimum.accumulate(np.where(seen, at, n)[::-1])[::-1], n)
    last = np.append(0, np.maximum.accumulate(np.where(seen, at + 1, 0)))
    return first, last


def _wide(cost: dict[int, float], room: int, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Segments between the cuts whose visible part is longer than ``room``."""
    edges = np.array(sorted({0, *cost, len(first) - 1}))
    size = last[edges[1:]] - first[edges[:-1]]
    return [(int(edges[i]), int(edges[i + 1])) for i in np.nonzero(size > room)[0]]


def boundaries(text: str, limit: int, room: int | None = None) -> tuple[str, list[int], list[float]]:
    """The coarsest grade that is enough for ``limit``, the cut positions in order, and each one's cost.

    A cut stands before the first visible character after its white space.  All
    cuts up to that grade are offered, and finer ones inside segments longer
    than ``room``.  Where even single words are too long (grade ``none`` if they
    exceed the limit) cuts inside words stand every ``limit``/4 characters.
    """
    first, last = visible(text)
    room = limit if room is None else room
    cost: dict[int, float] = {}
    found = "none"
    for grade, pattern in zip(GRADES, _PATTERNS):
        spans = [(0, len(text))] if found == "none" else _wide(cost, room, first, last)
        for a, b in spans:
            for m in pattern.finditer(text, a, b):
                x = int(first[m.end()])
                if 0 < x < len(text) and a < x < b:
                    cost.setdefault(x, COST[grade])
        if found == "none" and not _wide(cost, limit, first, last):
            found = grade
    for a, b in _wide(cost, room, first, last):
        for x in range(a + limit // 4, b, limit // 4):
            cost.setdefault(x, COST["none"])
    at = sorted(cost)
    return found, at, [cost[x] for x in at]


def choose_cuts(text: str, at: list[int], cost: list[float], limit: int, overlap: int) -> list[int]:
    """Cuts of least total cost so that every piece, with its overlap, keeps the limit (outer white space not counted).

    ``at`` must leave no segment above ``limit`` - ``overlap`` - 1.
    """
    first, last = visible(text)
    pos = np.array([0, *at, len(text)])
    # a piece reaches from its first to its last visible character
    begins, ends = first[pos], last[pos]
    pay = np.array([0.0, *cost, 0.0])
    n = len(pos)
    room = limit - overlap - 1  # the overlap and one separating blank
    length = max(1, int(last[-1] - first[0]))
    even = length / max(1, -(-length // room))
    best = np.full(n, np.inf)
    back = np.zeros(n, np.int64)
    best[0] = 0.0
    lo = 0
    for j in range(1, n):
        while lo < j - 1 and ends[j] - begins[lo] > limit:
            lo += 1
        size = ends[j] - begins[lo:j]
        allowed = np.where(np.arange(lo, j) == 0, limit, room)
        total = np.where(size <= allowed, best[lo:j] + pay[j] + ((size - even) / even) ** 2 + 0.02, np.inf)
        k = int(np.argmin(total))
        best[j], back[j] = total[k], lo + k
    cuts, j = [], n - 1
    while j:
        j = int(back[j])
        if j:
            cuts.append(int(pos[j]))
    return cuts[::-1]


def _overlap_start(text: str, begin: int, cut: int, room: int, overlap: int) -> int:
    """Where the repeated tail of ``text[begin:cut]`` starts: at a word, about ``overlap`` characters before the cut."""
    want = min(overlap, room)
    if want <= 0:
        return cut
    low = max(begin, cut - want)
    if low == begin:
        return begin
    space = re.search(r"\s", text[low:cut])
    at = low + space.end() if space else low
    return at if text[at:cut].strip() else low


def split_text(text: str, page_start: int | None, page_end: int | None, limit: int = 2400, overlap: int = 240, chars_per_token: int = 4) -> tuple[str, list[tuple]]:
    """``(grade, [(begin, body_begin, end, content, page_start, page_end, token_count)])`` of one text above the limit."""
    grade, at, cost = boundaries(text, limit, limit - overlap - 1)
    cuts = choose_cuts(text, at, cost, limit, overlap)
    feeds = [m.start() for m in re.finditer("\f", text)]
    edges = [0, *cuts, len(text)]
    out = []
    for a, b in zip(edges, edges[1:]):
        body = text[a:b]
        if not body.strip():
            continue
        begin = a
        if out:
            stripped_end = a + len(body.rstrip())
            begin = _overlap_start(text, out[-1][1], a, limit - (stripped_end - a), overlap)
        whole = text[begin:b]
        first = begin + len(whole) - len(whole.lstrip())
        last = begin + len(whole.rstrip())
        p0 = None if page_start is None else page_start + bisect_right(feeds, first - 1)
        p1 = None if page_start is None else page_start + bisect_left(feeds, last)
        if p0 is not None and page_end is not None:
            p0, p1 = min(p0, max(page_end, page_start)), min(p1, max(page_end, page_start))
        out.append((first, a, last, text[first:last], p0, p1, (last - first) // chars_per_token))
    return grade, out


def split_oversized(chunks: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = 2400, overlap: int = 240, chars_per_token: int = 4, blank: bool = False) -> DataFrame:
    """Pieces ``(chunk_id, boundary, piece, begin, content, page_start, page_end, token_count)`` of all rows over the limit.

    Rows at or under the limit, with null or empty text give no pieces; null
    pages stay null; a null or wrong stored token count is not looked at.
    White space at a piece's ends is left out; form feeds count pages.  A text
    of white space only gives no pieces, or with ``blank`` one empty piece with its
    boundary.  Repeated rows are split alike.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, text, p0, p1 in pdf.itertuples(index=False, name=None):
                p0, p1 = (None if pd.isna(x) else int(x) for x in (p0, p1))
                grade, pieces = split_text(text, p0, p1, limit, overlap, chars_per_token)
                if blank and not pieces:
                    pieces = [(0, 0, 0, "", p0, p1, 0)]
                rows += [(cid, grade, i, x[0], *x[3:]) for i, x in enumerate(pieces)]
            out = pd.DataFrame(rows, columns=["chunk_id", "boundary", "piece", "begin", "content", "page_start", "page_end", "token_count"])
            yield out.astype({c: "Int64" for c in ("piece", "begin", "page_start", "page_end", "token_count")})

    big = chunks.where(F.length(text_col) > limit).select(F.col(id_col).cast("long"), F.col(text_col), F.col("page_start").cast("int"), F.col("page_end").cast("int"))
    return big.mapInPandas(run, "chunk_id long, boundary string, piece int, begin long, content string, page_start int, page_end int, token_count long")
