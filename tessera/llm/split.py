"""Splitting oversized texts at natural boundaries.

Balanced targets: from the length follows the least number of pieces; the targets of the
cuts lie at equal distances; each cut snaps to the strongest boundary near its target
(paragraph, line, sentence, word, in this order; the nearest of equals, the earlier of
ties), and where none is near to the nearest one that leaves all pieces within the limit.
Cuts within a word are as few as the limit allows: none, unless a word alone exceeds it.
If a piece then exceeds the limit, or a word is cut that needn't be, one piece is added and
all targets move.

Defined results: lengths count code points; null texts and texts within the limit give no
pieces here; a text without any boundary is cut at the targets; a piece after the first
begins with at most ``overlap`` characters repeated from the one before; the pieces less
their overlaps, in order, are the text. Rows that repeat give their pieces each time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: By strength: where a piece may end. Each match's end is a boundary.
BOUNDARIES = [re.compile(p) for p in (r"\r?\n(?:[^\S\n]*\r?\n)+", r"\n", r"[.!?…。！？](?:[\"'”’»)\]]*)\s+", r"\s+")]


def _needed(places: list[int], core: int):
    """A function: how many cuts within words a text needs at least behind a cut, if the piece after it may have ``reach`` characters."""
    least = [0] * len(places)

    def needed(at: int, reach: int = core) -> int:
        best, inner, j = len(places) + places[-1], 0, -1
        while inner < best and j < len(places) - 1:
            j = bisect_right(places, at + reach + inner * core) - 1
            if places[j] > at and j >= 0:
                best = min(best, inner + least[j])
            inner += 1
        return best

    if max((b - a for a, b in zip(places, places[1:])), default=0) > core:
        for i in range(len(places) - 2, -1, -1):
            least[i] = needed(places[i])
    return needed


def _greedy(places: list[int], limit: int, core: int, needed) -> list[int]:
    """Each cut as late as the least number of cuts within words allows."""
    out, n = [], places[-1]
    while not out or out[-1] < n:
        at, reach = (out[-1], core) if out else (0, limit)
        e = places[bisect_right(places, at + reach) - 1]
        # a later cut never needs more behind it, so only the last boundary in reach has to be looked at
        out.append(e if at < e <= at + reach and needed(e) == needed(at, reach) else min(n, at + reach))
    return out


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """The ends of the pieces, the last being len(text)."""
    n = len(text)
    if n <= limit:
        return [n]
    ends = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    places = sorted({n, *(x for e in ends for x in e)})
    core = max(1, limit - overlap)
    needed = _needed(places, core)
    most = needed(0, limit)
    inside = set(places)
    last = _greedy(places, limit, core, needed)
    k = 1 + -(-(n - limit) // core)
    while k <= 2 * len(last):
        out: list[int] = []
        within = 0
        for i in range(1, k):
            # of the k pieces each repeats the overlap, but the first; so the first is longer by it
            step = (n - overlap) / k if n > overlap * k else n / k
            target = min(n - 1, round(step * i + (overlap if n > overlap * k else 0)))
            before = out[-1] if out else 0
            reach = before + (core if out else limit)
            low, high = max(before + 1, target - max(1, int(step / 3))), min(n - 1, target + int(step / 3), reach)
            target = min(max(target, low), max(low, high))
            cut = None
            for e in ends:
                j = [x for x in e[bisect_left(e, low) : bisect_right(e, high)] if within + needed(x) <= most]
                if j:
                    cut = min(j, key=lambda x: (abs(x - target), x))
                    break
            else:
                j = places[bisect_left(places, max(before + 1, n - (k - i) * core)) : bisect_right(places, min(n - 1, reach))]
                j = [x for x in j if within + needed(x) <= most]
                if j:
                    cut = min(j, key=lambda x: (abs(x - target), x))
            if cut is None:
                cut = target if within + 1 + needed(target) <= most else min(n - 1, reach)
            within += cut not in inside
            out.append(cut)
        out.append(n)
        if within <= most and out[0] <= limit and all(0 < b - a <= core for a, b in zip(out, out[1:])):
            return out
        k += 1
    return last


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece; start counts the repeated characters in."""
    out, a = [], 0
    for b in cuts(text, limit, overlap):
        back = min(overlap, a, max(0, limit - (b - a)))
        if back:
            # begin at a word where the repeated part has one
            m = re.search(r"\s\S", text[a - back : a])
            if m and m.start() + 1 < back:
                back -= m.start() + 1
        out.append((a - back, b, back))
        a = b
    return out


SCHEMA = "item_id string, piece int, n_pieces int, start int, overlap int, text string"


def split(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int = 200) -> DataFrame:
    """Pieces of the texts longer than the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    big = df.where(F.length(text_col) > limit).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = pieces_of(text, limit, overlap)
                rows += [(i, k, len(got), s, o, text[s:e]) for k, (s, e, o) in enumerate(got)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "piece", "n_pieces", "start", "overlap", "text"])

    return big.mapInArrow(run, SCHEMA)
