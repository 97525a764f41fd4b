"""Splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over the last 32 characters marks landmarks that depend on nothing but the text around them; each
landmark snaps to the nearest natural boundary (start of a paragraph, or of a sentence in a paragraph over the limit).
A piece ends at the first snapped landmark past the minimum size. Where none comes before the maximum, the last natural
boundary that fits is cut, then white space, then the text itself. So an edit moves the cuts of neighbouring pieces
only, and a unit that fits into a piece is never cut inside. Every piece but the first repeats up to ``overlap``
characters of the one before, from a word's start on, within the limit.

Defined cases: null and blank texts have no piece; texts within the limit are one piece; very long texts are used
whole; repeated rows count once; an empty table gives an empty result; other columns are ignored. Offsets are code
points of the text as it stands.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import spread

GAP = re.compile(r"(?:\r\n|\n|\r(?!\n))(?:[^\S\r\n]*(?:\r\n|\n|\r(?!\n)))+")
STOP = re.compile(r"(?<=[.!?])\s+")


def spans(text: str, begin: int, end: int, gap: re.Pattern) -> list[tuple[int, int]]:
    """The stretches between gaps, without outer white space."""
    out, at = [], begin
    for m in gap.finditer(text, begin, end):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, end))
    kept = []
    for a, b in out:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        size = len(part.strip())
        if size:
            kept.append((a + lead, a + lead + size))
    return kept


def units(text: str, limit: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """The paragraphs, and for each paragraph over the limit its sentences (an empty list for others)."""
    paragraphs = spans(text, 0, len(text), GAP)
    return paragraphs, [spans(text, a, b, STOP) if b - a > limit else [] for a, b in paragraphs]


def landmarks(text: str, mean: int) -> np.ndarray:
    """Places whose rolling hash over 32 characters has a fixed pattern, one in about ``mean``."""
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0)


def snapped_to(places: np.ndarray, marks: np.ndarray) -> list[int]:
    """The natural boundary nearest to each landmark, ascending."""
    if len(places) < 2 or not len(marks):
        return []
    right = np.searchsorted(places, marks).clip(1, len(places) - 1)
    lower, upper = places[right - 1], places[right]
    return np.unique(np.where(marks - lower <= upper - marks, lower, upper)).tolist()


def cuts_of(text: str, limit: int, overlap: int, least: int, mean: int, marking=landmarks) -> tuple[list[int], dict[int, tuple[int, int, int]]]:
    """Where the pieces begin anew (first one included), and for each unit that has one before it, by its begin: where
    the unit before begins and ends and where the unit itself ends."""
    whole = limit - overlap
    paragraphs, sentences = units(text, limit)
    if not paragraphs:
        return [], {}
    first, last = paragraphs[0][0], paragraphs[-1][1]
    near = {c: (a, b, d) for group in (paragraphs, *sentences) for (a, b), (c, d) in zip(group, group[1:])}
    if last - first <= limit:
        return [first], near
    places = sorted(near)
    stops = [near[c][1] for c in places]  # where the text before each natural boundary ends
    snapped = snapped_to(np.array([first, *places], np.int64), marking(text, mean) + 1)
    out, at = [first], first
    while True:
        some, most = bisect.bisect_right(places, at), bisect.bisect_right(stops, at + whole) - 1
        mark = bisect.bisect_left(snapped, max(at + least, at + 1))
        if mark < len(snapped) and some <= most and snapped[mark] <= places[most] and last - snapped[mark] >= least:
            at = snapped[mark]
        elif last - at <= whole:
            return out, near
        elif some <= most:
            at = places[most]
        elif some < len(places) and stops[some] - at <= limit:  # a single unit may fill a piece up to the limit
            at = places[some]
        elif some == len(places) and last - at <= limit:
            return out, near
        else:  # no boundary fits: white space, else anywhere
            m = re.search(r"\s\S*\Z", text[at + 1 : at + whole + 1])
            n = at + m.start() + 2 if m and m.start() + 2 > whole // 2 else at + whole
            at = n + len(text[n:last]) - len(text[n:last].lstrip())
        out.append(at)


def split_pieces(df: DataFrame, limit: int = 1000, overlap: int = 200, least: int = 250, mean: int = 500) -> DataFrame:
    """(kind, id, piece, begin_at, cut_at, end_at, unit_from, unit_mid, unit_to, content) for a table (kind, id, text).
    begin_at is where the repeated characters begin, cut_at where new text begins. Of a piece that begins with a unit
    behind another one, unit_from and unit_mid are where the unit before begins and ends, unit_to where the unit ends."""

    def work(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [], [], [])
            for kind, i, text in zip(b["kind"].to_pylist(), b["id"].to_pylist(), b["text"].to_pylist()):
                cuts, near = cuts_of(text, limit, overlap, least, mean)
                for n, c in enumerate(cuts):
                    end = cuts[n + 1] if n + 1 < len(cuts) else len(text)
                    end = c + len(text[c:end].rstrip())
                    begin = c
                    if n:
                        lo = max(cuts[n - 1], c - min(overlap, limit - (end - c)))
                        m = re.search(r"(?:(?<=\s)|\A)\S", text[lo:c]) if lo == cuts[n - 1] or text[lo - 1].isspace() else re.search(r"(?<=\s)\S", text[lo:c])
                        begin = lo + m.start() if m else c
                    for col, v in zip(out, (kind, i, n, begin, c, end, *near.get(c, (None, None, None)), text[begin:end])):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["kind", "id", "piece", "begin_at", "cut_at", "end_at", "unit_from", "unit_mid", "unit_to", "content"])

    rows = df.select("kind", F.col("id").cast("long").alias("id"), "text").filter("id is not null and text is not null")
    return spread(rows).mapInArrow(work, "kind string, id long, piece int, begin_at long, cut_at long, end_at long, unit_from long, unit_mid long, unit_to long, content string")


def forced_cuts(pieces: DataFrame, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """(kind, id, cut_at): the cuts between two units of which either leaves room for what is repeated, but that could
    not share a piece."""
    whole = F.lit(limit - overlap)
    alone = (F.col("unit_mid") - F.col("unit_from") <= whole) & (F.col("unit_to") - F.col("cut_at") <= whole)
    return pieces.filter(alone & (F.col("unit_to") - F.col("unit_from") > limit)).select("kind", "id", "cut_at").distinct()
